"""Registered queries of the text operators, with production parameters over whole tables."""

from __future__ import annotations

import os
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteflow.llm import decontamination, jaccard_join, lattice_lm, line_dedup, pii, prefix_trie, quality_rules, secret_scan, sentencepiece_codec, sharding, simhash_join, spelling_variants, url_filters
from siteflow.llm.common import table
from siteflow.llm.oracles import ORACLES as ORACLES

#: Where the public SentencePiece model lies; never copied into the repository.
MODEL_PATH = os.environ.get("SITEFLOW_SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


@lru_cache(maxsize=2)
def model_bytes(path: str = MODEL_PATH) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"), model_bytes())


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.ledger(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("removed_places", F.array_join("removed_places", ","))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(table(spark, sf_dir, "documents"))


def op6_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score(table(spark, sf_dir, "documents"), model_bytes())


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = url_filters.captures_of(table(spark, sf_dir, "pages"))
    return url_filters.blocked(captures, url_filters.entries_of(captures))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.withColumns({c: F.round(c, 6) for c in ("score", "question_overlap", "answer_overlap")})


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(table(spark, sf_dir, "documents"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_join.classes(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_sharding, op3_quality_rules, op4_line_dedup, op5_jaccard_join, op6_lattice_lm, op7_url_filters, op8_secret_scan, op9_pii, op10_decontamination, op11_spelling_variants, op12_simhash, op13_prefix_trie, pipeline)}

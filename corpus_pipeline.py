"""From raw documents to token ids: five stages, each written as Parquet and read again as the next one's input.

Nulls and repeated ids: a document is a doc_id (null is one of them) with a text, and every decision is about that pair. Of
linked documents the smallest doc_id stays, null first, then the smallest hash of the text; of rows with equal
doc_id and text that hold words one stays. Rows without words are never copies of each other. No decision hangs on one 64-bit hash: equal
rows are told by two, and the similarity join sees row numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteflow.llm import decontamination, jaccard_join, line_dedup, quality_rules, sentencepiece_codec
from siteflow.llm.catalog import model_bytes
from siteflow.llm.common import WORD, discard, step, table, written


def free_names(docs: DataFrame, count: int) -> list[str]:
    """So many names that no column of docs has."""
    stem = "__row"
    while any(c.lower().startswith(stem) for c in docs.columns):
        stem += "_"
    return [f"{stem}{k}" for k in range(count)]


def row_hashes() -> list[Column]:
    """Two 64-bit hashes of doc_id and text, never null: together they stand for the pair."""
    parts = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("text").isNull(), F.col("text")]
    return [F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy accepts."""
    return quality_rules.accepted(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines are cut out; a document that loses all its words goes."""
    others = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    cut = line_dedup.dedup(docs.select("doc_id", "text", others.alias("row"))).where((F.col("n_removed") == 0) | F.col("text").rlike(WORD))

    def column(c: str) -> Column:
        if c == "text":
            return F.col("text")
        old = F.col("row").getField(c)
        return (F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(old) if c == "n_chars" else old).alias(c)

    return cut.select(*[column(c) for c in docs.columns])


def without(named: DataFrame, gone: DataFrame, row: str) -> DataFrame:
    """The rows of named whose key is not in gone, a written table of keys; keys are broadcast only up to SEND_IDS of them."""
    return named.join(F.broadcast(gone) if gone.count() <= jaccard_join.SEND_IDS else gone, row, "left_anti")


def single(docs: DataFrame) -> DataFrame:
    """docs with one row of each doc_id and text; rows without words all stay."""
    keys = free_names(docs, 2)
    named = docs.withColumns(dict(zip(keys, row_hashes(), strict=True)))
    often = written(named.where(F.col("text").rlike(WORD)).groupBy(*keys).count().where("count > 1").select(*keys), "often")
    if often.isEmpty():
        return docs
    columns = [F.col(f"`{c}`") for c in docs.columns]
    one = named.join(often, keys, "left_semi").groupBy(*keys).agg(F.min(F.struct(*columns)).alias("x")).select("x.*")
    return named.join(often, keys, "left_anti").select(*columns).unionByName(one)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays, null first."""
    [row] = free_names(docs, 1)
    named = written(single(docs).withColumn(row, F.monotonically_increasing_id()), "numbered")
    linked = written(jaccard_join.link(named, id_col=row).where("n_shingles > 0").select(F.col("doc_id").alias(row), "component_id"), "linked")
    order = F.struct("doc_id", F.xxhash64("text").alias("h"), row).alias("order")
    first = linked.join(named.select(row, order), row).groupBy("component_id").agg(F.min("order").alias("first"))
    gone = written(linked.select(row).join(first.select(f"first.{row}"), row, "left_anti"), "gone")
    return without(named, gone, row).select(*[F.col(f"`{c}`") for c in docs.columns])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    [row] = free_names(docs, 1)
    named = docs.withColumn(row, F.concat_ws("-", *[F.hex(h) for h in row_hashes()]))
    hits = written(decontamination.contaminated(named, table(spark, sf_dir, "benchmark"), id_col=row).select(F.col("doc_id").alias(row)).distinct(), "hits")
    return without(named, hits, row).select(*[F.col(f"`{c}`") for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip, parity."""
    return sentencepiece_codec.encode(docs, model_bytes())


STAGES = [("quality", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("decontamination", decontaminated), ("sentencepiece", tokens)]

#: The stages from the similarity join on have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; of each stage only its output stays, until the next one has read it."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, step(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from siteflow.llm import decontamination, jaccard_join, lattice_lm, line_dedup, pii, quality_rules, secret_scan, sentencepiece_codec, sharding, url_filters
from siteflow.llm.catalog import model_bytes

LONG = " ".join(f"w{k % 997} x{k}" for k in range(20_000))
ROWS = [(1, "a b c d e f"), (2, None), (3, ""), (4, "   \n\t "), (5, LONG), (6, "a b c d e f"), (7, "é ü 漢字 😀"), (7, "é ü 漢字 😀"), (None, "lost words without a name"), (8, "A B c D e F")]
N = len(ROWS)


def docs(spark, rows=ROWS):
    """With extra columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit(1) for c in ("n", "key", "word", "shard", "part", "size", "lines", "d", "v", "h", "r", "spans", "kept", "row", "runs", "cut", "places", "n_lines", "n_removed", "removed_places", "__row", "__d", "item_id", "block", "component_id", "tokens", "base")})


OPERATORS = {
    "codec": lambda d: sentencepiece_codec.encode(d, model_bytes()),
    "shard": lambda d: sharding.shard(d, 5),
    "ledger": quality_rules.ledger,
    "dedup": line_dedup.dedup,
    "link": jaccard_join.link,
    "lm": lambda d: lattice_lm.score(d, model_bytes()),
    "secrets": secret_scan.scan,
    "pii": pii.find,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row(spark, name):
    got = OPERATORS[name](docs(spark)).select("doc_id").collect()
    assert sorted((r["doc_id"] or 0) for r in got) == sorted((i or 0) for i, _ in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](docs(spark, [])).count() == 0


@pytest.mark.parametrize("name", ["codec", "ledger", "lm", "secrets", "pii"])
def test_equal_rows_give_equal_results(spark, name):
    got = [r.asDict() for r in OPERATORS[name](docs(spark)).where("doc_id = 7").collect()]
    assert len(got) == 2 and got[0] == got[1]


def test_contaminated_edges(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven. eight nine."), (2, None), (3, "")], "item_id long, text string")
    found = decontamination.contaminated(docs(spark, [*ROWS, (9, "x one two three four five six seven eight nine y")]), items).collect()
    assert [(r["doc_id"], r["item_id"]) for r in found] == [(9, 1)]
    assert decontamination.contaminated(docs(spark), items.limit(0)).count() == 0
    assert decontamination.contaminated(docs(spark, []), items).count() == 0


def test_url_edges(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "http://a.b.example.com/x?utm_source=feed"), (3, "http://a.b.example.com/x?utm_source=feed"), (None, "no url")], "page_id long, url string")
    captures = url_filters.captures_of(pages).withColumn("host", F.lit("clash"))
    rows = url_filters.blocked(captures, url_filters.entries_of(captures)).collect()
    assert len(rows) == 5 and not any(r["blocked"] for r in rows)
    assert url_filters.blocked(captures.limit(0), url_filters.entries_of(captures)).count() == 0


def test_pipeline_stages_on_edges(spark, tmp_path):
    import corpus_pipeline

    bench = spark.createDataFrame([(1, "no such words here at all")], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (ROWS, []):
        d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(None).cast("long")})
        d = d.withColumns({c: F.lit(1) for c in ("__row", "row", "n_removed", "removed_places", "n_lines", "component_id", "kept", "item_id", "first", "x", "d", "v")})
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, d, str(tmp_path))
            if k < 4:
                assert out.columns == d.columns and all(tuple(r) == (1, 1, 1) for r in out.select("__row", "n_removed", "d").collect())
            out.count()


def test_pipeline_decides_by_id_and_text(spark, tmp_path):
    import corpus_pipeline

    item = "one two three four five six seven. eight nine."
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    stages = dict(corpus_pipeline.STAGES)

    def kept(stage, rows):
        out = stages[stage](spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path)).collect()
        return sorted(((r["doc_id"], r["text"]) for r in out), key=str)

    bad, clean = f"x {item} y", "a clean text"
    rows = [(None, bad), (None, clean), (7, bad), (7, clean), (8, None), (None, None)]
    assert kept("decontamination", rows) == sorted([(None, clean), (7, clean), (8, None), (None, None)], key=str)
    rows = [(None, a), (None, a), (5, a + " z"), (3, b), (9, b), (9, c), (9, c), (None, ""), (None, ""), (4, None)]
    assert kept("near_duplicates", rows) == sorted([(None, a), (3, b), (9, c), (None, ""), (None, ""), (4, None)], key=str)


def test_pipeline_leaves_one_table_behind(spark):
    """Of all that the stages write only what the last one reads stays, and it reads it whole."""
    import os

    import corpus_pipeline

    top = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(top))
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert [name.rsplit("-", 1)[0] for name in set(os.listdir(top)) - before] == ["decontamination"]
    assert out.count() == out.select("doc_id").distinct().count() > 0


def test_lm_tells_texts_of_one_checksum_apart(spark):
    import zlib

    a, b = "applee50f09ed147e", "pear af7fe79d0061"
    assert zlib.crc32(a.encode()) == zlib.crc32(b.encode())
    got = lattice_lm.score(spark.createDataFrame([(None, a), (None, b)], "doc_id long, text string"), model_bytes()).collect()
    assert sorted(r["n_tokens"] for r in got) == [2, 3]

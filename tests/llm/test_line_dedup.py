"""Line deduplication through its fingerprints: what the join of positions decides, and what further places do."""

import random

import pytest
from pyspark.sql import functions as F
from test_brute_force import brute_removed

from siteflow.llm import line_dedup


def table(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3)


def removed(df):
    return {r["doc_id"]: set(r["removed_places"]) for r in df.collect() if r["removed_places"]}


def passages(seed, n=60):
    """Documents of lines that many share in many contexts: the same common line between lines of several kinds."""
    draw = random.Random(seed)
    pool = [" ".join(f"w{draw.randint(0, 30)}" for _ in range(draw.randint(4, 14))) for _ in range(14)]
    blocks = [[draw.choice(pool) for _ in range(draw.randint(4, 9))] for _ in range(6)]
    docs = []
    for i in range(n):
        lines = []
        for _ in range(draw.randint(1, 4)):
            lines += draw.choice(blocks) if draw.random() < 0.7 else [draw.choice(pool) for _ in range(5)]
            lines += [f"own {i} {draw.random()}"] * (draw.random() < 0.6)
        docs.append((i, "\n".join(lines)))
    return docs


@pytest.mark.parametrize("seed", range(4))
def test_common_lines_in_many_contexts(spark, seed):
    docs = passages(seed)
    assert removed(line_dedup.dedup(table(spark, docs))) == {i: set(x) for i, x in brute_removed(docs).items() if x}


def test_further_places(spark):
    """The fingerprint's first place has other lines around it; the copy is in the second."""
    block = [f"{c} " * 9 + c for c in "abcdefg"]
    first = [*[f"x{k} " * 10 for k in range(3)], *block[2:5], *[f"y{k} " * 10 for k in range(3)]]
    docs = [(1, "\n".join(first)), (2, "\n".join(block)), (3, "\n".join(["head", *block, "tail"])), (4, "\n".join(block[:3] + block[1:2] + block[3:]))]
    want = {i: set(x) for i, x in brute_removed(docs).items() if x}
    assert want[3] == set(range(1, 8))
    assert removed(line_dedup.dedup(table(spark, docs))) == want


def test_the_fingerprint_join_decides(spark, monkeypatch):
    """With other fingerprints, or without joined positions, nothing is found."""
    block = "\n".join(f"line {k} of a passage that is copied word for word" for k in range(12))
    docs = table(spark, [(1, f"one\n{block}"), (2, f"two\nthree\n{block}")])
    assert removed(line_dedup.dedup(docs)) == {2: set(range(2, 14))}
    real = line_dedup.postings
    with monkeypatch.context() as m:
        m.setattr(line_dedup, "postings", lambda lines, n: real(lines, n).withColumn("fp", F.xxhash64("fp", "d")))
        assert removed(line_dedup.dedup(docs)) == {}
    with monkeypatch.context() as m:
        m.setattr(line_dedup, "postings", lambda lines, n: real(lines, n).where("d = 1"))
        assert removed(line_dedup.dedup(docs)) == {}


def test_equal_hashes_are_not_enough(spark, monkeypatch):
    """Lines whose first hash collides differ in the second, and stay."""
    real = line_dedup.line_table

    def collided(*a):
        return real(*a).withColumn("lines", F.transform("lines", lambda x, k: F.struct(k.cast("long").alias("h"), x["g"].alias("g"), x["n"].alias("n"), x["i"].alias("i"))))

    monkeypatch.setattr(line_dedup, "line_table", collided)
    docs = [(d, "\n".join(f"document {d} line {k} has its own words and no others here" for k in range(9))) for d in (1, 2)]
    assert removed(line_dedup.dedup(table(spark, docs))) == {}

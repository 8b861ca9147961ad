"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteflow.llm.common import discard, written


def components(edges: DataFrame, *, rounds: int = 60) -> DataFrame:
    """node, component (the smallest reachable node) of every node of edges (a, b); self-edges are fine.

    Each round hangs every neighbour that is larger under the smallest one, then does so for the smaller ones. Minima are
    combined before the shuffle and hubs are only a hot side of a join, so a component with most nodes stays spread out.
    """

    def smallest(both: DataFrame) -> DataFrame:
        return both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    # Larger node first.
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    nodes = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    before, first = state(e), e
    for _ in range(rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(smallest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, large = e, written(large.where("u <> v").distinct(), "large")
        least = smallest(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        e = written(small.where("u <> v").distinct(), "small")
        after = state(e)
        discard(large, *([last] if last is not first else []))
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))

"""Connected components: of rows in one task, and of an edge table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteflow.functions.lineage import cut


def least_rows(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row of the component of each of n rows that the pairs (a, b) connect."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (up := root[root])).any():
            root = up
    return root


def least_reachable(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """node and root, the least node reachable, for every node of edges (a, b).

    Each round every node takes its neighbours' least root and then that root's root, so long paths shorten by halves.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    for _ in range(rounds):
        near = both.join(state.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low"))
        own = state.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "low").alias("low"))
        far = own.join(own.select(F.col("node").alias("low"), F.col("low").alias("far")), "low", "left")
        new = cut(far.select("node", F.least("low", F.coalesce("far", "low")).alias("root"), "old"))
        state = new.select("node", "root")
        if new.where("root <> old").isEmpty():
            return state
    raise RuntimeError(f"components did not settle in {rounds} rounds")

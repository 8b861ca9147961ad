"""Peaks: connected kept sites, their mean and largest trajectories, and the way back to pixels."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteflow.functions.lineage import cut
from siteflow.operators.tiles import connected
from siteflow.sources.cube import coords, site_of, with_coords


def neighbours(sites: DataFrame, sizes: list[int], offsets: list[tuple[int, ...]], extra: list[float] | None = None) -> DataFrame:
    """i, j (and w): pairs of sites whose coordinates differ by one of the offsets, by an equality join on coordinates."""
    if len(sizes) not in (2, 3):
        raise ValueError("sites must have two or three coordinates")
    names = coords(len(sizes))
    placed = with_coords(sites.select("site"), sizes)
    steps = F.explode(F.array(*[F.struct(*[F.lit(int(d)).alias(f"d{k}") for k, d in enumerate(o)], F.lit(float(w)).alias("w")) for o, w in zip(offsets, extra or [1.0] * len(offsets), strict=True)])).alias("o")
    moved = placed.select(F.col("site").alias("i"), *names, steps).select("i", *[(F.col(c) + F.col(f"o.d{k}")).alias(c) for k, c in enumerate(names)], F.col("o.w").alias("w"))
    inside = F.lit(True)
    for c, n in zip(names, sizes, strict=True):
        inside = inside & F.col(c).between(0, n - 1)
    return moved.where(inside).select("i", site_of(sizes).alias("j"), "w").join(sites.select(F.col("site").alias("j")), "j", "left_semi").select("i", "j", "w")


def label(sites: DataFrame, sizes: list[int], side: int | None = None) -> DataFrame:
    """site and peak: connected by any of the 8 or 26 neighbours, numbered from 0 in raster order of the first site."""
    state = cut(connected(sites, sizes, side))
    return state.join(numbered(state.select("root").distinct(), sizes), "root").select("site", "peak")


def numbered(roots: DataFrame, sizes: list[int], chunks: int = 4096) -> DataFrame:
    """root and peak, its number in order: counted by chunks of the grid, whose offsets are a running sum of at most `chunks` rows."""
    n_sites = math.prod(sizes)
    chunk = F.expr(f"root div {max(1, -(-n_sites // chunks))}").alias("chunk")
    placed = roots.select("root", chunk)
    before = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("chunk").count().select("chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("chunk").orderBy("root")) - 1
    return placed.withColumn("rank", rank).join(F.broadcast(counts), "chunk").select("root", (F.col("before") + F.col("rank")).cast("long").alias("peak"))


def trajectories(cube: DataFrame, members: DataFrame) -> DataFrame:
    """peak, t, mean and largest value of the raw cube over the peak's sites."""
    return cube.join(members, "site").groupBy("peak", "t").agg((F.sum("v") / F.count("*")).alias("v_mean"), F.max("v").alias("v_max"))


def trajectories_packed(packed: DataFrame, members: DataFrame) -> DataFrame:
    """The same from packed raw trajectories (site, y) of the members."""
    cells = packed.join(members, "site").select("peak", F.posexplode("y").alias("t", "v"))
    return cells.groupBy("peak", "t").agg((F.sum("v") / F.count("*")).alias("v_mean"), F.max("v").alias("v_max"))


def to_pixels(members: DataFrame, peak_labels: DataFrame) -> DataFrame:
    """site, peak and the label of its peak."""
    return members.join(peak_labels, "peak").select("site", "peak", "label")

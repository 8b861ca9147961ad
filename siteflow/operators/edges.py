"""Neighbourhood weights between sites (a row-stochastic matrix kept as an edge table) and smoothing with them."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteflow.operators.peaks import neighbours
from siteflow.operators.tiles import Smoother, local_smoother
from siteflow.sources.cube import coords, with_coords

#: Classes of a unit cell (with an array each) that are broadcast at most.
SEND_CLASSES = 100_000


def local_offsets(rank: int, l_scale: float, zero_cutoff: float = 1e-2) -> list[tuple[tuple[int, ...], float]]:
    """Integer offsets whose Gaussian kernel is above the cutoff, with the kernel's value: a bounded set."""
    reach = math.ceil(l_scale * math.sqrt(max(0.0, -math.log(zero_cutoff)))) if zero_cutoff < 1 else 0
    found = []
    for o in itertools.product(range(-reach, reach + 1), repeat=rank):
        w = math.exp(-sum(d * d for d in o) / l_scale**2)
        if w > zero_cutoff:
            found.append((o, w))
    return found


def normalised(edges: DataFrame) -> DataFrame:
    total = F.sum("w").over(Window.partitionBy("i"))
    return edges.withColumn("w", F.col("w") / F.greatest(total, F.lit(1e-12)))


def local_edges(sites: DataFrame, sizes: list[int], l_scale: float = 1.0, *, uniform: bool = True, zero_cutoff: float = 1e-2) -> DataFrame:
    """i, j, w: kept sites near each other; rows sum to 1. uniform gives every neighbour the same weight."""
    found = local_offsets(len(sizes), l_scale, zero_cutoff)
    return normalised(neighbours(sites, sizes, [o for o, _ in found], [1.0 if uniform else w for _, w in found]))


def residue_class(unit: list[int]) -> Column:
    """Row-major number of the coordinates modulo the unit cell: the periodic kernel depends on nothing else."""
    out = F.lit(0).cast("long")
    for c, u in zip(coords(len(unit)), unit, strict=True):
        out = out * u + F.col(c) % u
    return out


def residues(sites: DataFrame, sizes: list[int], unit: list[int]) -> DataFrame:
    """site and class."""
    return with_coords(sites.select("site"), sizes).select("site", residue_class(unit).alias("class"))


def periodic_classes(sites: DataFrame, sizes: list[int], unit: list[int] | None, l_scale: float, *, uniform: bool = True, zero_cutoff: float = 1e-2) -> DataFrame:
    """class, other, w: the weight a site of `class` gives to each site of `other`, as a table for inspection; smoothing needs none.

    Residue offsets are opened axis by axis and dropped as soon as the kernel is below the cutoff, since it only falls.
    """
    if unit is None:
        raise TypeError("the periodic kernel needs the unit cell's shape")
    out = residues(sites, sizes, unit).groupBy("class").agg(F.count("*").alias("n")).select("class", F.lit(0).cast("long").alias("other"), F.lit(0.0).alias("e"))
    below = math.prod(unit)
    for u in unit:
        below //= u
        out = out.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(u - 1))))
        wave = F.sin(math.pi * F.col("d") / u)
        out = out.withColumn("e", F.col("e") + wave * wave).where(F.exp(-F.col("e") / l_scale**2) > zero_cutoff)
        out = out.withColumn("other", F.col("other") * u + (F.expr(f"class div {below}") % u + F.col("d")) % u).drop("d")
    counts = residues(sites, sizes, unit).groupBy("class").agg(F.count("*").alias("n"))
    weighted = out.withColumn("w", F.lit(1.0) if uniform else F.exp(-F.col("e") / l_scale**2)).join(counts.select(F.col("class").alias("other"), "n"), "other")
    total = F.sum(F.col("w") * F.col("n")).over(Window.partitionBy("class"))
    return weighted.select("class", "other", (F.col("w") / F.greatest(total, F.lit(1e-12))).alias("w"))


def torus_kernel(unit: list[int], l_scale: float, uniform: bool, zero_cutoff: float) -> np.ndarray:
    """The periodic kernel at every residue offset."""
    waves = [np.sin(np.pi * np.arange(u) / u) ** 2 for u in unit]
    kernel = np.exp(-sum(np.ix_(*waves)) / l_scale**2)
    return np.where(kernel > zero_cutoff, 1.0 if uniform else kernel, 0.0)


def markov(sites: DataFrame, sizes: list[int], kernel: str = "local", **options) -> DataFrame:
    if kernel == "local":
        return local_edges(sites, sizes, **options)
    if kernel == "periodic":
        return periodic_classes(sites, sizes, **options)
    raise ValueError("kernel must be 'local' or 'periodic'")


def smooth(resp: DataFrame, edges: DataFrame, times: int = 1) -> DataFrame:
    """site, k, r: responsibilities averaged over neighbours, `times` times."""
    for _ in range(times):
        resp = edges.join(resp.withColumnRenamed("site", "j"), "j").groupBy(F.col("i").alias("site"), "k").agg(F.sum(F.col("w") * F.col("r")).alias("r"))
    return resp


def smooth_periodic(resp: DataFrame, sizes: list[int], unit: list[int], l_scale: float, times: int = 1, *, uniform: bool = True, zero_cutoff: float = 1e-2) -> DataFrame:
    """site and r: the arrays r averaged under the periodic kernel, which depends on residues modulo the unit cell only.

    Sums by residue class and component are convolved with the kernel around the cell's torus, a task a component, by fast Fourier transforms:
    work and memory follow the cell, not its square, nor the sites.
    """

    def convolve(table: pa.Table) -> pa.Table:
        at = table.column("class").to_numpy()
        n, s = np.zeros(math.prod(unit)), np.zeros(math.prod(unit))
        n[at], s[at] = table.column("n").to_numpy(), table.column("s").to_numpy()
        wave = np.fft.rfftn(torus_kernel(unit, l_scale, uniform, zero_cutoff))
        around = lambda x: np.fft.irfftn(np.fft.rfftn(x.reshape(unit)) * wave, unit).ravel()
        weight = np.maximum(around(n), 1e-12)
        for _ in range(times):
            mean = around(s) / weight
            s = n * mean  # all sites of a class have its mean now
        return pa.table({"class": at, "k": table.column("k"), "r": mean[at]})

    placed = with_coords(resp.select("site", "r"), sizes).select("site", "r", residue_class(unit).alias("class"))
    sums = placed.select("class", F.posexplode("r").alias("k", "x")).groupBy("class", "k").agg(F.count("*").alias("n"), F.sum("x").alias("s"))
    mixed = sums.groupBy("k").applyInArrow(convolve, "class long, k int, r double")
    by_class = mixed.groupBy("class").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "r"))), lambda x: x["r"]).alias("r"))
    # At most a row a place of the cell; a small cell has few, hot classes, a large one many.
    return placed.select("site", "class").join(F.broadcast(by_class) if math.prod(unit) <= SEND_CLASSES else by_class, "class").select("site", "r")


def smoother(edges: DataFrame, times: int = 1) -> Smoother:
    """What a fit applies to its responsibilities (site, r): averages over the neighbours of any edge table."""

    def apply(resp: DataFrame) -> DataFrame:
        long = smooth(resp.select("site", F.posexplode("r").alias("k", "r")), edges, times)
        return long.groupBy("site").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "r"))), lambda x: x["r"]).alias("r"))

    return apply


def near_smoother(sizes: list[int], l_scale: float = 1.0, times: int = 1, *, uniform: bool = True, zero_cutoff: float = 1e-2, side: int | None = None) -> Smoother:
    """The same for the local kernel, by stencils over tiles instead of edges."""
    return local_smoother(sizes, [(o, 1.0 if uniform else w) for o, w in local_offsets(len(sizes), l_scale, zero_cutoff)], times, side)


def periodic_smoother(sizes: list[int], unit: list[int], l_scale: float, times: int = 1, **options) -> Smoother:
    """The same for the periodic kernel, around the cell's torus."""
    return lambda resp: smooth_periodic(resp, sizes, unit, l_scale, times, **options)


def unit_cell(axis: DataFrame, names: list[str]) -> DataFrame:
    """name and size: positions from the first whole coordinate x up to x + 1, the upper end not counted."""
    mine = axis.where(F.col("name").isin(names))
    first = mine.where(F.col("value") % 1 == 0).groupBy("name").agg(F.min("value").alias("x"))
    return mine.join(first, "name").where(F.col("value").between(F.col("x"), F.col("x") + 1)).groupBy("name").agg((F.count("*") - 1).cast("long").alias("size"))

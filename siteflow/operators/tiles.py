"""Work on a grid by square tiles: a site's neighbourhood lies in its own tile or in a halo of copies from the tiles around.

A tile is a group of a bounded size, dense in memory while a task works on it, so its sites meet without a join.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteflow.functions.graph import least_reachable, least_rows
from siteflow.functions.lineage import cut
from siteflow.sources.cube import coords, site_of, with_coords

#: Sides of a tile by the rank of the grid: 16,384 or 32,768 sites.
SIDES = {2: 128, 3: 32}


def side_of(sizes: list[int], side: int | None) -> int:
    if len(sizes) not in SIDES:
        raise ValueError("sites must have two or three coordinates")
    return side or SIDES[len(sizes)]


def shape_in_tiles(sizes: list[int], side: int) -> list[int]:
    return [-(-n // side) for n in sizes]


def number_of(places: list, counts: list[int]):
    """Row-major number of a tile from its coordinates."""
    out = F.lit(0).cast("long")
    for p, n in zip(places, counts, strict=True):
        out = out * n + p
    return out


def unravel(numbers: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """Coordinates of row-major numbers."""
    out = []
    for n in reversed(sizes):
        out.insert(0, numbers % n)
        numbers = numbers // n
    return out


def half(rank: int) -> list[tuple[int, ...]]:
    """One of each two opposite neighbours among the 8 or 26."""
    return [o for o in itertools.product((-1, 0, 1), repeat=rank) if o > (0,) * rank]


def connected(sites: DataFrame, sizes: list[int], side: int | None = None) -> DataFrame:
    """site and root, the first site (row by row) of its component under the 8 or 26 neighbours.

    A tile's sites are joined to local roots in one Arrow pass. Only sites on the tiles' borders meet those of other tiles, and what is
    then iterated is a graph of local roots; a component inside a tile takes no part in it.
    """
    side = side_of(sizes, side)
    counts, rank = shape_in_tiles(sizes, side), len(sizes)
    names = coords(rank)

    def local(table: pa.Table) -> pa.Table:
        site = np.sort(table.column("site").to_numpy())
        place = [c % side for c in unravel(site, sizes)]
        wide = side + 2
        at = sum((p + 1) * wide ** (rank - 1 - k) for k, p in enumerate(place))
        found = np.full(wide**rank, -1)
        found[at] = np.arange(len(site))
        a, b = [], []
        for o in half(rank):
            other = found[at + sum(d * wide ** (rank - 1 - k) for k, d in enumerate(o))]
            a.append(np.flatnonzero(other >= 0))
            b.append(other[other >= 0])
        root = site[least_rows(len(site), np.concatenate(a), np.concatenate(b))]
        border = np.any([(p == 0) | (p == side - 1) for p in place], axis=0)
        return pa.table({"site": site, "root": root, "border": border})

    tile = number_of([F.expr(f"{c} div {side}") for c in names], counts)
    locals_ = cut(with_coords(sites.select("site").distinct(), sizes).select("site", tile.alias("tile")).groupBy("tile").applyInArrow(local, "site long, root long, border boolean"))
    edge = with_coords(locals_.where("border").select("site", "root"), sizes)
    steps = F.explode(F.array(*[F.struct(*[F.lit(d).alias(f"d{k}") for k, d in enumerate(o)]) for o in half(rank)])).alias("o")
    moved = edge.select(F.col("root").alias("a"), *names, steps).select("a", *[F.col(c).alias(f"from_{c}") for c in names], *[(F.col(c) + F.col(f"o.d{k}")).alias(c) for k, c in enumerate(names)])
    inside = [F.col(c).between(0, n - 1) for c, n in zip(names, sizes, strict=True)]
    leaves = [F.expr(f"from_{c} div {side} <> {c} div {side}") for c in names]
    crossing = moved.where(_all(inside) & ~_all([~x for x in leaves])).select("a", site_of(sizes).alias("site"))
    links = crossing.join(edge.select("site", F.col("root").alias("b")), "site").select("a", "b").distinct()
    joined = least_reachable(links)
    roots = locals_.select("root").distinct().join(joined.select(F.col("node").alias("root"), F.col("root").alias("least")), "root", "left")
    # A local root has at most a tile's sites, so this join meets no large key.
    return locals_.select("site", "root").join(roots, "root").select("site", F.coalesce("least", "root").alias("root"))


def _all(conditions: list):
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def with_halo(rows: DataFrame, sizes: list[int], reach: int, side: int) -> DataFrame:
    """rows with a column tile: once for each tile that lies within reach of the site, its own one included."""
    counts = shape_in_tiles(sizes, side)
    out = with_coords(rows, sizes)
    names = coords(len(sizes))
    for k, (c, n) in enumerate(zip(names, counts, strict=True)):
        first = F.greatest(F.lit(0), F.floor((F.col(c) - reach) / side).cast("int"))
        last = F.least(F.lit(n - 1), F.floor((F.col(c) + reach) / side).cast("int"))
        out = out.withColumn(f"tile{k}", F.explode(F.sequence(first, last)))
    places = [F.col(f"tile{k}") for k in range(len(sizes))]
    return out.withColumn("tile", number_of(places, counts)).drop(*names, *[f"tile{k}" for k in range(len(sizes))])


def stencil(resp: DataFrame, sizes: list[int], offsets: list[tuple[tuple[int, ...], float]], side: int | None = None) -> DataFrame:
    """site and r: the arrays r of resp averaged over the sites at the offsets, by their weights; absent sites do not count.

    One exchange, of the sites and the halos' copies. In a tile each offset is one shifted sum of arrays.
    """
    reach = max(max(abs(d) for d in o) for o, _ in offsets)
    if reach == 0:
        return resp.select("site", "r")
    side = side_of(sizes, side)
    counts, rank = shape_in_tiles(sizes, side), len(sizes)

    def smooth(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        origin = [int(c) * side for c in unravel(np.array(key[0].as_py()), counts)]
        site = table.column("site").to_numpy()
        r = np.stack(table.column("r").to_numpy())
        place = tuple(c - o + reach for c, o in zip(unravel(site, sizes), origin, strict=True))
        wide = (side + 2 * reach,) * rank
        values, there = np.zeros((*wide, r.shape[1])), np.zeros(wide)
        values[place], there[place] = r, 1.0
        total, weight = np.zeros((side,) * rank + r.shape[1:]), np.zeros((side,) * rank)
        for o, w in offsets:
            window = tuple(slice(reach + d, reach + d + side) for d in o)
            total += w * values[window]
            weight += w * there[window]
        own = np.all([(p >= reach) & (p < reach + side) for p in place], axis=0)
        mine = tuple(p[own] - reach for p in place)
        out = total[mine] / np.maximum(weight[mine], 1e-12)[:, None]
        return pa.table({"site": site[own], "r": pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), r.shape[1]).cast(pa.list_(pa.float64()))})

    return with_halo(resp.select("site", "r"), sizes, reach, side).groupBy("tile").applyInArrow(smooth, "site long, r array<double>")


Smoother = Callable[[DataFrame], DataFrame]


def local_smoother(sizes: list[int], offsets: list[tuple[tuple[int, ...], float]], times: int = 1, side: int | None = None) -> Smoother:
    """What a fit applies to its responsibilities (site, r): `times` stencils, each through a checkpoint but the last."""

    def apply(resp: DataFrame) -> DataFrame:
        for k in range(times):
            resp = stencil(resp if k == 0 else cut(resp), sizes, offsets, side)
        return resp

    return apply

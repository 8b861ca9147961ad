"""Tables behind plots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteflow.sources.cube import coords, with_coords


def average_intensity(cube: DataFrame, labels: DataFrame) -> DataFrame:
    """label, t, mean raw intensity."""
    return cube.join(labels, "site").groupBy("label", "t").agg((F.sum("v") / F.count("*")).alias("v"))


def envelope(params: DataFrame) -> DataFrame:
    """k, t, mean and the band of one deviation around it."""
    std = F.sqrt(F.greatest(F.col("var"), F.lit(0.0)))
    return params.select("k", "t", "mu", (F.col("mu") - std).alias("low"), (F.col("mu") + std).alias("high"))


def shifts(resp_long: DataFrame, site_means: DataFrame, weights: DataFrame) -> DataFrame:
    """k and shift: responsibility-weighted mean of the sites' own means, over n and the component's weight."""
    both = resp_long.join(site_means, "site").groupBy("k").agg(F.sum(F.col("r") * F.col("m")).alias("s"), F.count("*").alias("n"))
    return both.join(weights, "k").select("k", (F.col("s") / (F.col("n") * F.nullif(F.col("w"), F.lit(0.0)))).alias("shift"))


def grid(labels: DataFrame, sizes: list[int], offset: int = 1, kept: DataFrame | None = None) -> DataFrame:
    """Coordinates and value: label + offset, 0 where there is none, 1 for kept sites without a label (if kept is given)."""
    n = 1
    for s in sizes:
        n *= s
    sites = labels.sparkSession.range(n).withColumnRenamed("id", "site").join(labels, "site", "left")
    value = F.coalesce(F.col("label") + offset, F.lit(0))
    if kept is not None:
        sites = sites.join(kept.select("site", F.lit(1).alias("one")), "site", "left")
        value = F.coalesce(F.col("label") + offset, F.col("one"), F.lit(0))
    return with_coords(sites.withColumn("value", value.cast("int")), sizes).select(*coords(len(sizes)), "value")


def slice_of(view: DataFrame, sizes: list[int], axis: int | None = None, index: int | None = None) -> DataFrame:
    """A plane of a grid of rank 3; a grid of rank 2 is its own plane."""
    if len(sizes) == 3:
        if axis is None or index is None:
            raise ValueError("a grid of rank 3 needs an axis and an index")
        return view.where(F.col(f"c{axis}") == index).drop(f"c{axis}")
    return view


def zoom(plane: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """The window [r0, r1) x [c0, c1) of a plane."""
    if rows[0] >= rows[1] or cols[0] >= cols[1]:
        raise ValueError("a window needs start < stop")
    r, c = [x for x in plane.columns if x != "value"]
    return plane.where(F.col(r).between(rows[0], rows[1] - 1) & F.col(c).between(cols[0], cols[1] - 1))


def display_name(axis: str) -> str:
    """`Qh` as `H`; other names as they are."""
    return axis[1:].upper() if len(axis) == 2 and axis[0] in "qQ" else axis


def plane_axes(axis: DataFrame, names: list[str], cut: int, value: float) -> DataFrame:
    """role (x, y, cut), name, low and high of a plane's picture: extent and labels; the title's value is that of the cut axis."""
    if cut not in (0, 1, 2) or len(names) != 3:
        raise ValueError("a plane is cut from three axes at axis 0, 1 or 2")
    y, x = [n for k, n in enumerate(names) if k != cut]
    roles = F.create_map(*[F.lit(v) for kv in {x: "x", y: "y", names[cut]: "cut"}.items() for v in kv])
    shown = F.create_map(*[F.lit(v) for n in names for v in (n, display_name(n))])
    ends = axis.where(F.col("name").isin(names)).groupBy("name").agg(F.min_by("value", "pos").alias("low"), F.max_by("value", "pos").alias("high"))
    own = F.col("name") == names[cut]
    return ends.select(F.element_at(roles, F.col("name")).alias("role"), F.element_at(shown, F.col("name")).alias("name"), F.when(own, value).otherwise(F.col("low")).alias("low"), F.when(own, value).otherwise(F.col("high")).alias("high"))


def clusters_in_space(labels: DataFrame, variance: DataFrame, sizes: list[int]) -> DataFrame:
    """site, share of each axis and group: 0 for sites of low variance, label + 1 for clustered sites of high variance."""
    low = variance.where(~F.col("high")).select("site", F.lit(0).alias("group"))
    high = variance.where("high").select("site").join(labels, "site").select("site", (F.col("label") + 1).alias("group"))
    return unit_coordinates(low.unionByName(high), sizes, "group")


def unit_coordinates(sites: DataFrame, sizes: list[int], *others: str) -> DataFrame:
    """Coordinates of sites as shares of each axis, for drawings in space, beside other columns."""
    placed = with_coords(sites, sizes)
    return placed.select("site", *others, *[(F.col(c) / max(1, n - 1)).alias(f"u{k}") for k, (c, n) in enumerate(zip(coords(len(sizes)), sizes, strict=True))])

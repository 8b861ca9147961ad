"""Long intensity cubes: one row per cell (c0, c1, [c2], site, t, v), dense, with site in row-major order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def coords(rank: int) -> list[str]:
    return [f"c{k}" for k in range(rank)]


def site_of(sizes: list[int]):
    """Row-major site number of the coordinates."""
    out = F.lit(0).cast("long")
    for c, n in zip(coords(len(sizes)), sizes, strict=True):
        out = out * n + F.col(c)
    return out


def with_coords(df: DataFrame, sizes: list[int]) -> DataFrame:
    """The coordinates of `site`, as ints."""
    below = 1
    out = df
    for c, n in reversed(list(zip(coords(len(sizes)), sizes, strict=True))):
        out = out.withColumn(c, ((F.col("site") / F.lit(below)).cast("long") % n).cast("int") if below > 1 else (F.col("site") % n).cast("int"))
        below *= n
    return out


def densify(facts: DataFrame, sizes: list[int], n_t: int) -> DataFrame:
    """Every cell of the grid; cells without facts are 0, since averages divide by all positions of the axis.

    Facts are summed per cell before the join, which is an equality join on the cell number.
    """
    n_sites = 1
    for n in sizes:
        n_sites *= n
    cells = facts.groupBy((site_of(sizes) * n_t + F.col("t")).alias("cell")).agg(F.sum("v").alias("v"))
    grid = facts.sparkSession.range(n_sites * n_t).withColumnRenamed("id", "cell")
    full = grid.join(cells, "cell", "left").select(F.expr(f"cell div {n_t}").alias("site"), (F.col("cell") % n_t).cast("int").alias("t"), F.coalesce(F.col("v"), F.lit(0.0)).cast("double").alias("v"))
    return with_coords(full, sizes).select(*coords(len(sizes)), "site", "t", "v")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PLANTED = [50, 50]
YEARS = 7


def _year(col: str):
    return (F.year(col) - 1995).cast("int")


def raw_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly quantity over part and supplier classes (50 x 50 sites, 7 years)."""
    line = table(spark, sf_dir, "lineitem")
    facts = line.select((F.col("l_partkey") % 50).cast("int").alias("c0"), (F.col("l_suppkey") % 50).cast("int").alias("c1"), _year("l_shipdate").alias("t"), F.col("l_quantity").alias("v"))
    return densify(facts, PLANTED, YEARS)


def planted_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw cube with 25 bright 3 x 3 blocks whose intensity falls, rises or stays with t."""
    a, b, t = F.col("c0"), F.col("c1"), F.col("t")
    group = (F.expr("c0 div 10") + F.expr("c1 div 10")) % 3
    factor = F.when((a % 10 < 3) & (b % 10 < 3), F.when(group == 0, 40 - 5 * t).when(group == 1, 10 + 4 * t).otherwise(20)).otherwise(1)
    return raw_cube(spark, sf_dir).withColumn("v", F.col("v") * factor)


SOLID = [7, 20, 20]


def solid_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cube of rank 3: line number, part class, supplier class."""
    line = table(spark, sf_dir, "lineitem")
    facts = line.select((F.col("l_linenumber") % 7).cast("int").alias("c0"), (F.col("l_partkey") % 20).cast("int").alias("c1"), (F.col("l_suppkey") % 20).cast("int").alias("c2"), _year("l_shipdate").alias("t"), F.col("l_quantity").alias("v"))
    return densify(facts, SOLID, YEARS)


def axis_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """axis(name, pos, value) of the planted cube: the years met for t; tenths of the residues met for c0 and c1, so that a unit cell has 10 positions."""
    line = table(spark, sf_dir, "lineitem")
    years = line.select(_year("l_shipdate").alias("pos")).distinct().select(F.lit("t").alias("name"), "pos", (F.col("pos") + 1995).cast("double").alias("value"))
    residues = line.select((F.col("l_partkey") % 50).cast("int").alias("pos")).distinct().select(F.explode(F.array(F.lit("c0"), F.lit("c1"))).alias("name"), "pos", (F.col("pos") / 10).alias("value"))
    return years.unionByName(residues)


def shape(axis: DataFrame) -> dict[str, int]:
    """Positions of each axis: a row an axis."""
    return {r["name"]: r["n"] for r in axis.groupBy("name").agg((F.max("pos") + 1).alias("n")).collect()}


#: Cells within a cube of so many positions (as a power of two) a side lie together; so many bits an axis order these cubes.
NEAR_BITS, CURVE_BITS = 3, 12


def curve(names: list[str]) -> Column:
    """Place on a Z-order curve: the bits of the axes' positions in turn."""
    out = F.lit(0).cast("long")
    for bit in range(CURVE_BITS):
        for k, c in enumerate(names):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(F.col(c).cast("long"), bit + NEAR_BITS).bitwiseAND(F.lit(1)), bit * len(names) + k))
    return out


def axes_of(cube: DataFrame) -> list[str]:
    return ["t", *[c for c in ("c0", "c1", "c2") if c in cube.columns]]


def save_cube(cube: DataFrame, axis: DataFrame, path: str, entry: str, files: int | None = None) -> None:
    """A cube and its axes as Parquet under path/entry, in the layout that `load_cube` reads.

    Cells are written along a space-filling curve, so that a file is a block of near positions; a small table keeps each block's bounds.
    """
    spark, names = cube.sparkSession, axes_of(cube)
    placed = cube.withColumn("_z", curve(names))
    spread = placed.repartitionByRange(files, "_z") if files else placed.repartitionByRange("_z")
    spread.sortWithinPartitions("_z").drop("_z").write.mode("overwrite").parquet(f"{path}/{entry}/cells")
    axis.write.mode("overwrite").parquet(f"{path}/{entry}/axes")
    bounds = [f(c).alias(f"{n}_{c}") for c in names for n, f in (("low", F.min), ("high", F.max))]
    stored = spark.read.parquet(f"{path}/{entry}/cells").groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")).agg(*bounds)
    stored.coalesce(1).write.mode("overwrite").parquet(f"{path}/{entry}/blocks")


def load_cube(spark: SparkSession, path: str, entry: str = "entry/data", slices: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Cells and axes of any cube stored under path/entry, cut to text slices such as `:,0:1,-10:10` over t and the coordinates in order.

    Only the files whose blocks overlap the slices are opened.
    """
    cube, axis = spark.read.parquet(f"{path}/{entry}/cells"), spark.read.parquet(f"{path}/{entry}/axes")
    if not slices:
        return cube, axis
    wanted = parse_slices(slices, axes_of(cube))
    blocks = spark.read.parquet(f"{path}/{entry}/blocks")
    for name, (first, last) in positions(axis, wanted).items():
        blocks = blocks.where(F.lit(False) if first is None else (F.col(f"high_{name}") >= first) & (F.col(f"low_{name}") <= last))
    found = [f"{path}/{entry}/cells/{r['file']}" for r in blocks.select("file").collect()]  # a row a file
    return sliced(spark.read.schema(cube.schema).parquet(*found) if found else cube.limit(0), axis, wanted), axis


def from_arrays(arrays: DataFrame, width: int) -> DataFrame:
    """A long cube of rank 2 from one array of values for each t (columns t and values, row by row, `width` values a row)."""
    cells = arrays.select("t", F.posexplode("values").alias("site", "v"))
    site = F.col("site").cast("long")
    return cells.select((site / width).cast("int").alias("c0"), (site % width).cast("int").alias("c1"), site.alias("site"), "t", F.col("v").cast("double").alias("v"))


def synthetic_cube(spark: SparkSession, sizes: list[int], n_t: int, zero_rows: int = 0, seed: int = 0) -> DataFrame:
    """Uniform random values on a grid, 0 in the first zero_rows rows: for trying things out."""
    n = 1
    for x in sizes:
        n *= x
    cells = spark.range(n * n_t).select(F.expr(f"id div {n_t}").alias("site"), (F.col("id") % n_t).cast("int").alias("t"), F.rand(seed).alias("v"))
    full = with_coords(cells, sizes)
    return full.select(*coords(len(sizes)), "site", "t", F.when(F.col("c0") < zero_rows, 0.0).otherwise(F.col("v")).alias("v"))


def positions(axis: DataFrame, slices: dict[str, tuple[float | None, float | None]]) -> dict[str, tuple[int | None, int | None]]:
    """First and last position of each axis whose value lies in the closed range; nothing in it gives no positions."""
    out = {}
    for name, (low, high) in slices.items():
        at = axis.where((F.col("name") == name) & F.col("value").between(F.lit(float("-inf") if low is None else low), F.lit(float("inf") if high is None else high)))
        out[name] = tuple(at.agg(F.min("pos"), F.max("pos")).first())
    return out


def sliced(cube: DataFrame, axis: DataFrame, slices: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Cells whose axis values lie in the closed ranges; an open end is None. The axis is a small dimension table.

    Positions are looked up first and pushed to the scan as plain ranges of the coordinate columns.
    """
    out = cube
    for name, (first, last) in positions(axis, slices).items():
        out = out.where(F.lit(False) if first is None else F.col(name).between(first, last))
    return out


def nearest_position(values: DataFrame, axis: DataFrame, name: str) -> DataFrame:
    """For each row of `values` (column value) the axis position with that value, or the nearest (the first on ties).

    The axis comes as one sorted array (its length is the number of positions), so nothing is paired or shuffled.
    """
    line = [(r["pos"], r["value"]) for r in axis.where(F.col("name") == name).orderBy("pos").collect()]
    known = F.array(*[F.struct(F.lit(p).alias("pos"), F.lit(v).alias("at")) for p, v in line])
    nearest = F.array_min(F.transform(known, lambda x: F.struct(F.abs(x["at"] - F.col("value")).alias("gap"), x["pos"].alias("pos"), x["at"].alias("at"))))
    return values.withColumn("n", nearest).select("*", F.col("n.pos").alias("pos"), F.col("n.at").alias("axis_value"), (F.col("n.gap") == 0).alias("exact")).drop("n")


def parse_slices(text: str, names: list[str]) -> dict[str, tuple[float | None, float | None]]:
    """`:,0:1,-10:` and the like, one part per axis; a single number is a range of one value."""
    out = {}
    for name, part in zip(names, text.split(","), strict=False):
        part = part.strip()
        if part in (":", ""):
            continue
        low, colon, high = part.partition(":")
        ends = (float(low) if low.strip() else None, float(high) if high.strip() else None) if colon else (float(low), float(low))
        out[name] = ends
    return out


def parse_ints(text: str | None) -> list[int] | None:
    """`0,1,3` as numbers; None stays None."""
    return None if text is None else [int(x) for x in text.split(",") if x.strip()]


def parse_window(text: str | None) -> tuple[tuple[int, int], tuple[int, int]] | None:
    """`r0:r1,c0:c1` as two ranges; each start must be below its stop."""
    if text is None:
        return None
    try:
        rows, cols = (tuple(int(x) for x in part.split(":")) for part in text.split(","))
        (r0, r1), (c0, c1) = rows, cols
    except ValueError:
        raise ValueError(f"a window looks like r0:r1,c0:c1, not {text!r}") from None
    if r0 >= r1 or c0 >= c1:
        raise ValueError(f"a window needs start < stop: {text!r}")
    return (r0, r1), (c0, c1)


def pack(cube: DataFrame) -> DataFrame:
    """site and y, its values in order of t: the layout of iterated fits."""
    return cube.groupBy("site").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "v"))), lambda r: r["v"]).alias("y"))


def unpack(packed: DataFrame) -> DataFrame:
    return packed.select("site", F.posexplode("y").alias("t", "v"))


def pack_facts(facts: DataFrame, sizes: list[int], n_t: int) -> DataFrame:
    """site and y straight from facts (coordinates, t, v), for the sites that have any; positions without facts are 0.

    One exchange: facts are summed by site and t as they are read, then a site's few sums become its array.
    """
    sums = facts.groupBy(site_of(sizes).alias("site"), "t").agg(F.sum("v").cast("double").alias("v"))
    found = sums.groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("t", "v"))).alias("m"))
    return found.select("site", F.transform(F.sequence(F.lit(0), F.lit(n_t - 1)), lambda t: F.coalesce(F.element_at("m", t), F.lit(0.0))).alias("y"))


LINES = 7


def order_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed yearly quantities of every part by line number: a cube whose sites grow with the data (7 for each part)."""
    line = table(spark, sf_dir, "lineitem")
    facts = line.select(F.col("l_partkey").alias("c0"), (F.col("l_linenumber") % LINES).cast("int").alias("c1"), _year("l_shipdate").alias("t"), F.col("l_quantity").alias("v"))
    return pack_facts(facts, [0, LINES], YEARS)


BLOCK = 20


def field_cube(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[int]]:
    """Packed quantities by line number on a grid of part blocks and weeks, and the grid's sizes: sites and rows of the grid grow with the data."""
    line = table(spark, sf_dir, "lineitem")
    week = F.expr("datediff(l_shipdate, DATE '1995-01-01') div 7").cast("int")
    facts = line.select(F.expr(f"cast(l_partkey div {BLOCK} as int)").alias("c0"), week.alias("c1"), (F.col("l_linenumber") % LINES).cast("int").alias("t"), F.col("l_quantity").alias("v"))
    sizes = [n + 1 for n in facts.agg(F.max("c0"), F.max("c1")).first()]
    return pack_facts(facts, sizes, LINES), sizes


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed trajectories from the embedding table."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("site"), F.col("embedding").cast("array<double>").alias("y"))

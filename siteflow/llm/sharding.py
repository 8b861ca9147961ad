"""Size-balanced shards by sampled splitters.

A size-weighted sample of keys gives quantile boundaries of many narrow ranges; each range knows its bytes, so every
row has a place on one line from 0 to all bytes, and shard k takes the k-th equal stretch. Keys are (hash of the text,
doc_id, row): copies of a text lie side by side and share a shard, unless a range is overfull because one group of
copies fills it; then the splitters also cut by doc_id, and rows equal in both by the row's own number, and its rows are
placed one by one.

The number of ranges grows with the bytes, so that one range is about RANGE_BYTES however large the table is, up to MOST_RANGES
(16 TB of such ranges; beyond that they widen). The driver sees about per_range sampled rows a range, each of equal rows on its own.

Nulls: a null text has the overhead as its size and the checksum 0; a null doc_id sorts first. Equal rows are
interchangeable. An empty table gives no rows. Other columns are ignored, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteflow.llm.common import written

LAW = "bytes"
OVERHEAD = 8
LEAST = -(2**63)
RANGE_BYTES = 256 * 2**20
MOST_RANGES = 65_536


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, and (h, d, r): hash of the text, doc_id without nulls, number of the row. The text itself goes no further."""
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("d"),
        F.monotonically_increasing_id().alias("r"),
    )


KEY = ["h", "d", "r"]


def splitters(keys: DataFrame, total: int, ranges: int, per_range: int) -> pd.DataFrame:
    """Weighted quantiles (h, d, r) of a sample of about ranges * per_range rows, drawn row by row in proportion to size.

    A hash met by one quantile opens its range whole (d and r are the least); one that fills several ranges is cut by doc_id, and a
    doc_id that does so by row.
    """
    wanted = ranges * per_range
    chance = F.least(F.lit(1.0), F.col("size") * F.lit(wanted / max(total, 1)))
    draw = F.pmod(F.xxhash64(*KEY, F.lit(17)), F.lit(2**31)) / F.lit(float(2**31))
    sample = keys.where(draw < chance).select(*KEY, (F.col("size") / chance).alias("weight")).toPandas()
    if sample.empty:
        return pd.DataFrame({k: np.zeros(0, np.int64) for k in KEY})
    sample = sample.sort_values(KEY, ignore_index=True)
    line = sample["weight"].cumsum().to_numpy()
    at = np.unique(np.searchsorted(line, line[-1] * np.arange(1, ranges) / ranges).clip(max=len(sample) - 1))
    cuts = sample.loc[at, KEY]
    # Quantiles that share a hash cut it by doc_id; those that share both cut by row. Each such group begins a range of its own.
    many_h, many_d = cuts.duplicated("h", keep=False), cuts.duplicated(["h", "d"], keep=False)
    cuts.loc[~many_d, "r"] = LEAST
    cuts.loc[~many_h, "d"] = LEAST
    return pd.concat([cuts, cuts[many_h].assign(d=LEAST, r=LEAST), cuts[many_d].assign(r=LEAST)]).drop_duplicates().sort_values(KEY, ignore_index=True)


def _range_of(cuts: pd.DataFrame):
    """How many splitters lie at or below a key."""
    columns = [cuts[k].to_numpy() for k in KEY]

    def below(low: int, high: int, values: list[np.ndarray], depth: int) -> np.ndarray:
        """Splitters at or below each key among those from low to high, which agree with the keys in the first columns."""
        ours = columns[depth][low:high]
        out = low + np.searchsorted(ours, values[depth], "right")
        if depth + 1 == len(KEY):
            return out
        first = low + np.searchsorted(ours, values[depth], "left")
        for start in np.unique(first[out > first]).tolist():  # one turn for each value that is cut further
            same = np.flatnonzero((first == start) & (out > first))
            out[same] = below(start, int(out[same[0]]), [v[same] for v in values], depth + 1)
        return out

    @F.pandas_udf("int")
    def find(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(below(0, len(columns[0]), [p.to_numpy() for p in part], 0).astype(np.int32))

    return find


def shard(docs: DataFrame, n_shards: int = 24, *, ranges_per_shard: int = 32, sample_per_range: int = 16, whole_share: float = 0.01, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    Law `bytes`: the shards' sizes differ by about one row, or by one group of copies that is kept whole (at most
    whole_share of a shard). slot counts from 0 in each shard. The driver sees one splitter and one sum a range; there are
    ranges_per_shard * n_shards ranges, or more where those would hold over range_bytes each.
    """
    spark = docs.sparkSession
    keys = written(keyed(docs), "keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    ranges = max(n_shards * ranges_per_shard, min(MOST_RANGES, -(-total // range_bytes)))
    cuts = splitters(keys, total, ranges, sample_per_range)
    ranged = keys.withColumn("part", _range_of(cuts)(*[F.col(k) for k in KEY]))

    sums = {r["part"]: r["b"] for r in ranged.groupBy("part").agg(F.sum("size").alias("b")).collect()}
    starts, at = [], 0
    for part in range(len(cuts) + 1):
        starts.append((part, at, sums.get(part, 0)))
        at += sums.get(part, 0)
    line = F.broadcast(spark.createDataFrame(starts, "part int, part_start long, part_bytes long"))  # as many rows as ranges

    stretch = max(total, 1) / n_shards
    in_part = Window.partitionBy("part").orderBy("h")
    copies = Window.partitionBy("part", "h")
    one_by_one = Window.partitionBy("part").orderBy(*KEY).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        ranged.withColumn("group_bytes", F.sum("size").over(copies))
        .withColumn("group_end", F.sum("size").over(in_part))
        .withColumn("row_end", F.sum("size").over(one_by_one))
        .join(line, "part")
    )
    whole = F.col("group_bytes") <= F.lit(whole_share * stretch)
    middle = F.col("part_start") + F.when(whole, F.col("group_end") - F.col("group_bytes") / 2.0).otherwise(F.col("row_end") - F.col("size") / 2.0)
    placed = placed.withColumn("shard", F.least(F.lit(n_shards - 1), F.floor(middle / F.lit(stretch)).cast("int")))
    in_shard = Window.partitionBy("part", "shard").orderBy(*KEY)
    placed = written(placed.select("doc_id", "size", "text_crc32", "part", "shard", (F.row_number().over(in_shard) - 1).cast("long").alias("rank")), "placed")

    counts = placed.groupBy("part", "shard").count().collect()  # at most ranges + shards rows
    offsets, seen = [], {}
    for r in sorted(counts, key=lambda r: (r["shard"], r["part"])):
        offsets.append((r["part"], r["shard"], seen.get(r["shard"], 0)))
        seen[r["shard"]] = seen.get(r["shard"], 0) + r["count"]
    before = F.broadcast(spark.createDataFrame(offsets, "part int, shard int, before long"))
    return placed.join(before, ["part", "shard"]).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("before") + F.col("rank")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )

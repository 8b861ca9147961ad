"""Small helpers that the text operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteflow.functions.lineage import shared_folder

#: Word characters: everything but the space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str = "cut") -> DataFrame:
    """df, written once as Parquet in the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._folder = path
    if _MADE:
        _MADE[-1].append(back)
    return back


#: Tables written within the steps under way, innermost last.
_MADE: list[list[DataFrame]] = []


def step(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """make()'s rows, written; tables that make() wrote on its way, and that nothing reads any more then, are deleted."""
    _MADE.append([])
    try:
        out = written(make(), name)
    finally:
        inner = _MADE.pop()
    discard(*(t for t in inner if t is not out))
    if _MADE:
        _MADE[-1].append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the folders of written tables that no later step reads."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def words(text: Column) -> Column:
    """Array of the words of a text; null text has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def lower_ascii(text: Column) -> Column:
    """Lower-case A to Z only, so that results do not depend on Unicode tables."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

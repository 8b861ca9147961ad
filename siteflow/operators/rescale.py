"""Rescaling of each site's values over the axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def over_site(value):
    return value.over(Window.partitionBy("site"))


def by_mean(cube: DataFrame) -> DataFrame:
    """v over the site's mean, less one; null where the mean is 0."""
    mean = over_site(F.sum("v")) / over_site(F.count("*"))
    return cube.withColumn("v", F.col("v") / F.nullif(mean, F.lit(0.0)) - 1)


def by_zscore(cube: DataFrame) -> DataFrame:
    """Distance from the site's mean in population deviations; null where the deviation is 0."""
    return cube.withColumn("v", (F.col("v") - over_site(F.avg("v"))) / F.nullif(over_site(F.stddev_pop("v")), F.lit(0.0)))


def by_log_mean(cube: DataFrame) -> DataFrame:
    """log(1 + v) less its mean over the site."""
    return cube.withColumn("v", F.log1p("v") - over_site(F.avg(F.log1p("v"))))


METHODS = {"mean": by_mean, "z-score": by_zscore, "log-mean": by_log_mean, "None": lambda cube: cube}


def rescale(cube: DataFrame, method: str = "mean") -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"rescale must be one of {sorted(METHODS)}")
    return METHODS[method](cube)


def _average(y: Column) -> Column:
    return F.aggregate(y, F.lit(0.0), lambda a, v: a + v) / F.size(y)


def rescale_packed(packed: DataFrame, method: str = "mean") -> DataFrame:
    """The same on packed trajectories (site, y), row by row."""
    if method not in METHODS:
        raise ValueError(f"rescale must be one of {sorted(METHODS)}")
    if method == "None":
        return packed
    y = F.transform("y", F.log1p) if method == "log-mean" else F.col("y")
    noted = packed.select("site", y.alias("y"), _average(y).alias("m"))
    if method == "mean":
        new = F.transform("y", lambda v: v / F.nullif(F.col("m"), F.lit(0.0)) - 1)
    elif method == "log-mean":
        new = F.transform("y", lambda v: v - F.col("m"))
    else:
        noted = noted.select("site", "y", "m", F.sqrt(_average(F.transform("y", lambda v: (v - F.col("m")) * (v - F.col("m"))))).alias("std"))
        new = F.transform("y", lambda v: (v - F.col("m")) / F.nullif(F.col("std"), F.lit(0.0)))
    return noted.select("site", new.alias("y"))

"""Masks over sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPES = ("zero_mean", "any_zeros")


def site_mask(cube: DataFrame, mask_type: str = "zero_mean", check_nan: bool = False) -> DataFrame:
    """site and kept. `zero_mean` keeps sites with a positive mean, `any_zeros` those without a value at or below 0."""
    if mask_type not in TYPES:
        raise ValueError(f"mask_type must be one of {TYPES}")
    # NaN compares as the greatest value here; a site with NaN stays unless check_nan.
    keep = ~(F.sum("v") / F.count("*") <= 0) if mask_type == "zero_mean" else ~F.bool_or(F.col("v") <= 0)
    if check_nan:
        keep = keep & ~F.bool_or(F.isnan("v"))
    return cube.groupBy("site").agg(keep.alias("kept"))


def split(cube: DataFrame, mask: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cells of kept sites and of the others."""
    kept = mask.where("kept").select("site")
    return cube.join(kept, "site", "left_semi"), cube.join(kept, "site", "left_anti")


def keep_packed(packed: DataFrame, mask_type: str = "zero_mean", check_nan: bool = False) -> DataFrame:
    """The sites of a packed cube that the mask keeps: a filter, without an exchange."""
    if mask_type not in TYPES:
        raise ValueError(f"mask_type must be one of {TYPES}")
    total = F.aggregate("y", F.lit(0.0), lambda a, v: a + v)
    keep = ~(total / F.size("y") <= 0) if mask_type == "zero_mean" else ~F.exists("y", lambda v: v <= 0)
    return packed.where(keep & ~F.exists("y", F.isnan) if check_nan else keep)

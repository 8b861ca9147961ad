"""Choosing and ordering clusters: information criterion, sweeps, recommendation, deterministic order."""

from __future__ import annotations

import json
import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteflow.operators.gmm import Config, Params, fit, fit_many, held, init_means, start


def parameter_count(k: int, n_t: int, cov_type: str = "diag") -> int:
    if cov_type not in ("diag", "full"):
        raise ValueError("cov_type must be 'diag' or 'full'")
    cov = k * n_t if cov_type == "diag" else k * n_t * (n_t + 1) // 2
    return cov + k * n_t + k - 1


def bic(ll: float, k: int, n_t: int, n: int, cov_type: str = "diag") -> float:
    return -2 * ll + parameter_count(k, n_t, cov_type) * math.log(n)


def sweep(packed: DataFrame, k_min: int, k_max: int, base: Config | None = None, parallel: int = 4) -> DataFrame:
    """k, ll, bic for k_min up to, but without, k_max.

    Batch fits advance together, one scan an epoch for all that have not converged; draws of fewer means are the first of those of
    more, so one start serves all. Other solvers fit one by one, a few at a time, over one cached table.
    """
    base = base or Config()
    packed = held(packed)
    n_t = len(packed.select("y").first()["y"])
    ks = range(k_min, k_max)

    def one(k: int) -> tuple[int, float, float]:
        found = fit(packed, replace(base, k=k, means=None if base.means is None else base.means[:k]))
        return k, found.ll, bic(found.ll, k, n_t, found.n, base.cov_type)

    if base.solver == "batch" and not base.refine_epochs and base.init in ("kmeans++", "gaussian") and ks:
        means = base.means if base.means is not None else init_means(packed, ks[-1], base.init, base.seed)
        whole = start(packed, means, base.cov_type, base.reg)
        starts = [Params(np.full(len(means[:k]), 1 / len(means[:k])), whole.means[:k], whole.covs[:k]) for k in ks]
        n = packed.count()
        rows = [(k, h[-1], bic(h[-1], k, n_t, n, base.cov_type)) for k, (_, h, _) in zip(ks, fit_many(packed, starts, base), strict=True)]
    else:
        with ThreadPoolExecutor(parallel) as pool:
            rows = list(pool.map(one, ks))
    packed.unpersist()
    return packed.sparkSession.createDataFrame(rows, "k int, ll double, bic double")


def best_k(table: DataFrame) -> DataFrame:
    """The row of the smallest criterion, the smallest k on ties."""
    return table.orderBy("bic", "k").limit(1)


def recommend(bic_d: float | None, bic_s: float | None) -> str:
    """`d` unless the peaks' criterion is smaller; a missing mode gives way."""
    if bic_d is None and bic_s is None:
        raise RuntimeError("no mode has a criterion")
    return "s" if bic_d is None or (bic_s is not None and bic_s < bic_d) else "d"


def reorder_map(cube: DataFrame, labels: DataFrame, k: int, n_t: int) -> DataFrame:
    """label and new_label: by mean intensity over the lowest tenth of the axis, brightest first, empty clusters last."""
    low = max(1, int(0.1 * n_t))
    means = cube.where(F.col("t") < low).join(labels, "site").groupBy("label").agg((F.sum("v") / F.count("*")).alias("level"))
    every = cube.sparkSession.range(k).select(F.col("id").cast("int").alias("label")).join(means, "label", "left")
    rank = F.row_number().over(Window.orderBy(F.col("level").desc_nulls_last(), "label")) - 1  # k rows
    return every.select("label", rank.cast("int").alias("new_label"))


def relabel(labels: DataFrame, mapping: DataFrame) -> DataFrame:
    return labels.join(F.broadcast(mapping), "label").select("site", F.col("new_label").alias("label"))  # a row a cluster


def second_pass(labels: DataFrame, *, keep: int | None = None, drop: list[int] | None = None, discovery: int | None = None) -> DataFrame:
    """site: one label kept, else a set dropped, else the discovery cluster alone."""
    if keep is not None:
        out = labels.where(F.col("label") == keep)
    elif drop:
        out = labels.where(~F.col("label").isin(drop))
    else:
        out = labels.where(F.col("label") == discovery)
    if out.isEmpty():
        raise RuntimeError("the second pass has no sites")
    return out.select("site")


def report(spark: SparkSession, settings: dict, table: DataFrame, choice: dict) -> DataFrame:
    """One row of JSON with settings, sweep and choice.

    Numbers are the shortest decimals that read back, without an exponent below 1e16, which Spark's own JSON has from 1e7 on.
    """
    plain = lambda v: str(v) if isinstance(v, float) and not math.isfinite(v) else v
    text = lambda x: json.dumps(x, separators=(",", ":"), ensure_ascii=False)
    sweep = [{c: plain(r[c]) for c in ("k", "ll", "bic")} for r in table.orderBy("k", "ll", "bic").collect()]  # a row a k
    row = (text({k: str(v) for k, v in settings.items()}), text(sweep), text({k: str(v) for k, v in choice.items()}))
    return spark.createDataFrame([row], "settings string, sweep string, choice string")

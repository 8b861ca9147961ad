"""End-to-end jobs: direct and peak clustering, two passes, smoothing, sweeps with a recommendation; and their sinks."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteflow.operators import edges, gmm, mask, peaks, rescale, select, threshold, views
from siteflow.sources import cube as src


@dataclass
class Result:
    labels: DataFrame  # site, label
    fit: gmm.Fit
    packed: DataFrame  # site, y: rescaled trajectories
    pixels: DataFrame  # site, label of every clustered site of the grid
    cutoff: threshold.Cutoff
    settings: dict = field(default_factory=dict)


def prepared(cube: DataFrame, *, kind: str = "KL", mask_type: str = "zero_mean", check_nan: bool = False, **options) -> tuple[DataFrame, threshold.Cutoff]:
    """site and y (raw values) of the sites above the background, cached, and the cutoff.

    The long cube is packed once; mask, log mean and cutoff are filters over the packed rows.
    """
    x = threshold.log_mean_packed(mask.keep_packed(src.pack(cube), mask_type, check_nan)).cache()
    cut = threshold.cutoff(x, kind, **options)
    kept = gmm.held(threshold.above_packed(x, cut))
    x.unpersist()
    return kept, cut


def _ordered(cube: DataFrame, found: gmm.Fit, labels: DataFrame, n_t: int, reorder: bool) -> tuple[gmm.Fit, DataFrame]:
    """Labels, parameters and responsibilities, all in the deterministic order."""
    if not reorder:
        return found, labels
    mapping = select.reorder_map(cube, labels, found.params.k, n_t)
    new = {r["label"]: r["new_label"] for r in mapping.collect()}  # a row a cluster
    order = sorted(new, key=new.get)
    resp = found.resp.select("site", F.array(*[F.col("r")[k] for k in order]).alias("r"))
    return replace(found, params=gmm.relabelled(found.params, order), resp=resp), select.relabel(labels, mapping)


Ready = tuple[DataFrame, threshold.Cutoff]


def direct(cube: DataFrame, n_t: int, config: gmm.Config, *, kind: str = "KL", method: str = "mean", reorder: bool = True, ready: Ready | None = None, epochs: str | None = None) -> Result:
    """Cluster every site above the background. ready: what `prepared` gave for this cube, where it is at hand.

    epochs: a shared folder that keeps the fit's epochs; the same job, started again after its driver was lost, goes on from there.
    """
    kept, cut = ready or prepared(cube, kind=kind)
    packed = rescale.rescale_packed(kept, method).cache()
    found = gmm.fit(packed, config, log=gmm.EpochLog(cube.sparkSession, epochs) if epochs else None)
    found, labels = _ordered(src.unpack(kept), found, found.labels(), n_t, reorder)
    return Result(labels, found, packed, labels, cut, {"mode": "d", "k": config.k, "rescale": method, "threshold": kind})


def peak_means(kept: DataFrame, sizes: list[int]) -> tuple[DataFrame, DataFrame]:
    """site and peak of the kept sites, and the peaks' mean trajectories, packed by peak."""
    members = peaks.label(kept.select("site"), sizes)
    means = peaks.trajectories_packed(kept, members).select(F.col("peak").alias("site"), "t", F.col("v_mean").alias("v"))
    return members, src.pack(means)


def by_peaks(cube: DataFrame, sizes: list[int], n_t: int, config: gmm.Config, *, kind: str = "KL", method: str = "mean", reorder: bool = True, ready: Ready | None = None) -> Result:
    """Cluster the mean trajectories of connected peaks, and give every pixel its peak's label."""
    kept, cut = ready or prepared(cube, kind=kind)
    members, means = peak_means(kept, sizes)
    packed = gmm.held(rescale.rescale_packed(means, method))
    found = gmm.fit(packed, config)
    found, labels = _ordered(src.unpack(means), found, found.labels(), n_t, reorder)
    pixels = peaks.to_pixels(members, labels.withColumnRenamed("site", "peak")).select("site", "label")
    return Result(labels, found, packed, pixels, cut, {"mode": "s", "k": config.k, "rescale": method, "threshold": kind})


def two_pass(cube: DataFrame, n_t: int, first: gmm.Config, second: gmm.Config, *, keep: int | None = None, drop: list[int] | None = None, **options) -> tuple[Result, Result]:
    """Cluster, choose sites (a label kept, labels dropped, or the discovery cluster), and cluster their first-pass trajectories again."""
    one = direct(cube, n_t, first, reorder=False, **options)
    counts = {r["label"]: r["n"] for r in gmm.sizes(one.labels, one.fit.params.k).collect()}
    chosen = select.second_pass(one.labels, keep=keep, drop=drop, discovery=gmm.discovery(one.fit.params, counts))
    packed = gmm.held(one.packed.join(chosen, "site", "left_semi"))
    found = gmm.fit(packed, second)
    labels = found.labels()
    return one, Result(labels, found, packed, labels, one.cutoff, {**one.settings, "pass": 2, "k": second.k})


def smoothed(
    cube: DataFrame, sizes: list[int], n_t: int, config: gmm.Config, *, l_scale: float = 0.05, kernel: str = "local", axis: DataFrame | None = None, kind: str = "KL", method: str = "mean"
) -> Result:
    """Direct clustering whose responsibilities are averaged over other sites.

    The local kernel takes near sites (the default scale reaches none). The periodic one takes sites at like places of their unit
    cells; the cell's size is read from the axes (name, pos, value).
    """
    kept, cut = prepared(cube, kind=kind)
    packed = rescale.rescale_packed(kept, method).cache()
    if kernel == "local":
        smooth = edges.near_smoother(sizes, l_scale, config.smoothing_iterations)
    elif kernel == "periodic":
        if axis is None:
            raise TypeError("the periodic kernel needs the axes")
        names = src.coords(len(sizes))
        cell = {r["name"]: r["size"] for r in edges.unit_cell(axis, names).collect()}  # a row an axis
        smooth = edges.periodic_smoother(sizes, [cell[c] for c in names], l_scale, config.smoothing_iterations)
    else:
        raise ValueError("kernel must be 'local' or 'periodic'")
    found = gmm.fit(packed, config, smooth)
    found, labels = _ordered(src.unpack(kept), found, found.labels(), n_t, True)
    return Result(labels, found, packed, labels, cut, {"mode": "smooth", "k": config.k, "kernel": kernel, "l_scale": l_scale})


def sweep(kept: DataFrame, sizes: list[int], mode: str, k_min: int, k_max: int, config: gmm.Config, method: str = "mean") -> DataFrame:
    """k, ll and bic of one mode, `d` (sites) or `s` (peaks), over prepared sites."""
    if mode not in ("d", "s"):
        raise ValueError("mode must be 'd' or 's'")
    return select.sweep(rescale.rescale_packed(kept if mode == "d" else peak_means(kept, sizes)[1], method), k_min, k_max, config)


def save_sweep(table: DataFrame, out: str) -> None:
    """n_clusters and bic_scores, with the likelihoods, as Parquet."""
    table.select(F.col("k").alias("n_clusters"), F.col("bic").alias("bic_scores"), "ll").coalesce(1).write.mode("overwrite").parquet(f"{out}/bic")


def load_sweep(spark, out: str) -> DataFrame:
    """A saved sweep as k, ll, bic."""
    return load(spark, out, "bic").select(F.col("n_clusters").alias("k"), "ll", F.col("bic_scores").alias("bic"))


def bic_job(cube: DataFrame, sizes: list[int], mode: str, out: str, *, k_min: int = 2, k_max: int = 14, config: gmm.Config | None = None, kind: str = "KL", method: str = "mean") -> DataFrame:
    """Sweep of one mode, saved under out and read back."""
    kept, _ = prepared(cube, kind=kind)
    save_sweep(sweep(kept, sizes, mode, k_min, k_max, config or gmm.Config(), method), out)
    return load_sweep(cube.sparkSession, out)


def workflow(
    cube: DataFrame, sizes: list[int], n_t: int, *, modes: tuple[str, ...] = ("d", "s"), k_min: int = 2, k_max: int = 14, config: gmm.Config | None = None, kind: str = "KL", method: str = "mean", out: str | None = None
) -> tuple[Result, dict]:
    """Sweep both modes over one prepared cube, recommend mode and k, and run the recommendation with the same start. out: where sweeps are saved, by mode."""
    config = config or gmm.Config()
    ready = prepared(cube, kind=kind)
    best: dict[str, tuple[int, float]] = {}
    sweeps: dict[str, list] = {}
    for mode in [m for m in modes if m in ("d", "s")]:
        table = sweep(ready[0], sizes, mode, k_min, k_max, config, method).cache()
        if out is not None:
            save_sweep(table, f"{out}/{mode}")
        sweeps[mode] = [r.asDict() for r in table.orderBy("k").collect()]
        top = select.best_k(table).first()
        best[mode] = (top["k"], top["bic"])
    mode = select.recommend(best.get("d", (0, None))[1], best.get("s", (0, None))[1])
    chosen = replace(config, k=best[mode][0])
    run = direct(cube, n_t, chosen, kind=kind, method=method, ready=ready) if mode == "d" else by_peaks(cube, sizes, n_t, chosen, kind=kind, method=method, ready=ready)
    return run, {"settings": run.settings, "sweeps": sweeps, "mode": mode, "k": best[mode][0]}


def bundle(labels: DataFrame, packed: DataFrame, axis: DataFrame, sizes: list[int]) -> DataFrame:
    """Everything a later step needs of a run in one table: coordinates, label and value of each site at each value of the axis."""
    times = F.broadcast(axis.where("name = 't'").select(F.col("pos").alias("t"), F.col("value").alias("at")))  # one row a position
    cells = src.unpack(packed).join(labels, "site").join(times, "t")
    return src.with_coords(cells, sizes).select("site", *src.coords(len(sizes)), "label", "at", "v")


def save(result: Result, cube: DataFrame, out: str, report: dict | None = None) -> None:
    """One Parquet folder per dataset, the views' tables and a JSON line of provenance."""
    spark = cube.sparkSession
    params = gmm.param_table(spark, result.fit.params)
    for name, df in {
        "cluster_assignments": result.labels, "pixel_assignments": result.pixels, "data_thresholded": result.packed,
        "cluster_means": params.select("k", "t", "mu"), "cluster_covariances": params.select("k", "t", "var"),
        "average_intensity": views.average_intensity(cube, result.pixels), "envelope": views.envelope(params),
    }.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}")
    text = json.dumps(report or {"settings": result.settings, "ll": result.fit.ll, "epochs": result.fit.epochs, "cutoff": result.cutoff.value, "success": result.cutoff.success}, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/report")


def load(spark, out: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{out}/{name}")

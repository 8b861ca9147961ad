"""Registered queries over the supplied tables. `oracles` holds DuckDB SQL for the same rows."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteflow.functions.lineage import shared_folder
from siteflow.jobs import pipeline
from siteflow.operators import edges, gmm, mask, peaks, rescale, select, threshold, views
from siteflow.operators.order_stats import order_statistics
from siteflow.sources import cube as src
from siteflow.streaming import feed

SEEDS = [0, 10, 20]  # sites (0,0), (0,10), (0,20): one of each planted kind
SMOOTH_L = 1.0


def r6(c):
    """Six decimals, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def _raw(spark, sf_dir):
    return src.raw_cube(spark, sf_dir)


def _planted(spark, sf_dir):
    return src.planted_cube(spark, sf_dir)


def _log_means(cube: DataFrame) -> DataFrame:
    """Several passes follow, so the few numbers of a site are kept."""
    return threshold.log_mean_packed(mask.keep_packed(src.pack(cube))).select("site", "x").cache()


def _kept(cube: DataFrame, kind: str = "simple") -> DataFrame:
    x = _log_means(cube)
    return threshold.above(x, threshold.cutoff(x, kind))


def _rescaled(spark, sf_dir, method: str = "mean") -> DataFrame:
    cube = _planted(spark, sf_dir)
    return rescale.rescale(cube.join(_kept(cube), "site", "left_semi"), method)


def _kept_packed(cube: DataFrame) -> DataFrame:
    """Raw trajectories above the simple cutoff: one exchange by site, then filters."""
    x = threshold.log_mean_packed(mask.keep_packed(src.pack(cube))).cache()
    return threshold.above_packed(x, threshold.cutoff(x, "simple"))


def _packed(spark, sf_dir) -> DataFrame:
    return gmm.held(rescale.rescale_packed(_kept_packed(_planted(spark, sf_dir))))


def _seeded(packed: DataFrame) -> np.ndarray:
    rows = {r["site"]: r["y"] for r in packed.where(F.col("site").isin(SEEDS)).collect()}
    return np.array([rows[s] for s in SEEDS if s in rows])


def _start(packed: DataFrame) -> gmm.Params:
    return gmm.start(packed, _seeded(packed))


def _steps(packed: DataFrame, p: gmm.Params, n: int, step=lambda epoch: 1.0, reg: float = 0.0) -> gmm.Params:
    for epoch in range(n):
        p = gmm.m_step(gmm.sums(packed, p), p, step(epoch), reg)
    return p


def _labels(spark, sf_dir) -> tuple[DataFrame, gmm.Params]:
    """Labels of the planted cube after three fixed steps, with the parameters."""
    packed = _packed(spark, sf_dir)
    p = _steps(packed, _start(packed), 3, reg=1e-6)
    return gmm.labels(gmm.responsibilities(packed, p)), p


def _params_out(spark, p: gmm.Params) -> DataFrame:
    return gmm.param_table(spark, p).select("k", "t", r6("w").alias("w"), r6("mu").alias("mu"), r6("var").alias("var"))


# Sources and slices


def cube_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planted(spark, sf_dir).select("c0", "c1", "site", "t", "v")


def cube_solid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.solid_cube(spark, sf_dir)


def cube_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    slices = src.parse_slices("1996:1999,0.3:1.2,:4.0", ["t", "c0", "c1"])
    return src.sliced(_planted(spark, sf_dir), src.axis_table(spark, sf_dir), slices)


def cube_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cube stored with its axes, read back by path, entry and text slices."""
    path = f"{shared_folder(spark)}/cube-{uuid.uuid4().hex}"
    src.save_cube(_planted(spark, sf_dir), src.axis_table(spark, sf_dir), path, "entry/data")
    return src.load_cube(spark, path, "entry/data", "1996:1999,0.3:1.2,:4.0")[0]


def cube_from_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = src.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("t"), F.col("embedding").alias("values"))
    return src.from_arrays(arrays, 8).select("c0", "c1", "site", "t", r6("v").alias("v"))


def nearest_axis_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = src.table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 16).alias("value")).distinct()
    return src.nearest_position(values, src.axis_table(spark, sf_dir), "c0")


# Masks


def mask_zero_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask.site_mask(_raw(spark, sf_dir))


def mask_any_zeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask.site_mask(_raw(spark, sf_dir), "any_zeros")


def mask_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = _raw(spark, sf_dir)
    kept, other = mask.split(cube, mask.site_mask(cube, "any_zeros", check_nan=True))
    return kept.withColumn("kept", F.lit(True)).unionByName(other.withColumn("kept", F.lit(False))).select("site", "t", "v", "kept")


# Background


def log_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = _planted(spark, sf_dir)
    return threshold.log_mean(mask.split(cube, mask.site_mask(cube))[0]).select("site", r6("x").alias("x"))


def fd_bin_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, iqr, width = threshold.bin_width(_log_means(_planted(spark, sf_dir)))
    return spark.createDataFrame([(n, float(iqr), float(width))], "n long, iqr double, width double").select("n", r6("iqr").alias("iqr"), r6("width").alias("width"))


def histogram_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, bins = threshold.binned(_log_means(_planted(spark, sf_dir)))
    return threshold.density(h, bins).select("bin", r6("left_edge").alias("left_edge"), "n", r6("density").alias("density"))


def kl_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, bins = threshold.binned(_log_means(_planted(spark, sf_dir)))
    return threshold.divergence(h, bins).select("i", F.round("kl", 5).alias("kl"))


def kl_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(_planted(spark, sf_dir), "KL")


def kl_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = threshold.cutoff(_log_means(_planted(spark, sf_dir)))
    found = spark.createDataFrame([(c.value, c.index, c.mean, c.std, c.success)], "cutoff double, i int, mean double, std double, success boolean")
    return found.select(r6("cutoff").alias("cutoff"), "i", r6("mean").alias("mean"), r6("std").alias("std"), "success")


def simple_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(_planted(spark, sf_dir))


def no_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(_planted(spark, sf_dir), "none")


def threshold_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _kept(_planted(spark, sf_dir)).withColumn("label", F.lit(0))
    return views.grid(kept, src.PLANTED)


def high_variance_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold.high_variance(_rescaled(spark, sf_dir), 0.3).select("site", r6("std").alias("std"), "high")


# Rescaling


def _rescaled_out(df: DataFrame) -> DataFrame:
    return df.select("site", "t", r6("v").alias("v"))


def rescale_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rescaled_out(_rescaled(spark, sf_dir, "mean"))


def rescale_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rescaled_out(_rescaled(spark, sf_dir, "z-score"))


def rescale_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rescaled_out(_rescaled(spark, sf_dir, "None"))


def rescale_log_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rescaled_out(_rescaled(spark, sf_dir, "log-mean"))


# Peaks


def peak_labels_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks.label(_kept(_planted(spark, sf_dir)), src.PLANTED, side=16)


def peak_labels_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks.label(_kept(src.solid_cube(spark, sf_dir)), src.SOLID, side=4)


def peak_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = _planted(spark, sf_dir)
    return peaks.trajectories(cube, peaks.label(_kept(cube), src.PLANTED)).select("peak", "t", r6("v_mean").alias("v_mean"), "v_max")


def peak_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks.label(_kept(_planted(spark, sf_dir)), src.PLANTED).groupBy("peak").agg(F.count("*").alias("n"), F.min("site").alias("first_site"))


def pixel_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = peaks.label(_kept(_planted(spark, sf_dir)), src.PLANTED)
    return peaks.to_pixels(members, members.groupBy("peak").agg((F.min("site") % 3).cast("int").alias("label")))


# Neighbourhoods


def edges_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.local_edges(_kept(_planted(spark, sf_dir)), src.PLANTED, SMOOTH_L).select("i", "j", r6("w").alias("w"))


def edges_gaussian_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.local_edges(_kept(_planted(spark, sf_dir)), src.PLANTED, SMOOTH_L, uniform=False).select("i", "j", r6("w").alias("w"))


def edges_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.periodic_classes(_kept(_planted(spark, sf_dir)), src.PLANTED, [10, 10], 0.2).select("class", "other", F.round("w", 9).alias("w"))


def unit_cell_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.unit_cell(src.axis_table(spark, sf_dir), ["c0", "c1"])


def smooth_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = _packed(spark, sf_dir)
    smooth = edges.near_smoother(src.PLANTED, SMOOTH_L, side=16)
    return gmm.long_form(smooth(gmm.responsibilities(packed, _start(packed)))).select("site", "k", r6("r").alias("r"))


def smooth_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = _packed(spark, sf_dir)
    smoothed = edges.smooth_periodic(gmm.responsibilities(packed, _start(packed)), src.PLANTED, [10, 10], 0.2)
    return gmm.long_form(smoothed).select("site", "k", r6("r").alias("r"))


# Mixtures on the embedding table: initial means are the first four vectors


def _vectors(spark, sf_dir) -> tuple[DataFrame, gmm.Params]:
    packed = src.embeddings(spark, sf_dir).cache()
    means = np.array([r["y"] for r in packed.where("site < 4").orderBy("site").collect()])
    return packed, gmm.start(packed, means)


def gmm_estep(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed, p = _vectors(spark, sf_dir)
    return gmm.long_form(gmm.responsibilities(packed, p)).select("site", "k", r6("r").alias("r"))


def gmm_mstep(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed, p = _vectors(spark, sf_dir)
    return _params_out(spark, _steps(packed, p, 1))


def gmm_loglik(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed, p = _vectors(spark, sf_dir)
    s = gmm.sums(packed, p)
    return spark.createDataFrame([(s.n, s.ll)], "n long, ll double").select("n", F.round("ll", 4).alias("ll"))


def gmm_em3(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = _packed(spark, sf_dir)
    return _params_out(spark, _steps(packed, _start(packed), 3, reg=1e-6))


def gmm_stepwise3(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = _packed(spark, sf_dir)
    return _params_out(spark, _steps(packed, _start(packed), 3, gmm.eta))


def gmm_smoothed2(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = _packed(spark, sf_dir)
    smooth = edges.near_smoother(src.PLANTED, SMOOTH_L, side=16)
    p = _start(packed)
    for epoch in range(2):
        p, _ = gmm.smoothed_step(packed, p, gmm.Config(), smooth, epoch)
    return _params_out(spark, p)


def gmm_periodic2(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = _packed(spark, sf_dir)
    smooth = edges.periodic_smoother(src.PLANTED, [10, 10], 0.2)
    p = _start(packed)
    for epoch in range(2):
        p, _ = gmm.smoothed_step(packed, p, gmm.Config(), smooth, epoch)
    return _params_out(spark, p)


def _orders(spark, sf_dir) -> DataFrame:
    """Rescaled trajectories of every part and line number: as many as the data have."""
    return rescale.rescale_packed(mask.keep_packed(src.order_cube(spark, sf_dir))).cache()


def order_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.unpack(src.order_cube(spark, sf_dir)).select("site", "t", "v")


def order_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = threshold.log_mean_packed(mask.keep_packed(src.order_cube(spark, sf_dir)))
    return threshold.above_packed(x, threshold.cutoff(x, "simple")).select("site")


def order_rescaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rescaled_out(src.unpack(_orders(spark, sf_dir)))


def gmm_order2(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = _orders(spark, sf_dir)
    return _params_out(spark, _steps(packed, gmm.start(packed, _first(packed, 3)), 2, reg=1e-6))


def order_bin_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = threshold.log_mean_packed(mask.keep_packed(src.order_cube(spark, sf_dir))).select("site", "x").cache()
    n, iqr, width = threshold.bin_width(x)
    return spark.createDataFrame([(n, float(iqr), float(width))], "n long, iqr double, width double").select("n", r6("iqr").alias("iqr"), r6("width").alias("width"))


def order_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values at the tenths of the sorted log means, picked without a sort."""
    x = threshold.log_mean_packed(mask.keep_packed(src.order_cube(spark, sf_dir))).select("x").cache()
    n = x.count()
    found = order_statistics(x, "x", [(n - 1) * k // 10 for k in range(11)]) if n else []
    return spark.createDataFrame(list(enumerate(found)), "decile int, x double").select("decile", r6("x").alias("x"))


def _field(spark, sf_dir) -> tuple[DataFrame, list[int]]:
    """Sites of the field half a deviation above the mean: a grid that grows with the data, clusters across tiles."""
    packed, sizes = src.field_cube(spark, sf_dir)
    x = threshold.log_mean_packed(mask.keep_packed(packed)).cache()
    cut = threshold.cutoff(x, "simple")
    return threshold.above_packed(x, threshold.Cutoff(cut.mean + 0.5 * cut.std, "half")), sizes


def field_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _field(spark, sf_dir)[0].select("site")


def field_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, sizes = _field(spark, sf_dir)
    return peaks.label(kept, sizes)


def field_peak_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, sizes = _field(spark, sf_dir)
    kept = kept.cache()
    return peaks.trajectories_packed(kept, peaks.label(kept, sizes)).select("peak", "t", r6("v_mean").alias("v_mean"), "v_max")


def _field_start(spark, sf_dir) -> tuple[DataFrame, list[int], gmm.Params]:
    kept, sizes = _field(spark, sf_dir)
    packed = gmm.held(rescale.rescale_packed(kept))
    return packed, sizes, gmm.start(packed, _first(packed, 3))


def field_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed, sizes, p = _field_start(spark, sf_dir)
    smooth = edges.near_smoother(sizes, SMOOTH_L)
    return gmm.long_form(smooth(gmm.responsibilities(packed, p))).select("site", "k", r6("r").alias("r"))


def field_smoothed_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed, sizes, p = _field_start(spark, sf_dir)
    p, _ = gmm.smoothed_step(packed, p, gmm.Config(), edges.near_smoother(sizes, SMOOTH_L), 0)
    return _params_out(spark, p)


def gmm_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir)[0]


def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, p = _labels(spark, sf_dir)
    return gmm.sizes(labels, p.k)


def discovery_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, p = _labels(spark, sf_dir)
    counts = {r["label"]: r["n"] for r in gmm.sizes(labels, p.k).collect()}
    return spark.createDataFrame([(gmm.discovery(p, counts),)], "label int")


def gmm_full_em2(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = _packed(spark, sf_dir)
    return _params_out(spark, _steps(packed, gmm.start(packed, _seeded(packed), "full"), 2, reg=1e-6))


def kmeanspp_init(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = gmm.kmeanspp_means(src.embeddings(spark, sf_dir), 4)
    return spark.createDataFrame([(k, t, round(float(v), 6) + 0.0) for k, row in enumerate(means) for t, v in enumerate(row)], "k int, t int, mu double")


def kmeans_init(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = gmm.kmeans_means(src.embeddings(spark, sf_dir).cache(), 4, rounds=2, iterations=4, tol=0.0)
    return spark.createDataFrame([(k, t, round(float(v), 6) + 0.0) for k, row in enumerate(means) for t, v in enumerate(row)], "k int, t int, mu double")


def gaussian_init(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = gmm.init_means(src.embeddings(spark, sf_dir), 4, "gaussian")
    return spark.createDataFrame([(k, t, round(float(v), 6) + 0.0) for k, row in enumerate(means) for t, v in enumerate(row)], "k int, t int, mu double")


def minibatch_stepwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = _packed(spark, sf_dir)
    found = gmm.fit(packed, gmm.Config(k=3, tol=-1.0, solver="stepwise", batch_num=3, max_batch_epoch=3, max_full_epoch=3, means=_seeded(packed)))
    return gmm.sizes(found.labels(), 3)


def post_stepwise_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = _packed(spark, sf_dir)
    return _params_out(spark, gmm.fit(packed, gmm.Config(k=3, tol=-1.0, max_iter=5, refine_epochs=2, means=_seeded(packed))).params)


# Selection


def reorder_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, p = _labels(spark, sf_dir)
    return select.relabel(labels, select.reorder_map(_planted(spark, sf_dir), labels, p.k, src.YEARS))


def second_pass_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, p = _labels(spark, sf_dir)
    counts = {r["label"]: r["n"] for r in gmm.sizes(labels, p.k).collect()}
    return select.second_pass(labels, discovery=gmm.discovery(p, counts))


def _sweep(packed: DataFrame) -> DataFrame:
    """Fixed passes from the first vectors, so that the criterion is the same everywhere."""
    base = gmm.Config(max_iter=2, tol=-1.0, means=_first(packed, 4))
    return select.sweep(packed, 2, 5, base)


def _first(packed: DataFrame, k: int) -> np.ndarray:
    return np.array([r["y"] for r in packed.orderBy("site").limit(k).collect()])


def bic_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sweep(src.embeddings(spark, sf_dir)).select("k", F.round("ll", 3).alias("ll"), F.round("bic", 3).alias("bic"))


def best_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.best_k(_sweep(src.embeddings(spark, sf_dir))).select("k", F.round("bic", 3).alias("bic"))


def _peak_packed(spark, sf_dir) -> DataFrame:
    cube = _planted(spark, sf_dir)
    found = peaks.trajectories(cube, peaks.label(_kept(cube), src.PLANTED)).select(F.col("peak").alias("site"), "t", F.col("v_mean").alias("v"))
    return gmm.held(src.pack(rescale.rescale(found)))


def recommend_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = select.best_k(_sweep(_packed(spark, sf_dir))).first()
    s = select.best_k(_sweep(_peak_packed(spark, sf_dir))).first()
    mode = select.recommend(d["bic"], s["bic"])
    return spark.createDataFrame([(mode, (d if mode == "d" else s)["k"], round(d["bic"], 3), round(s["bic"], 3))], "mode string, k int, bic_d double, bic_s double")


def bic_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sweep saved in the shared folder and read back."""
    out = f"{shared_folder(spark)}/bic-{uuid.uuid4().hex}"
    pipeline.save_sweep(_sweep(src.embeddings(spark, sf_dir)), out)
    return pipeline.load_sweep(spark, out).select("k", F.round("ll", 3).alias("ll"), F.round("bic", 3).alias("bic"))


def workflow_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _sweep(src.embeddings(spark, sf_dir)).select("k", F.round("ll", 3).alias("ll"), F.round("bic", 3).alias("bic"))
    top = select.best_k(table).first()
    return select.report(spark, {"rescale": "mean", "threshold": "simple"}, table, {"mode": select.recommend(top["bic"], None), "k": top["k"]})  # vectors have no peaks


# Jobs from the raw cube to their result


PASSES = 30


def _job_config(spark, sf_dir, **more) -> gmm.Config:
    """Passes enough to settle, from the trajectories of the planted kinds, so that the result does not depend on draws."""
    return gmm.Config(**({"k": 3, "tol": -1.0, "max_iter": PASSES, "means": _seeded(_packed(spark, sf_dir))} | more))


def job_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mask, threshold, rescale, fit, reorder: the label of every kept site."""
    return pipeline.direct(_planted(spark, sf_dir), src.YEARS, _job_config(spark, sf_dir), kind="simple").labels


def job_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over peaks, back to pixels."""
    return pipeline.by_peaks(_planted(spark, sf_dir), src.PLANTED, src.YEARS, _job_config(spark, sf_dir), kind="simple").pixels


def job_two_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second fit, of two components from the sites kept first, over the sites of the first fit's label 0."""
    first = _job_config(spark, sf_dir)
    second = gmm.Config(k=2, tol=-1.0, max_iter=5, means=first.means[:2])
    one, two = pipeline.two_pass(_planted(spark, sf_dir), src.YEARS, first, second, keep=0, kind="simple")
    return one.labels.withColumnRenamed("label", "first").join(two.labels.withColumnRenamed("label", "second"), "site", "left")


def job_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fit whose responsibilities are averaged over near sites, epoch by epoch: its parameters, brightest cluster first."""
    found = pipeline.smoothed(_planted(spark, sf_dir), src.PLANTED, src.YEARS, _job_config(spark, sf_dir, max_iter=3, max_smooth_epoch=3), l_scale=SMOOTH_L, kind="simple")
    return _params_out(spark, found.fit.params)


def job_workflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sweeps, the recommendation and the recommended run: one row a candidate, with the run's clusters where it was chosen."""
    config = _job_config(spark, sf_dir, max_iter=10)
    run, report = pipeline.workflow(_planted(spark, sf_dir), src.PLANTED, src.YEARS, k_min=2, k_max=4, config=config, kind="simple")
    n = run.pixels.groupBy("label").count().count()
    rows = [(m, r["k"], round(r["bic"], 3), n if (m, r["k"]) == (report["mode"], report["k"]) else None) for m, table in report["sweeps"].items() for r in table]
    return spark.createDataFrame(rows, "mode string, k int, bic double, n_clusters int")


def job_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A direct job with drawn starts and the usual tolerance, run until it converges: whether it did, and that likelihoods never fall."""
    found = pipeline.direct(_planted(spark, sf_dir), src.YEARS, gmm.Config(k=3), kind="simple").fit
    falls = sum(b < a - 1e-6 * abs(a) for a, b in zip(found.history, found.history[1:], strict=False))
    return spark.createDataFrame([(found.n, found.converged, falls)], "n long, converged boolean, falls int")


# Views


def cluster_avg_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.average_intensity(_planted(spark, sf_dir), _labels(spark, sf_dir)[0]).select("label", "t", r6("v").alias("v"))


def trajectory_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _labels(spark, sf_dir)[1]
    return views.envelope(gmm.param_table(spark, p)).select("k", "t", r6("mu").alias("mu"), r6("low").alias("low"), r6("high").alias("high"))


def cluster_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = _packed(spark, sf_dir)
    p = _start(packed)
    cube = _planted(spark, sf_dir)
    means = cube.groupBy("site").agg((F.sum("v") / F.count("*")).alias("m"))
    weights = gmm.param_table(spark, p).where("t = 0").select("k", "w")
    return views.shifts(gmm.long_form(gmm.responsibilities(packed, p)), means, weights).select("k", r6("shift").alias("shift"))


def qmap_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.grid(_labels(spark, sf_dir)[0], src.PLANTED)


def _solid_clusters(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Kept sites of the solid cube, their variance, and labels of those of high variance after two steps from the first three."""
    kept = _kept_packed(src.solid_cube(spark, sf_dir))
    packed = gmm.held(rescale.rescale_packed(kept))
    variance = threshold.high_variance(src.unpack(packed), 0.3)
    moving = gmm.held(packed.join(variance.where("high"), "site", "left_semi").select("site", "y"))
    if moving.isEmpty():
        return kept.select("site"), variance, moving.select("site", F.lit(0).alias("label"))
    p = _steps(moving, gmm.start(moving, _first(moving, 3)), 2, reg=1e-6)
    return kept.select("site"), variance, gmm.labels(gmm.responsibilities(moving, p))


def kspace_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _, labels = _solid_clusters(spark, sf_dir)
    return views.slice_of(views.grid(labels, src.SOLID, 2, kept), src.SOLID, 0, 3)


def clusters_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, variance, labels = _solid_clusters(spark, sf_dir)
    return views.clusters_in_space(labels, variance, src.SOLID).select("site", "group", *[r6(c).alias(c) for c in ("u0", "u1", "u2")])


def threshold_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _kept_packed(src.solid_cube(spark, sf_dir)).select("site", F.lit(0).alias("label"))
    return views.slice_of(views.grid(kept, src.SOLID), src.SOLID, 1, 4)


def plot_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    axis = src.axis_table(spark, sf_dir)
    named = axis.select(F.when(F.col("name") == "c0", "Qk").when(F.col("name") == "c1", "Qh").otherwise("Ql").alias("name"), "pos", "value")
    return views.plane_axes(named, ["Ql", "Qk", "Qh"], 0, 1996.0)


def run_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = _packed(spark, sf_dir)
    p = _steps(packed, _start(packed), 3, reg=1e-6)
    rows = pipeline.bundle(gmm.labels(gmm.responsibilities(packed, p)), packed, src.axis_table(spark, sf_dir), src.PLANTED)
    return rows.select("site", "c0", "c1", "label", "at", r6("v").alias("v"))


def results_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A direct job's saved folders, read back: means and variances of the clusters beside their sites."""
    cube = _planted(spark, sf_dir)
    out = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    pipeline.save(pipeline.direct(cube, src.YEARS, _job_config(spark, sf_dir, max_iter=3), kind="simple", reorder=False), cube, out)
    read = lambda name: pipeline.load(spark, out, name)
    n = read("cluster_assignments").groupBy("label").agg(F.count("*").alias("n"))
    both = read("cluster_means").join(read("cluster_covariances"), ["k", "t"]).join(n, F.col("k") == F.col("label"), "left")
    return both.select("k", "t", r6("mu").alias("mu"), r6("var").alias("var"), F.coalesce("n", F.lit(0)).alias("n"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows with which a stream of events feeds a cube, here over the whole table."""
    return feed.windowed(src.table(spark, sf_dir, "events")).select(F.date_format("at", "yyyy-MM-dd").alias("day"), "c0", "c1", r6("v").alias("v"))


def zoom_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.zoom(views.grid(_labels(spark, sf_dir)[0], src.PLANTED), (5, 25), (0, 15))


def threshold_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = views.unit_coordinates(_kept(src.solid_cube(spark, sf_dir)), src.SOLID)
    return placed.select("site", *[r6(c).alias(c) for c in ("u0", "u1", "u2")])


def cutoff_plot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram with the Gaussian of the simple cutoff's mean and deviation."""
    x = _log_means(_planted(spark, sf_dir))
    h, bins = threshold.binned(x)
    z = (F.col("left_edge") - h.mean) / h.std
    pdf = F.exp(-0.5 * z * z) / (h.std * (2 * np.pi) ** 0.5)
    return threshold.density(h, bins).select("bin", r6("density").alias("density"), r6(pdf).alias("pdf"), (F.col("left_edge") > h.mean + 2 * h.std).alias("beyond"))


QUERIES = {
    f.__name__: f
    for f in (
        cube_dense, cube_solid, cube_slice, cube_loaded, cube_from_arrays, order_cube, order_kept, order_rescaled, nearest_axis_index, mask_zero_mean, mask_any_zeros, mask_complement, log_mean, fd_bin_width,
        histogram_density, kl_by_index, kl_cutoff, kl_diagnostics, simple_cutoff, no_threshold, threshold_volume, high_variance_split,
        rescale_mean, rescale_zscore, rescale_log_mean, rescale_none, peak_labels_2d, peak_labels_3d, peak_trajectories, peak_sizes, pixel_labels,
        edges_local, edges_gaussian_weights, edges_periodic, unit_cell_shape, smooth_once, smooth_periodic, gmm_estep, gmm_mstep, gmm_loglik,
        gmm_em3, gmm_stepwise3, gmm_smoothed2, gmm_periodic2, gmm_order2, order_bin_width, order_deciles, field_kept, field_peaks, field_peak_trajectories, field_smooth, field_smoothed_step, gmm_labels, cluster_sizes, discovery_cluster, gmm_full_em2, kmeanspp_init, kmeans_init,
        gaussian_init, minibatch_stepwise, post_stepwise_refine, reorder_clusters, second_pass_select, bic_table, bic_saved, best_k, recommend_mode,
        job_direct, job_peaks, job_two_pass, job_smoothed, job_workflow, job_converged, workflow_report, cluster_avg_intensity, trajectory_envelope, cluster_shifts, qmap_grid, kspace_slice, zoom_view, threshold_space, threshold_slice, clusters_space, plot_axes, run_bundle, results_saved, event_windows, cutoff_plot,
    )
}

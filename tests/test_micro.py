"""Hand-computed cases and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteflow.operators import edges, gmm, mask, peaks, rescale, select, threshold, views
from siteflow.sources import cube as src


def long_cube(spark, sites):
    rows = [(s, t, float(v)) for s, ys in enumerate(sites) for t, v in enumerate(ys)]
    return spark.createDataFrame(rows, "site long, t int, v double")


def kept(df):
    return sorted(r["site"] for r in df.where("kept").collect())


def values(df):
    return [round(r["v"], 6) for r in df.orderBy("site", "t").collect()]


def sites(spark, ids):
    return spark.createDataFrame([(int(i),) for i in ids], "site long")


def test_masks(spark):
    c = long_cube(spark, [(1, 1), (0, 0), (-1, 3), (0, 2)])
    assert kept(mask.site_mask(c)) == [0, 2, 3]
    assert kept(mask.site_mask(c, "any_zeros")) == [0]
    with pytest.raises(ValueError):
        mask.site_mask(c, "other")


def test_nan_mask(spark):
    c = long_cube(spark, [(math.nan, 1)])
    assert kept(mask.site_mask(c)) == [0]
    assert kept(mask.site_mask(c, check_nan=True)) == []


def test_split_is_complete(spark):
    c = long_cube(spark, [(1, 1), (0, 0), (2, 3)])
    a, b = mask.split(c, mask.site_mask(c))
    assert a.count() + b.count() == c.count() and not a.join(b, "site", "left_semi").count()


def test_picked_quartiles():
    assert (threshold.half_even(6, 0.75), threshold.half_even(6, 0.25)) == (4, 2)


def test_histogram(spark):
    x = spark.createDataFrame([(i, float(v)) for i, v in enumerate((0, 1, 2, 4))], "site long, x double")
    h, bins = threshold.binned(x, 2.0)
    rows = threshold.density(h, bins).orderBy("bin").collect()
    assert [(r["n"], r["density"], r["left_edge"]) for r in rows] == [(2, 0.25, 0.0), (2, 0.25, 2.0)]


def test_threshold_is_strict(spark):
    x = spark.createDataFrame([(0, 1.0), (1, 1.5), (2, math.nan)], "site long, x double")
    assert [r["site"] for r in threshold.above(x, threshold.Cutoff(1.0, "none")).collect()] == [1]


def test_rescale(spark):
    c = long_cube(spark, [(1, 2, 3)])
    assert values(rescale.rescale(c, "mean")) == [-0.5, 0.0, 0.5]
    assert values(rescale.rescale(c, "z-score")) == [-1.224745, 0.0, 1.224745]
    assert values(rescale.rescale(long_cube(spark, [(0, math.e - 1)]), "log-mean")) == [-0.5, 0.5]
    assert values(rescale.rescale(c, "None")) == [1.0, 2.0, 3.0]
    with pytest.raises(ValueError):
        rescale.rescale(c, "other")


def test_rescale_of_flat_and_zero_sites_is_null(spark):
    c = long_cube(spark, [(0, 0), (2, 2)])
    assert rescale.by_mean(c).where("v is null").count() == 2
    assert rescale.by_zscore(c).where("v is null").count() == 4


def test_diagonal_sites_connect(spark):
    rows = peaks.label(sites(spark, [0, 5, 15]), [4, 4]).collect()
    assert {r["site"]: r["peak"] for r in rows} == {0: 0, 5: 0, 15: 1}


def test_long_path_is_one_peak(spark):
    snake = [r * 21 + c for r in range(0, 21, 2) for c in range(21)] + [r * 21 + (20 if r % 4 == 1 else 0) for r in range(1, 21, 2)]
    assert peaks.label(sites(spark, snake), [21, 21]).select("peak").distinct().count() == 1


def test_no_peaks(spark):
    assert peaks.label(sites(spark, []), [4, 4]).count() == 0
    with pytest.raises(ValueError):
        peaks.label(sites(spark, [0]), [4])


@pytest.mark.parametrize(("rank", "scale", "n"), [(2, 0.05, 1), (2, 0.5, 5), (2, 1.0, 13), (2, 2.0, 61), (3, 0.05, 1), (3, 0.5, 7), (3, 1.0, 33)])
def test_local_neighbours(rank, scale, n):
    assert len(edges.local_offsets(rank, scale)) == n


def test_markov_rows(spark):
    rows = edges.local_edges(sites(spark, [0, 1, 35]), [6, 6], 1.0).collect()
    assert sorted((r["i"], r["j"], r["w"]) for r in rows) == [(0, 0, 0.5), (0, 1, 0.5), (1, 0, 0.5), (1, 1, 0.5), (35, 35, 1.0)]
    with pytest.raises(ValueError):
        edges.markov(sites(spark, [0]), [6, 6], "other")
    with pytest.raises(TypeError):
        edges.markov(sites(spark, [0]), [6, 6], "periodic", unit=None, l_scale=1.0)


def test_parameters_and_criterion():
    assert select.parameter_count(4, 50) == 403 and select.parameter_count(4, 50, "full") == 5303
    assert select.bic(-100, 2, 1, math.exp(4)) == pytest.approx(220)
    with pytest.raises(ValueError):
        select.parameter_count(1, 1, "tied")


def test_step_sizes():
    assert [round(gmm.eta(k), 6) for k in range(3)] == [0.615572, 0.463463, 0.378929]


def test_reorder(spark):
    c = long_cube(spark, [[1] * 20, [5] * 20])
    labels = spark.createDataFrame([(0, 0), (1, 1)], "site long, label int")
    rows = select.reorder_map(c, labels, 3, 20).collect()
    assert {r["label"]: r["new_label"] for r in rows} == {0: 1, 1: 0, 2: 2}


def test_discovery():
    means = np.array([[-0.2, 0.2], [-9, 9], [-0.3, 0.3]])
    p = gmm.Params(np.full(3, 1 / 3), means, np.ones((3, 2)))
    assert gmm.discovery(p, {0: 5, 1: 1, 2: 4}) == 2


def test_high_variance_is_inclusive(spark):
    assert threshold.high_variance(long_cube(spark, [(0, 1)]), 0.5).first()["high"]


def test_recommendation():
    assert select.recommend(1.0, 1.0) == "d" and select.recommend(2.0, 1.0) == "s" and select.recommend(None, 1.0) == "s" and select.recommend(3.0, None) == "d"
    with pytest.raises(RuntimeError):
        select.recommend(None, None)


def test_slices():
    assert src.parse_slices(":,0.0:1.0,-10:,3", ["a", "b", "c", "d"]) == {"b": (0.0, 1.0), "c": (-10.0, None), "d": (3.0, 3.0)}


def test_zoom_window_checks(spark):
    with pytest.raises(ValueError):
        views.zoom(spark.createDataFrame([(0, 0, 1)], "c0 int, c1 int, value int"), (3, 3), (0, 1))


def blobs(spark, n=120):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(0, 0.1, 4) + (3 * (i % 3))).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "site long, y array<double>")


def test_batch_fit_finds_blobs_and_likelihood_grows(spark):
    data = blobs(spark)
    f = gmm.fit(data, gmm.Config(k=3, max_iter=20))
    assert f.converged and all(b >= a - 1e-9 for a, b in zip(f.history, f.history[1:], strict=False))
    got = {r["site"]: r["label"] for r in f.labels().collect()}
    assert len({(s % 3, k) for s, k in got.items()}) == 3
    sums = f.resp.select(F.aggregate("r", F.lit(0.0), lambda a, b: a + b).alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-9 for r in sums)


def test_array_pass_equals_long_form(spark):
    data = blobs(spark, 40)
    p = gmm.start(data, gmm.init_means(data, 2))
    s = gmm.sums(data, p)
    x = np.array([r["y"] for r in data.orderBy("site").collect()])
    r, ll = p.responsibilities(x)
    assert s.n == 40 and s.ll == pytest.approx(ll)
    assert np.allclose(gmm.m_step(s, p).means, (r.T @ x) / r.sum(axis=0)[:, None])


def test_full_covariance_matches_sample_covariance(spark):
    data = blobs(spark, 60)
    x = np.array([r["y"] for r in data.orderBy("site").collect()])
    p = gmm.start(data, x.mean(axis=0, keepdims=True), "full")
    assert np.allclose(gmm.m_step(gmm.sums(data, p), p).covs[0], np.cov(x.T, bias=True))


def test_stepwise_and_smoothed_fits_end(spark):
    data = blobs(spark, 36)
    means = gmm.init_means(data, 3)
    f = gmm.fit(data, gmm.Config(k=3, solver="stepwise", means=means, batch_num=2, max_batch_epoch=3, max_full_epoch=2))
    assert gmm.sizes(f.labels(), 3).agg(F.sum("n")).first()[0] == 36
    near = edges.local_edges(data.select("site"), [6, 6], 0.05)
    g = gmm.fit(data, gmm.Config(k=3, means=means, max_iter=3, max_smooth_epoch=2), near)
    assert g.labels().count() == 36


def test_kmeanspp_does_not_depend_on_partitions(spark):
    data = blobs(spark, 30)
    assert np.allclose(gmm.kmeanspp_means(data.repartition(7), 3, 1), gmm.kmeanspp_means(data.coalesce(1), 3, 1))
    assert len(gmm.kmeanspp_means(data.limit(2), 3)) == 3


def test_wrong_settings(spark):
    data = blobs(spark, 6)
    for cfg in (gmm.Config(k=2, init="other"), gmm.Config(k=2, solver="other"), gmm.Config(k=2, cov_type="other")):
        with pytest.raises(ValueError):
            gmm.fit(data, cfg)
    with pytest.raises(ValueError):
        gmm.spread(data.limit(0))


def test_text_parsers():
    assert src.parse_ints("0, 1,3") == [0, 1, 3] and src.parse_ints(None) is None and src.parse_ints("") == []
    assert src.parse_window("200:300, 0:100") == ((200, 300), (0, 100)) and src.parse_window(None) is None
    for bad in ("3:3,0:1", "0:1,5:2", "1:2", "a:b,0:1", "1,2"):
        with pytest.raises(ValueError):
            src.parse_window(bad)


def test_synthetic_and_stored_cubes(spark, tmp_path):
    c = src.synthetic_cube(spark, [6, 5], 4, zero_rows=2, seed=3).cache()
    assert c.count() == 120 and c.where("c0 < 2").agg({"v": "max"}).first()[0] == 0 and c.where("v > 0").count() == 80
    axis = spark.createDataFrame([("t", k, 10.0 * k) for k in range(4)] + [("c0", k, k / 2) for k in range(6)] + [("c1", k, -1.0 * k) for k in range(5)], "name string, pos int, value double")
    src.save_cube(c, axis, str(tmp_path), "entry/data")
    whole, again = src.load_cube(spark, str(tmp_path))
    assert whole.count() == 120 and src.shape(again) == {"t": 4, "c0": 6, "c1": 5}
    part, _ = src.load_cube(spark, str(tmp_path), "entry/data", "10:,0.4:1.6,:")
    assert {(r["t"], r["c0"]) for r in part.select("t", "c0").distinct().collect()} == {(t, x) for t in (1, 2, 3) for x in (1, 2, 3)}


def test_dense_arrays_become_a_long_cube(spark):
    arrays = spark.createDataFrame([(0, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), (1, [0.0] * 6)], "t int, values array<double>")
    rows = {(r["c0"], r["c1"]): (r["site"], r["v"]) for r in src.from_arrays(arrays, 3).where("t = 0").collect()}
    assert rows == {(a, b): (3 * a + b, 3 * a + b + 1.0) for a in range(2) for b in range(3)}


@pytest.mark.parametrize("method", ["mean", "z-score", "log-mean", "None"])
def test_packed_and_long_forms_agree(spark, method):
    rows = [(s, t, float((s * 7 + t * t) % 11) if s else 0.0) for s in range(9) for t in range(5)]
    long = spark.createDataFrame(rows, "site long, t int, v double")
    packed = src.pack(long)
    for kind in ("zero_mean", "any_zeros"):
        kept = mask.split(long, mask.site_mask(long, kind))[0].select("site").distinct()
        assert {r[0] for r in kept.collect()} == {r[0] for r in mask.keep_packed(packed, kind).select("site").collect()}
    a = {r["site"]: r["x"] for r in threshold.log_mean(long).collect()}
    b = {r["site"]: r["x"] for r in threshold.log_mean_packed(packed).collect()}
    assert a == pytest.approx(b)
    one = {(r["site"], r["t"]): r["v"] for r in rescale.rescale(long, method).collect()}
    two = {(r["site"], r["t"]): r["v"] for r in src.unpack(rescale.rescale_packed(packed, method)).collect()}
    assert all(x is None and two[k] is None or two[k] == pytest.approx(x) for k, x in one.items()) and len(one) == len(two)


def test_single_divergences_equal_the_table(spark):
    x = spark.range(400).selectExpr("id AS site", "pow((id % 37) / 10.0, 2) + (id % 7) / 3.0 AS x")
    h, bins = threshold.binned(x)
    kl = threshold.Divergence(h, bins.orderBy("bin").collect())
    table = {r["i"]: r for r in threshold.divergence(h, bins).collect()}
    assert len(table) == h.n_bins
    for i, r in table.items():
        assert kl(i) == pytest.approx(r["kl"]) and kl.fit(i) == pytest.approx((r["mean"], r["std"]))
    with pytest.raises(ValueError):
        threshold.binned(x, 1e-9)


def test_peaks_are_numbered_in_order_by_chunks(spark):
    roots = spark.createDataFrame([(r,) for r in (0, 3, 4, 77, 78, 95, 99)], "root long")
    for chunks in (1, 7, 4096):
        got = {r["root"]: r["peak"] for r in peaks.numbered(roots, [10, 10], chunks).collect()}
        assert got == {r: k for k, r in enumerate((0, 3, 4, 77, 78, 95, 99))}


def test_plane_axes_and_names(spark):
    assert [views.display_name(n) for n in ("Qh", "qk", "Te", "Qhk")] == ["H", "K", "Te", "Qhk"]
    axis = spark.createDataFrame([(n, k, v0 + k) for n, v0 in (("Ql", 0.0), ("Qk", 10.0), ("Qh", 20.0)) for k in range(3)], "name string, pos int, value double")
    got = {r["role"]: (r["name"], r["low"], r["high"]) for r in views.plane_axes(axis, ["Ql", "Qk", "Qh"], 1, 11.0).collect()}
    assert got == {"cut": ("K", 11.0, 11.0), "y": ("L", 0.0, 2.0), "x": ("H", 20.0, 22.0)}
    with pytest.raises(ValueError):
        views.plane_axes(axis, ["Ql", "Qk", "Qh"], 3, 0.0)


def test_mini_batches_part_the_sites(spark):
    sites = spark.range(3000).select(gmm.batch_of(F.col("id"), 5, 2, 4).alias("b")).groupBy("b").count().collect()
    assert sorted(r["b"] for r in sites) == [0, 1, 2, 3] and min(r["count"] for r in sites) > 500


def test_shared_folder_is_never_local_on_a_cluster():
    from types import SimpleNamespace

    from siteflow.functions.lineage import shared_folder

    chosen = []
    sc = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: chosen[-1] if chosen else None, setCheckpointDir=chosen.append)
    conf = {}
    fake = SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d)))
    with pytest.raises(RuntimeError):
        shared_folder(fake)
    conf["spark.checkpoint.dir"] = "hdfs://x/shared"
    assert shared_folder(fake) == "hdfs://x/shared"

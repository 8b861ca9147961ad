"""The jobs end to end on the planted cube, their sinks, and the stream."""

import json
from dataclasses import replace

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siteflow.jobs import catalog, pipeline
from siteflow.operators import gmm, select
from siteflow.sources import cube as src
from siteflow.streaming import feed

SF = "/root/testdata/sf0.001"


def test_direct_and_save(spark, tmp_path):
    cube = src.planted_cube(spark, SF).cache()
    r = pipeline.direct(cube, src.YEARS, gmm.Config(k=3, max_iter=8))
    assert r.cutoff.success and r.labels.count() == 45
    low = cube.where("t = 0").join(r.labels, "site").groupBy("label").avg("v").orderBy("label").collect()
    assert [x[1] for x in low] == sorted((x[1] for x in low), reverse=True)
    pipeline.save(r, cube, str(tmp_path / "out"))
    assert pipeline.load(spark, str(tmp_path / "out"), "cluster_means").count() == 3 * src.YEARS
    assert json.loads(spark.read.text(str(tmp_path / "out/report")).first()[0])["settings"]["k"] == 3


def test_peaks_two_pass_smooth_and_workflow(spark):
    cube = src.planted_cube(spark, SF).cache()
    s = pipeline.by_peaks(cube, src.PLANTED, src.YEARS, gmm.Config(k=2, max_iter=4))
    assert s.labels.count() == 5 and s.pixels.count() == 45
    one, two = pipeline.two_pass(cube, src.YEARS, gmm.Config(k=2, max_iter=3), gmm.Config(k=2, max_iter=3))
    assert 0 < two.labels.count() <= one.labels.count()
    m = pipeline.smoothed(cube, src.PLANTED, src.YEARS, gmm.Config(k=2, max_iter=2, max_smooth_epoch=1), l_scale=1.0)
    assert m.labels.count() == 45
    run, report = pipeline.workflow(cube, src.PLANTED, src.YEARS, k_min=2, k_max=4, config=gmm.Config(max_iter=3))
    assert report["mode"] in "ds" and [r["k"] for r in report["sweeps"]["d"]] == [2, 3] and run.labels.count() > 0


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    (tmp_path / "in").mkdir()
    events.repartition(3).write.parquet(str(tmp_path / "in/a"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in/*"))
    q = feed.windowed(stream).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (str(r["at"]), r["c0"], r["c1"], round(r["v"], 6))
    assert sorted(map(key, spark.table("windows").collect())) == sorted(map(key, feed.windowed(events).collect()))
    cube = src.densify(feed.as_facts(feed.windowed(events), "2024-01-01"), [10, 15], 31)
    assert cube.count() == 10 * 15 * 31


def test_periodic_job_bic_job_and_saved_sweeps(spark, tmp_path):
    cube = src.planted_cube(spark, SF).cache()
    axis = src.axis_table(spark, SF)
    m = pipeline.smoothed(cube, src.PLANTED, src.YEARS, gmm.Config(k=2, max_iter=2, max_smooth_epoch=1), l_scale=0.2, kernel="periodic", axis=axis)
    assert m.labels.count() == 45 and m.settings["kernel"] == "periodic"
    table = pipeline.bic_job(cube, src.PLANTED, "s", str(tmp_path / "s"), k_min=2, k_max=4, config=gmm.Config(max_iter=2, tol=-1.0))
    assert [r["k"] for r in table.orderBy("k").collect()] == [2, 3] and table.columns == ["k", "ll", "bic"]
    _, report = pipeline.workflow(cube, src.PLANTED, src.YEARS, modes=("d",), k_min=2, k_max=4, config=gmm.Config(max_iter=2), out=str(tmp_path / "w"))
    saved = {r["k"]: r["bic"] for r in pipeline.load_sweep(spark, str(tmp_path / "w/d")).collect()}
    assert saved == {r["k"]: r["bic"] for r in report["sweeps"]["d"]}
    rows = pipeline.bundle(m.labels, m.packed, axis, src.PLANTED)
    assert rows.count() == 45 * src.YEARS and rows.agg({"at": "max"}).first()[0] == 2001


def test_interrupted_fit_goes_on(spark, tmp_path, monkeypatch):
    """A driver lost in its fifth epoch: the next one reads four epochs and ends with the same parameters."""
    data = src.embeddings(spark, SF).cache()
    cfg = gmm.Config(k=3, max_iter=9, tol=-1.0)
    whole = gmm.fit(data, cfg)
    real, calls = gmm.sums_many, []

    def dies(*a):
        calls.append(a)
        if len(calls) == 5:
            raise ConnectionError("lost")
        return real(*a)

    log = gmm.EpochLog(spark, str(tmp_path / "epochs"))
    assert log.load() is None
    monkeypatch.setattr(gmm, "sums_many", dies)
    with pytest.raises(ConnectionError):
        gmm.fit(data, cfg, log=log)
    assert log.load()["epoch"] == 4
    calls.clear()
    monkeypatch.setattr(gmm, "sums_many", lambda *a: calls.append(a) or real(*a))
    again = gmm.fit(data, cfg, log=log)
    assert len(calls) == 6 and again.ll == pytest.approx(whole.ll) and again.history == pytest.approx(whole.history)
    assert np.allclose(again.params.means, whole.params.means) and np.allclose(again.params.covs, whole.params.covs)


def test_sweep_scans_once_an_epoch(spark, monkeypatch):
    """Five fits side by side give the criteria of five fits one by one, in as many scans as the longest takes."""
    data = src.embeddings(spark, SF).cache()
    base = gmm.Config(max_iter=40, tol=1e-3)
    alone = {k: gmm.fit(data, replace(base, k=k)) for k in range(2, 7)}
    real, scans = gmm.sums_many, []
    monkeypatch.setattr(gmm, "sums_many", lambda *a: scans.append(len(a[1])) or real(*a))
    table = {r["k"]: r["ll"] for r in select.sweep(data, 2, 7, base).collect()}
    assert table == pytest.approx({k: f.ll for k, f in alone.items()})
    assert scans[0] == 5 and len(scans) == max(len(f.history) for f in alone.values()) and scans == sorted(scans, reverse=True)


def test_mini_batches_read_their_own_cells(spark):
    data = src.embeddings(spark, SF).select("site", "y")
    cells = gmm.by_cells(data, 0)
    mine = [c for c in range(gmm.CELLS) if gmm.batch_of(c, 0, 0, 4) == 1]
    part = cells.where(F.col("cell").isin(mine))
    assert "PartitionFilters: [isnotnull(cell" in part._jdf.queryExecution().toString() or "PartitionFilters: [cell" in part._jdf.queryExecution().toString()
    read = {r[0] for r in part.select(F.input_file_name()).distinct().collect()}
    assert 0 < len(read) < len(cells.inputFiles()) and all(int(f.split("cell=")[1].split("/")[0]) in mine for f in read)
    assert cells.count() == data.count()


def test_slices_open_only_their_blocks(spark, tmp_path):
    cube, axis = src.planted_cube(spark, SF), src.axis_table(spark, SF)
    src.save_cube(cube, axis, str(tmp_path), "entry/data", files=40)
    every = src.load_cube(spark, str(tmp_path))[0]
    part = src.load_cube(spark, str(tmp_path), slices=":,0.3:0.6,1.0:1.4")[0]
    assert 0 < len(part.inputFiles()) <= 6 < 30 < len(every.inputFiles())
    key = lambda df: sorted(tuple(r) for r in df.select("site", "t", "v").collect())
    assert key(part) == key(src.sliced(cube, axis, {"c0": (0.3, 0.6), "c1": (1.0, 1.4)})) and key(every) == key(cube)
    assert src.load_cube(spark, str(tmp_path), slices=":,90:91")[0].count() == 0


def test_kmeans_settles(spark):
    """Clear heaps are found from any seed, the last step does not move, and few sites are enough."""
    rows = [(s, [float(10 * (s % 3) + s % 2 * 0.1), float(-5 * (s % 3))]) for s in range(300)]
    data = spark.createDataFrame(rows, "site long, y array<double>").cache()
    for seed in range(3):
        got = sorted(gmm.kmeans_means(data, 3, seed).tolist())
        assert np.allclose(got, [[0.05, 0], [10.05, -5], [20.05, -10]])
    assert len(gmm.init_means(data.limit(2), 3, "sklearn-kmeans")) == 3


def test_report_writes_large_numbers_as_sql_does(spark):
    """From 1e7 on, too: a criterion of many sites is a plain decimal, and short ones stay as they are."""
    rows = [(2, -3385021.604, 9999999.999), (3, 12345678.91, 10_000_000.0), (4, -123456789012.125, 2e16), (5, 0.001, -7.5)]
    table = spark.createDataFrame(rows[::-1], "k int, ll double, bic double")
    got = select.report(spark, {"rescale": "mean"}, table, {"mode": "d", "k": 5}).collect()
    said = duckdb.execute("SELECT '[' || string_agg('{\"k\":' || k || ',\"ll\":' || ll || ',\"bic\":' || bic || '}', ',' ORDER BY k) || ']' FROM (SELECT unnest(?) AS k, unnest(?::DOUBLE[]) AS ll, unnest(?::DOUBLE[]) AS bic)", [list(c) for c in zip(*rows, strict=True)]).fetchone()[0]
    assert [tuple(r) for r in got] == [('{"rescale":"mean"}', said, '{"mode":"d","k":"5"}')]
    assert [tuple(r.values()) for r in json.loads(got[0]["sweep"])] == rows


@pytest.fixture
def dealt_for_large(spark):
    """Shuffles dealt for large tables."""
    many = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in many}
    spark.catalog.clearCache()
    for k, v in many.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    spark.catalog.clearCache()


def parts(df):
    return df.rdd.getNumPartitions()


def test_two_passes_follow_the_sites_kept(spark, dealt_for_large, monkeypatch):
    """The tasks of an epoch follow the numbers that are passed over, not the shuffles before."""
    one, two = pipeline.two_pass(src.planted_cube(spark, SF), src.YEARS, gmm.Config(k=2, max_iter=2), gmm.Config(k=2, max_iter=2))
    assert [parts(one.packed), parts(two.packed)] == [1, 1] and one.labels.count() == 45
    rows = src.embeddings(spark, SF).repartition(40)
    monkeypatch.setattr(gmm, "TASK_CELLS", rows.count() * 64 // 10)
    few = gmm.held(rows)
    assert parts(few) == 10 and sorted(few.collect()) == sorted(rows.collect())
    monkeypatch.setattr(gmm, "TASK_CELLS", rows.count() * 64 // 25)
    assert parts(gmm.held(rows)) == 40 and gmm.held(rows.limit(0)).isEmpty()


def test_given_starts_follow_the_sites_kept(spark, dealt_for_large):
    """The trajectories that give the jobs' starts and the fixed steps."""
    packed = catalog._packed(spark, SF)
    assert parts(packed) == 1 and packed.count() == 45


def test_sweeps_follow_the_sites_kept(spark, dealt_for_large, monkeypatch):
    """Every scan of both modes' sweeps and of the recommended run, peaks included."""
    real, scans = gmm.sums_many, []
    monkeypatch.setattr(gmm, "sums_many", lambda *a: scans.append(parts(a[0])) or real(*a))
    cube, cfg = src.planted_cube(spark, SF), gmm.Config(k=2, max_iter=2)
    pipeline.workflow(cube, src.PLANTED, src.YEARS, k_min=2, k_max=4, config=cfg)
    pipeline.by_peaks(cube, src.PLANTED, src.YEARS, cfg)
    assert len(scans) >= 8 and set(scans) == {1}

"""Gaussian mixtures over packed trajectories (site, y) by iterated distributed passes.

Parameters are K x T numbers on the driver; one pass over the data gives the sums of the M-step and the likelihood, so an
epoch is one scan with a combine of K x T rows per task.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteflow.functions.lineage import cut, shared_folder
from siteflow.operators.edges import smoother
from siteflow.operators.tiles import Smoother

FLOOR = 1e-12


@dataclass(frozen=True)
class Params:
    weights: np.ndarray  # (K,)
    means: np.ndarray  # (K, T)
    covs: np.ndarray  # (K, T) variances, or (K, T, T)

    @property
    def full(self) -> bool:
        return self.covs.ndim == 3

    @property
    def k(self) -> int:
        return len(self.weights)

    def log_density(self, x: np.ndarray) -> np.ndarray:
        """(N, K) log densities, without the mixture's weights."""
        n_t = x.shape[1]
        out = np.empty((len(x), self.k))
        for k in range(self.k):
            d = x - self.means[k]
            if self.full:
                low = np.linalg.cholesky(self.covs[k] + 1e-6 * np.eye(n_t))
                z = np.linalg.solve(low, d.T)
                out[:, k] = -0.5 * (n_t * math.log(2 * math.pi) + 2 * np.log(np.diag(low)).sum() + (z * z).sum(axis=0))
            else:
                v = np.maximum(self.covs[k], FLOOR)
                out[:, k] = -0.5 * (n_t * math.log(2 * math.pi) + np.log(v).sum() + (d * d / v).sum(axis=1))
        return out

    def responsibilities(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """(N, K) responsibilities and the summed log-likelihood."""
        log = self.log_density(x)
        top = log.max(axis=1, keepdims=True)
        each = self.weights * np.exp(log - top)
        total = np.maximum(each.sum(axis=1, keepdims=True), 1e-300)
        joint = log + np.log(np.maximum(self.weights, 1e-300))
        peak = joint.max(axis=1)
        return each / total, float((peak + np.log(np.exp(joint - peak[:, None]).sum(axis=1))).sum()) if len(x) else 0.0


#: Numbers that a task of a pass takes, at the least.
TASK_CELLS = 1 << 18


def held(packed: DataFrame) -> DataFrame:
    """packed, cached for many passes in no more partitions than its numbers fill.

    A pass costs a Python task a partition, so their number follows the trajectories that are left and not the exchanges that made
    them, which are dealt for larger tables. Where at most half would go, the table stays as it is.
    """
    whole = packed.cache()
    sizes = whole.select(F.size("y").cast("long").alias("cells"), F.spark_partition_id().alias("part"))
    cells, last = sizes.agg(F.sum("cells"), F.max("part")).first()
    need = max(1, math.ceil((cells or 0) / TASK_CELLS))
    if 2 * need > (last or 0) + 1:
        return whole
    few = whole.coalesce(need).cache()
    few.count()
    whole.unpersist()
    return few


def matrix(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf["y"].to_numpy()).astype(float) if len(pdf) else np.zeros((0, 1))


@dataclass
class Sums:
    n: int
    ll: float
    s0: np.ndarray
    s1: np.ndarray
    s2: np.ndarray


def _columns(params: Params) -> int:
    n_t = params.means.shape[1]
    return 1 + n_t + (n_t * n_t if params.full else n_t)


def _collect(partial: DataFrame, params: Params) -> Sums:
    return _sums(partial.groupBy("k", "c").agg(F.sum("x").alias("x")).collect(), params)  # K times the columns, whatever the input


def _sums(rows: list, params: Params) -> Sums:
    n_t = params.means.shape[1]
    grid = np.zeros((params.k + 1, max(2, _columns(params))))
    for r in rows:
        grid[r["k"], r["c"]] = r["x"]
    own = grid[: params.k]
    s2 = own[:, 1 + n_t :][:, : n_t * n_t if params.full else n_t]
    return Sums(int(grid[params.k, 0]), float(grid[params.k, 1]), own[:, 0], own[:, 1 : 1 + n_t], s2.reshape(params.k, n_t, n_t) if params.full else s2)


def _moments(x: np.ndarray, r: np.ndarray, params: Params) -> np.ndarray:
    """By component: sum of r, of r d, and of r d d (or r d d'), d about the old means."""
    out = []
    for k in range(params.k):
        d = x - params.means[k]
        second = (d * r[:, k : k + 1]).T @ d if params.full else (r[:, k : k + 1] * d * d).sum(axis=0)
        out.append(np.concatenate([[r[:, k].sum()], r[:, k] @ d, second.ravel()]))
    return np.array(out)


def _emit(total: np.ndarray, n: int, ll: float) -> pd.DataFrame:
    k, c = np.indices(total.shape)
    return pd.DataFrame({"k": np.append(k.ravel(), [len(total)] * 2).astype(np.int32), "c": np.append(c.ravel(), [0, 1]).astype(np.int32), "x": np.append(total.ravel(), [float(n), ll])})


def sums(packed: DataFrame, params: Params) -> Sums:
    """E-step and the M-step's sums in one pass."""
    return sums_many(packed, [params])[0]


def sums_many(packed: DataFrame, mixtures: list[Params]) -> list[Sums]:
    """The same for several mixtures at once: one scan, whatever their number."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals, n, ll = [np.zeros((p.k, _columns(p))) for p in mixtures], 0, [0.0] * len(mixtures)
        for pdf in parts:
            x = matrix(pdf)
            if not len(x):
                continue
            n += len(x)
            for m, p in enumerate(mixtures):
                r, more = p.responsibilities(x)
                totals[m] += _moments(x, r, p)
                ll[m] += more
        for m, total in enumerate(totals):
            yield _emit(total, n, ll[m]).assign(m=np.int32(m))

    partial = packed.select("y").mapInPandas(run, "k int, c int, x double, m int")
    rows = partial.groupBy("m", "k", "c").agg(F.sum("x").alias("x")).collect()  # the mixtures' K times the columns, whatever the input
    return [_sums([r for r in rows if r["m"] == m], p) for m, p in enumerate(mixtures)]


def sums_given(packed: DataFrame, resp: DataFrame, params: Params) -> Sums:
    """The M-step's sums for responsibilities (site, r array) that were changed outside, such as smoothed ones."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((params.k, _columns(params))), 0
        for pdf in parts:
            if len(pdf):
                total += _moments(matrix(pdf), np.stack(pdf["r"].to_numpy()), params)
                n += len(pdf)
        yield _emit(total, n, 0.0)

    return _collect(packed.join(resp, "site").select("y", "r").mapInPandas(run, "k int, c int, x double"), params)


def m_step(s: Sums, params: Params, eta: float = 1.0, reg: float = 0.0) -> Params:
    """Weights are replaced; means and covariances move by eta towards the new ones."""
    w = s.s0 / s.n
    d = s.n * np.maximum(w, 1e-10)
    mean = params.means * (s.s0 / d)[:, None] + s.s1 / d[:, None]
    delta = mean - params.means
    if params.full:
        cross = delta[:, :, None] * s.s1[:, None, :]
        cov = (s.s2 - cross - cross.transpose(0, 2, 1) + delta[:, :, None] * delta[:, None, :] * s.s0[:, None, None]) / d[:, None, None] + reg * np.eye(mean.shape[1])
    else:
        cov = (s.s2 - 2 * delta * s.s1 + delta * delta * s.s0[:, None]) / d[:, None] + reg
    return Params(w, (1 - eta) * params.means + eta * mean, (1 - eta) * params.covs + eta * cov)


def eta(epoch: int, alpha: float = 0.7) -> float:
    return (epoch + 2) ** (-alpha)


def responsibilities(packed: DataFrame, params: Params) -> DataFrame:
    """site and r, the array of responsibilities."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                yield pd.DataFrame({"site": pdf["site"], "r": list(params.responsibilities(matrix(pdf))[0])})

    return packed.select("site", "y").mapInPandas(run, "site long, r array<double>")


def long_form(resp: DataFrame) -> DataFrame:
    return resp.select("site", F.posexplode("r").alias("k", "r"))


def array_form(resp: DataFrame) -> DataFrame:
    return resp.groupBy("site").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "r"))), lambda x: x["r"]).alias("r"))


def labels(resp: DataFrame) -> DataFrame:
    """site and label, the first component of the largest responsibility."""
    return resp.select("site", (F.array_position("r", F.array_max("r")) - 1).cast("int").alias("label"))


def spread(packed: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """n, mean and population variance by position."""
    rows = packed.select(F.posexplode("y").alias("t", "v")).groupBy("t").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s")).orderBy("t").collect()
    if not rows:
        raise ValueError("a mixture needs data")
    return rows[0]["n"], np.array([r["m"] for r in rows]), np.array([r["s"] for r in rows])


DRAWS = 2**31 - 1


def drawn(site: Column | int, seed: int, turn: int):
    """A number from 0 to DRAWS - 1 for each site, seed and turn: powers in a prime field, the same in any engine and partitioning."""
    moved = site + (7919 * seed + 104_729 * turn)
    x = (moved % DRAWS if isinstance(site, int) else F.pmod(moved, F.lit(DRAWS))) + 1
    square = lambda y: y * y % DRAWS
    first = square(x * 48_271 % DRAWS)
    return (square((first * x + 40_692) % DRAWS) * 48_271 + x) % DRAWS


def kmeanspp_means(packed: DataFrame, k: int, seed: int = 0) -> np.ndarray:
    """k sites drawn by k-means++; the draw hashes site, seed and round, so partitioning does not matter."""
    chosen: list[np.ndarray] = []
    picked: list[int] = []
    own_cache = not packed.is_cached
    if own_cache:
        packed = packed.persist()  # k passes over it
    for turn in range(k):
        u = (drawn(F.col("site"), seed, turn) + 1) / float(DRAWS + 1)
        if chosen:
            gaps = [F.aggregate(F.zip_with("y", F.lit(m.tolist()), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b) for m in chosen]
            gap = F.least(*gaps) if len(gaps) > 1 else gaps[0]
        else:
            gap = F.lit(1.0)
        ranked = packed.select("site", "y", gap.alias("gap"), u.alias("u")).where(~F.col("site").isin(picked) if picked else F.lit(True))
        row = ranked.orderBy((F.col("gap") > 0).desc(), F.when(F.col("gap") > 0, -F.log("u") / F.col("gap")).otherwise(F.col("u")), "site").limit(1).first()
        if row is None:  # more components than sites: sites repeat
            chosen.append(chosen[turn % len(chosen)])
            continue
        chosen.append(np.array(row["y"]))
        picked.append(row["site"])
    if own_cache:
        packed.unpersist()
    return np.array(chosen)


def gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """(N, C) squared distances."""
    return ((x[:, None, :] - centres[None]) ** 2).sum(axis=2) if x.size * len(centres) < 1 << 24 else np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)


def nearest_sums(packed: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """By nearest centre (the first on ties): sites, and the sum of their values; and the summed squared distance. One pass."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, cost = np.zeros((len(centres), 1 + centres.shape[1])), 0.0
        for pdf in parts:
            if len(pdf):
                x = matrix(pdf)
                d = gaps(x, centres)
                near = d.argmin(axis=1)
                cost += float(d[np.arange(len(x)), near].sum())
                np.add.at(total, near, np.column_stack([np.ones(len(x)), x]))
        yield _emit(total, 0, cost)

    grid = np.zeros((len(centres) + 1, max(2, 1 + centres.shape[1])))
    for r in packed.select("y").mapInPandas(run, "k int, c int, x double").groupBy("k", "c").agg(F.sum("x").alias("x")).collect():  # centres times positions
        grid[r["k"], r["c"]] = r["x"]
    own = grid[:-1, : 1 + centres.shape[1]]
    return own[:, 0], own[:, 1:], float(grid[-1, 1])


def oversampled(packed: DataFrame, k: int, seed: int, rounds: int) -> np.ndarray:
    """Candidates of k-means||: one site, then in each round every site with a chance of 2 k times its share of the cost, so 2 k on average."""
    first = packed.orderBy(drawn(F.col("site"), seed, 0), "site").limit(1).first()
    chosen = np.array([first["y"]], float)
    for turn in range(1, rounds + 1):
        cost = nearest_sums(packed, chosen)[2]
        if cost <= 0:
            break
        known = chosen

        def run(parts: Iterator[pd.DataFrame], known: np.ndarray = known, cost: float = cost) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                if len(pdf):
                    yield pdf[pdf["u"].to_numpy() * cost < 2 * k * gaps(matrix(pdf), known).min(axis=1)][["site", "y"]]

        u = ((drawn(F.col("site"), seed, turn) + 1) / float(DRAWS + 1)).alias("u")
        more = packed.select("site", "y", u).mapInPandas(run, "site long, y array<double>").orderBy("site").collect()
        chosen = np.concatenate([chosen, np.array([r["y"] for r in more], float).reshape(-1, chosen.shape[1])])
    return chosen


def kmeans_means(packed: DataFrame, k: int, seed: int = 0, *, rounds: int = 3, iterations: int = 300, tol: float = 1e-4) -> np.ndarray:
    """Centres of k-means: oversampled candidates, weighted by the sites nearest to them, reduced to k by a weighted draw, then Lloyd's steps.

    A step is one scan with a combine of k rows a task; it ends when the centres move by less than tol in the units of the first
    candidates' spread. A centre without sites stays where it is.
    """
    candidates = oversampled(packed, k, seed, rounds)
    if len(candidates) < k:  # hardly more sites than centres
        centres = kmeanspp_means(packed, k, seed)
    else:
        weight = nearest_sums(packed, candidates)[0]
        picked = [int(weight.argmax())]
        for turn in range(1, k):
            far = gaps(candidates, candidates[picked]).min(axis=1) * weight
            u = np.array([(drawn(c, seed, 1000 + turn) + 1) / (DRAWS + 1) for c in range(len(candidates))])
            rate = np.where(far > 0, -np.log(u) / np.where(far > 0, far, 1.0), np.inf)
            rate[picked] = np.inf
            left = [c for c in range(len(candidates)) if c not in picked]
            picked.append(int(rate.argmin()) if np.isfinite(rate).any() else left[0])
        centres = candidates[picked]
    limit = tol**2 * float(candidates.var(axis=0).mean())
    for _ in range(iterations):
        n, s, _ = nearest_sums(packed, centres)
        moved = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], centres)
        shift = float(((moved - centres) ** 2).sum())
        centres = moved
        if shift <= limit:
            break
    return centres


def init_means(packed: DataFrame, k: int, how: str = "kmeans++", seed: int = 0) -> np.ndarray:
    if how == "kmeans++":
        return kmeanspp_means(packed, k, seed)
    if how == "gaussian":
        _, m, s = spread(packed)
        u = [np.array([[(drawn(c * len(m) + t, seed, turn) + 1) / (DRAWS + 1) for t in range(len(m))] for c in range(k)]) for turn in (0, 1)]
        return m + np.sqrt(-2 * np.log(u[0])) * np.cos(2 * math.pi * u[1]) * np.sqrt(s)  # normal by pairs of uniform draws
    if how in ("sklearn-kmeans", "cuml-kmeans"):
        return kmeans_means(packed, k, seed)
    raise ValueError(f"unknown initial means: {how}")


def start(packed: DataFrame, means: np.ndarray, cov_type: str = "diag", reg: float = 1e-6) -> Params:
    """Equal weights and the data's variance for every component."""
    _, _, var = spread(packed)
    var = np.maximum(var, FLOOR)
    k = len(means)
    if cov_type not in ("diag", "full"):
        raise ValueError("cov_type must be 'diag' or 'full'")
    covs = np.tile(var, (k, 1)) if cov_type == "diag" else np.tile(np.diag(var) + reg * np.eye(len(var)), (k, 1, 1))
    return Params(np.full(k, 1 / k), np.asarray(means, float), covs)


@dataclass
class Config:
    k: int = 4
    cov_type: str = "diag"
    tol: float = 1e-4
    reg: float = 1e-6
    max_iter: int = 100
    solver: str = "batch"
    init: str = "kmeans++"
    means: np.ndarray | None = None
    seed: int = 0
    alpha: float = 0.7
    refine_epochs: int = 0
    refine_tol: float | None = None
    batch_num: int = 1
    max_batch_epoch: int = 50
    max_full_epoch: int = 500
    smoothing_iterations: int = 1
    max_smooth_epoch: int = 500


@dataclass
class Fit:
    params: Params
    resp: DataFrame  # site, r: of the last E-step
    ll: float
    n: int
    epochs: int = 0
    converged: bool = True
    history: list[float] = field(default_factory=list)

    def labels(self) -> DataFrame:
        return labels(self.resp)


class EpochLog:
    """Epochs of a fit in a shared folder: a fit that starts again with the same folder goes on from the last whole epoch.

    An epoch is one small Parquet folder, complete once Spark has committed it; parameters are exact, as JSON numbers round-trip.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, epoch: int, state: dict) -> None:
        text = json.dumps({k: [x.tolist() for x in (v.weights, v.means, v.covs)] if isinstance(v, Params) else v for k, v in state.items()})
        self.spark.createDataFrame([(epoch, text)], "epoch int, state string").coalesce(1).write.mode("append").parquet(self.path)

    def load(self) -> dict | None:
        try:
            row = self.spark.read.schema("epoch int, state string").parquet(self.path).orderBy(F.col("epoch").desc()).first()
        except AnalysisException:  # nothing was saved yet
            return None
        return None if row is None else {k: Params(*map(np.array, v)) if k in ("p", "last") else v for k, v in json.loads(row["state"]).items()}


def fit_many(packed: DataFrame, starts: list[Params], cfg: Config, log: EpochLog | None = None) -> list[tuple[Params, list[float], bool]]:
    """Batch EM of several mixtures side by side: parameters, likelihoods by epoch, whether it converged.

    Every epoch is one scan that advances all fits that have not converged. A last scan gives the likelihood of those that never do;
    the last of the likelihoods is always that of the parameters.
    """
    done: dict[int, bool] = {}
    ps, histories = list(starts), [[] for _ in starts]
    first = 0
    if log is not None and len(starts) == 1 and (saved := log.load()) is not None:
        ps, histories, first = [saved["p"]], [saved["history"]], saved["epoch"]
    for epoch in range(first, cfg.max_iter + 1):
        going = [m for m in range(len(ps)) if m not in done]
        if not going:
            break
        for m, s in zip(going, sums_many(packed, [ps[m] for m in going]), strict=True):
            h = histories[m]
            h.append(s.ll)
            if epoch == cfg.max_iter:
                done[m] = False
            elif len(h) > 1 and abs(h[-1] - h[-2]) / s.n < cfg.tol:
                done[m] = True
            else:
                ps[m] = m_step(s, ps[m], 1.0, cfg.reg)
                if log is not None:
                    log.save(epoch + 1, {"epoch": epoch + 1, "p": ps[m], "history": h})
    return [(p, h, done[m]) for m, (p, h) in enumerate(zip(ps, histories, strict=True))]


#: Storage cells of mini-batches, and the turn of the draw that deals sites to them.
CELLS, CELL_TURN = 64, 10_000


def cell_of(site: Column, seed: int) -> Column:
    """The storage cell of a site: a draw that never changes."""
    return (drawn(site, seed, CELL_TURN) % CELLS).cast("int")


def batch_of(cell: int, seed: int, epoch: int, n: int) -> int:
    """Mini-batch of a cell, drawn anew for each epoch."""
    return drawn(cell, seed, epoch) % n


def by_cells(packed: DataFrame, seed: int) -> DataFrame:
    """packed in files by cell, so that a batch, which is some of the cells, reads its own files only."""
    spark = packed.sparkSession
    path = f"{shared_folder(spark)}/cells-{uuid.uuid4().hex}"
    spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // CELLS)  # tasks a cell
    placed = packed.select("site", "y", cell_of(F.col("site"), seed).alias("cell"))
    placed.repartition("cell", F.pmod(F.xxhash64("site"), F.lit(spread))).write.partitionBy("cell").parquet(path)
    return spark.read.schema(placed.schema).parquet(path)


def _stepwise(packed: DataFrame, p: Params, cfg: Config, smooth: Smoother | None) -> tuple[Params, Params, list[float], bool]:
    """Mini-batches of seeded cells, then full passes; returns also the parameters of the last E-step.

    A full pass yields the likelihood of the parameters it starts from, so it also closes the epoch before.
    """
    epoch, history, last = 0, [-1e6], p
    change = math.inf
    cells = by_cells(packed, cfg.seed) if cfg.batch_num > 1 else None
    ahead: Sums | None = None  # sums for p, where a pass has made them
    while change > cfg.tol and epoch < cfg.max_batch_epoch:
        if cells is None:
            last, s = p, ahead or sums(packed, p)
            p = m_step(s, p, eta(epoch, cfg.alpha)) if s.n else p
        else:
            for b in range(cfg.batch_num):
                mine = [c for c in range(CELLS) if batch_of(c, cfg.seed, epoch, cfg.batch_num) == b]
                last, s = p, sums(cells.where(F.col("cell").isin(mine)), p)
                p = m_step(s, p, eta(epoch, cfg.alpha)) if s.n else p
        ahead = sums(packed, p)
        history.append(ahead.ll)
        change = abs(history[-1] - history[-2])
        epoch += 1
    done = change <= cfg.tol
    for _ in range(cfg.max_full_epoch + 1 if not done or smooth is not None else 0):
        last = p
        p, _ = smoothed_step(packed, p, cfg, smooth, epoch) if smooth is not None else (m_step(ahead or sums(packed, p), p, eta(epoch, cfg.alpha)), None)
        ahead = sums(packed, p)
        history.append(ahead.ll)
        epoch += 1
        if abs(history[-1] - history[-2]) <= cfg.tol:
            done = True
            break
    return p, last, history[1:], done


def smoothed_step(packed: DataFrame, p: Params, cfg: Config, smooth: Smoother, epoch: int) -> tuple[Params, DataFrame]:
    """One step whose responsibilities (site, r) are smoothed between E and M."""
    resp = cut(smooth(responsibilities(packed, p)))
    return m_step(sums_given(packed, resp, p), p, eta(epoch, cfg.alpha)), resp


def fit(packed: DataFrame, cfg: Config, edges: DataFrame | Smoother | None = None, *, params: Params | None = None, log: EpochLog | None = None) -> Fit:
    """Fit a mixture; edges (i, j, w), or any smoother of responsibilities, act between E and M. Labels follow the last E-step.

    log: where a batch fit's epochs are kept; an interrupted fit goes on from there.
    """
    smooth = smoother(edges, cfg.smoothing_iterations) if isinstance(edges, DataFrame) else edges
    if cfg.solver not in ("batch", "stepwise"):
        raise ValueError("solver must be 'batch' or 'stepwise'")
    p = params or start(packed, cfg.means if cfg.means is not None else init_means(packed, cfg.k, cfg.init, cfg.seed), cfg.cov_type, cfg.reg)
    resp: DataFrame | None = None
    if cfg.solver == "batch":
        p, history, done = fit_many(packed, [p], cfg, log)[0]
        last = p
        if smooth is not None:
            before = -1e6
            done = False
            for epoch in range(cfg.max_smooth_epoch):
                p, resp = smoothed_step(packed, p, cfg, smooth, epoch)
                history.append(sums(packed, p).ll)
                if abs(history[-1] - before) <= cfg.tol:
                    done = True
                    break
                before = history[-1]
        else:
            ahead = sums(packed, p) if cfg.refine_epochs else None
            for epoch in range(cfg.refine_epochs):
                last = p
                p = m_step(ahead, p, eta(epoch, cfg.alpha))
                ahead = sums(packed, p)
                history.append(ahead.ll)
                if cfg.refine_tol is not None and len(history) > 1 and abs(history[-1] - history[-2]) <= cfg.refine_tol:
                    break
    else:
        p, last, history, done = _stepwise(packed, p, cfg, smooth)
        if smooth is not None:
            resp = smooth(responsibilities(packed, last))
    n = packed.count()
    ll = history[-1] if history else sums(packed, p).ll
    return Fit(p, resp if resp is not None else responsibilities(packed, last), ll, n, len(history), done, history)


def param_table(spark: SparkSession, p: Params) -> DataFrame:
    """k, t, w, mu, var of a mixture (the diagonal, for full covariances)."""
    var = np.maximum(np.diagonal(p.covs, axis1=1, axis2=2), 0) if p.full else p.covs
    rows = [(k, t, float(p.weights[k]), float(p.means[k, t]), float(var[k, t])) for k in range(p.k) for t in range(p.means.shape[1])]
    return spark.createDataFrame(rows, "k int, t int, w double, mu double, var double")


def relabelled(p: Params, order: list[int]) -> Params:
    """The mixture with component order[new] at place new."""
    return replace(p, weights=p.weights[order], means=p.means[order], covs=p.covs[order])


def sizes(label_table: DataFrame, k: int) -> DataFrame:
    """label and n, empty components included."""
    counts = label_table.groupBy("label").agg(F.count("*").alias("n"))
    return label_table.sparkSession.range(k).select(F.col("id").cast("int").alias("label")).join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def discovery(p: Params, counts: dict[int, int]) -> int:
    """The component whose mean varies most over t; components of fewer than two sites score 0; the first on ties."""
    scores = [float(np.std(p.means[k])) if counts.get(k, 0) >= 2 else 0.0 for k in range(p.k)]
    return int(np.argmax(scores))

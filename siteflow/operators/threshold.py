"""Background cutoffs on the log of a site's mean."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteflow.operators.order_stats import order_statistics

EPS = 2.220446049250313e-16
#: Most bins that a search takes to the driver (four numbers each); their number grows with the cube root of the sites.
MOST_BINS = 2_000_000
SNAP = 1e-9  # a step below this is rounding noise: an empty bin leaves the divergence as it is


def log_mean(cube: DataFrame) -> DataFrame:
    """site and x, the natural log of its mean; sites without a positive mean have none."""
    means = cube.groupBy("site").agg((F.sum("v") / F.count("*")).alias("m"))
    return means.where("m > 0").select("site", F.log("m").alias("x"))


def log_mean_packed(packed: DataFrame) -> DataFrame:
    """The same from packed trajectories (site, y), without an exchange; y stays beside x."""
    mean = F.aggregate("y", F.lit(0.0), lambda a, v: a + v) / F.size("y")
    return packed.select("site", "y", mean.alias("m")).where("m > 0").select("site", "y", F.log("m").alias("x"))


def half_even(n: int, share: float) -> int:
    return round(n * share)


def bin_width(x: DataFrame) -> tuple[int, float, float]:
    """n, interquartile range by picked order statistics (half-even index) and the width: range over cube root of n."""
    n = x.count()
    low, high = half_even(n, 0.25), half_even(n, 0.75)
    if n < 3:
        raise ValueError("the width needs at least three sites")
    q1, q3 = order_statistics(x, "x", [low, high])
    return n, q3 - q1, (q3 - q1) / n ** (1 / 3)


@dataclass
class Histogram:
    n: int
    width: float
    low: float
    high: float
    mean: float
    std: float
    n_bins: int

    def edge(self, i: int) -> float:
        return self.low + (self.high - self.low) * i / self.n_bins


def binned(x: DataFrame, width: float | None = None) -> tuple[Histogram, DataFrame]:
    """The histogram's frame, and its bins as a DataFrame: bin, n, s, ss, every bin present.

    Equal bins over [min, max], as many as fit the width; the right edge counts to the last bin.
    """
    if width is None:
        n, _, width = bin_width(x)
    n, low, high, mean, std = x.agg(F.count("*"), F.min("x"), F.max("x"), F.avg("x"), F.stddev_pop("x")).first()
    if width <= 0:
        raise ValueError("a histogram needs a positive bin width")
    nb = max(1, math.ceil((high - low) / width))
    if nb > MOST_BINS:
        raise ValueError(f"{nb} bins: the range is too wide for the width {width}; give a width")
    h = Histogram(n, width, low, high, mean, std, nb)
    spread = F.lit(high - low if high > low else 1.0)
    where = F.least(F.floor((F.col("x") - F.lit(low)) / spread * nb), F.lit(nb - 1)).cast("int")
    sums = x.groupBy(where.alias("bin")).agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum((F.col("x") - mean) * (F.col("x") - mean)).alias("ss"))
    bins = x.sparkSession.range(nb).select(F.col("id").cast("int").alias("bin")).join(sums, "bin", "left")
    return h, bins.select("bin", F.coalesce("n", F.lit(0)).alias("n"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("s", "ss")])


def density(h: Histogram, bins: DataFrame) -> DataFrame:
    """bin, left edge, count and density (count over n and the asked width)."""
    edge = F.lit(h.low) + F.lit(h.high - h.low) * F.col("bin") / h.n_bins
    return bins.select("bin", edge.alias("left_edge"), F.col("n").cast("long").alias("n"), (F.col("n") / (h.n * h.width)).alias("density"))


def divergence(h: Histogram, bins: DataFrame) -> DataFrame:
    """i, kl, mean, std: the divergence of the bins below i from the Gaussian fitted to the samples below i's edge, for every i.

    A table for inspection, in Arrow blocks of i over the bins that hold samples; the search for a cutoff asks for single indices.
    """
    spark = bins.sparkSession
    shipped = spark.sparkContext.broadcast(Divergence.of(h, bins))  # at most MOST_BINS bins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.column(0).to_numpy()
            yield pa.record_batch([pa.array(i.astype(np.int32)), *map(pa.array, shipped.value.table(i))], names=["i", "kl", "mean", "std"])

    return spark.range(1, h.n_bins + 1).mapInArrow(run, "i int, kl double, mean double, std double")


class Divergence:
    """Divergences from sums of the bins that hold samples.

    With q the Gaussian plus FLOOR and p the bins' share, sum p ln(p / q) below an index is made of prefix sums of y ln y, y, y x and
    y x x for y the densities, as long as the floor does not matter; bins so far out that it does (the Gaussian is below SURE) are
    corrected one by one. Where the Gaussian is too narrow for that (only a few bins lie below) every bin is summed.
    """

    FLOOR, SURE, NARROW = 1e-12, 1e-3, 1e6

    def __init__(self, h: Histogram, rows: list):
        self._take(h, *(np.array([r[c] for r in rows], float) for c in ("n", "s", "ss")), np.arange(len(rows)))

    @classmethod
    def of(cls, h: Histogram, bins: DataFrame) -> Divergence:
        """From a table of bins: four Arrow columns, of at most MOST_BINS rows."""
        held = bins.where("n > 0").orderBy("bin").toArrow()
        made = cls.__new__(cls)
        made._take(h, *(held.column(c).to_numpy().astype(float) for c in ("n", "s", "ss")), held.column("bin").to_numpy())
        return made

    def _take(self, h: Histogram, n: np.ndarray, s: np.ndarray, ss: np.ndarray, at: np.ndarray) -> None:
        some = n > 0
        self.h, self.at, self.n = h, at[some].astype(np.int64), n[some]
        self.x = h.low + (h.high - h.low) * self.at / h.n_bins
        self.y = self.n / (h.n * h.width)
        far = self.x - h.mean
        prefix = lambda v: np.concatenate([[0.0], np.cumsum(v)])
        self.sums = [prefix(v) for v in (self.n, s[some], ss[some], self.y, self.y * np.log(self.y), self.y * far, self.y * far * far)]
        self.known: dict[int, float] = {}

    def edge_at_least(self, v: float) -> int:
        """The first bin whose left edge is not below v; n_bins if there is none."""
        h = self.h
        guess = int(np.clip((v - h.low) / ((h.high - h.low) or 1.0) * h.n_bins, 0, h.n_bins)) if math.isfinite(v) else (h.n_bins if v > 0 else 0)
        while guess > 0 and h.edge(guess - 1) >= v:
            guess -= 1
        while guess < h.n_bins and h.edge(guess) < v:
            guess += 1
        return guess

    def peak(self) -> int:
        return int(self.at[np.argmax(self.n)])

    def fits(self, i: np.ndarray) -> tuple[np.ndarray, ...]:
        """Bins with samples below i, their mass, and mean and deviation of the samples below i's edge; with none, the smallest sample alone."""
        m = np.searchsorted(self.at, i)
        c, s, ss = (x[m] for x in self.sums[:3])
        some = np.maximum(c, 1)
        mean = np.where(c > 0, s / some, self.h.low)
        var = np.where(c > 0, np.maximum(0.0, ss / some - (mean - self.h.mean) ** 2), 0.0)
        mass = np.maximum(c / (self.h.n * self.h.width) * (self.h.high - self.h.low) / self.h.n_bins, EPS)
        return m, mass, mean, np.maximum(np.sqrt(var), EPS)

    def fit(self, i: int) -> tuple[float, float]:
        _, _, mean, std = self.fits(np.array([i]))
        return float(mean[0]), float(std[0])

    def table(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """kl, mean and std at the indices i, all within 1 and the number of bins."""
        m, mass, mean, std = self.fits(i)
        y, plain, first, second = (x[m] for x in self.sums[3:])
        d, scale = mean - self.h.mean, np.log(std * math.sqrt(2 * math.pi))
        kl = (plain - y * np.log(mass) + 0.5 * (second - 2 * d * first + d * d * y) / std**2 + y * scale) / mass
        if not len(self.x):
            return np.zeros(len(i)), mean, std
        widest = np.maximum(np.abs(self.x[0] - mean), np.abs(self.x[np.maximum(m - 1, 0)] - mean)) / std
        narrow = np.maximum(widest, np.abs(d) / std) ** 2 > self.NARROW
        reach = np.sqrt(np.maximum(0.0, -2 * (math.log(self.SURE) + scale))) * std
        left = np.where(narrow, m, np.minimum(np.searchsorted(self.x, mean - reach), m))
        right = np.where(narrow, m, np.clip(np.searchsorted(self.x, mean + reach, "right"), left, m))
        count = left + m - right
        kl[narrow] = 0.0
        for part in np.split(np.arange(len(i)), np.flatnonzero(np.diff(np.cumsum(count) >> 20)) + 1):
            row = np.repeat(part, count[part])
            nth = np.arange(len(row)) - np.repeat(np.cumsum(count[part]) - count[part], count[part])
            j = np.where(nth < left[row], nth, nth - left[row] + right[row])
            z = (self.x[j] - mean[row]) / std[row]
            log_pdf = -0.5 * z * z - scale[row]
            p, log_q = self.y[j] / mass[row], np.log(np.exp(log_pdf) + self.FLOOR)
            # A narrow fit's bins are summed whole, others lose what their sums took for the floor.
            kl += np.bincount(row, p * np.where(narrow[row], np.log(p) - log_q, log_pdf - log_q), minlength=len(i))
        return kl, mean, std

    def __call__(self, i: int) -> float:
        if not 1 <= i <= self.h.n_bins:
            return math.inf
        if i not in self.known:
            self.known[i] = float(self.table(np.array([i]))[0][0])
        return self.known[i]


def truncate(h: Histogram, kl: Divergence, max_iter: int = 100) -> int:
    """Index at which the search for a flat divergence ends; no step touches the data."""
    nb = h.n_bins
    # Left-inclusive search among the left edges.
    at = kl.edge_at_least
    value = lambda i: max(kl(min(i, nb - 1)), EPS)
    peak = kl.peak()
    i = int(0.5 * peak + 0.5 * at(h.mean + h.std))
    i = peak - 2 if i >= nb else i
    i = max(i, 0)
    step, turn = math.inf, 0
    while step > h.width and turn < max_iter:
        move = math.log(value(i + 1)) - math.log(value(i)) if i > 0 else -math.inf
        if abs(move) < SNAP:
            move = 0.0
        step = abs(move)
        if math.isnan(step):
            break
        i = at(h.edge(i) - move) if math.isfinite(move) else nb
        i = max(nb - 2, 0) if i >= nb else i
        turn += 1
    return i


@dataclass
class Cutoff:
    value: float
    kind: str
    mean: float | None = None
    std: float | None = None
    index: int | None = None
    success: bool | None = None


def cutoff(x: DataFrame, kind: str = "KL", *, width: float | None = None, max_iter: int = 100, set_cutoff: float = -1e6) -> Cutoff:
    """The cutoff on log means: `KL`, `simple` (mean and two deviations) or any other name for set_cutoff."""
    if kind == "simple":
        mean, std = x.agg(F.avg("x"), F.stddev_pop("x")).first()
        return Cutoff(mean + 2 * std, kind, mean, std)
    if kind != "KL":
        return Cutoff(set_cutoff, kind)
    h, bins = binned(x, width)
    kl = Divergence.of(h, bins)
    i = truncate(h, kl, max_iter)
    value = h.edge(i)
    mean, std = kl.fit(max(i, 1))
    return Cutoff(value, kind, mean, std, i, h.mean - h.std <= value <= h.mean + 2 * h.std)


def above(x: DataFrame, cut: Cutoff) -> DataFrame:
    """Sites strictly above the cutoff; NaN never is."""
    return x.where((F.col("x") > F.lit(cut.value)) & ~F.isnan("x")).select("site")


def above_packed(x: DataFrame, cut: Cutoff) -> DataFrame:
    """site and y of the packed sites strictly above the cutoff: a filter, without a join."""
    return x.where((F.col("x") > F.lit(cut.value)) & ~F.isnan("x")).select("site", "y")


def high_variance(cube: DataFrame, cutoff: float = 0.5) -> DataFrame:
    """site, std over t, and whether it is at least the cutoff."""
    return cube.groupBy("site").agg(F.stddev_pop("v").alias("std")).withColumn("high", F.col("std") >= cutoff)

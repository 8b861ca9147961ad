"""Distributed selection against sorting, and divergences from prefix sums against summing every bin."""

import math
import random
import struct

import numpy as np
import pytest

from siteflow.operators import order_stats, threshold


def table(spark, values, parts=5):
    return spark.createDataFrame([(v,) for v in values], "x double").repartition(parts)


def samples(seed):
    draw = random.Random(seed)
    bits = [struct.unpack("d", struct.pack("Q", draw.getrandbits(64)))[0] for _ in range(300)]
    near = [1.0 + k * 2.0**-52 for k in range(50)]
    return [v for v in bits if not math.isnan(v)] + near + [0.0, -0.0, math.inf, -math.inf, 5e-324, -5e-324] + [3.25] * 200


def test_keys_keep_the_order():
    values = sorted(samples(1))
    k = order_stats.keys(np.array(values))
    assert (k[1:] >= k[:-1]).all()
    assert all(order_stats.value_of(int(a)) == b for a, b in zip(k, values, strict=True))
    assert order_stats.keys(np.array([-math.nan]))[0] > order_stats.keys(np.array([math.inf]))[0]


@pytest.mark.parametrize("few", [1, 40, 1 << 14])
def test_any_rank(spark, monkeypatch, few):
    """With few values picked at a time, down to the last bit."""
    monkeypatch.setattr(order_stats, "FEW", few)
    values = samples(few)
    ranks = [0, 1, 7, 100, len(values) // 2, len(values) // 2 + 1, len(values) - 2, len(values) - 1, 7]
    got = order_stats.order_statistics(table(spark, [*values, None, math.nan]), "x", ranks)
    assert got == [sorted(values)[r] for r in ranks]
    assert math.isnan(order_stats.order_statistics(table(spark, [*values, math.nan]), "x", [len(values)])[0])


def test_no_such_rank(spark):
    with pytest.raises(IndexError):
        order_stats.order_statistics(table(spark, [1.0, 2.0]), "x", [2])
    with pytest.raises(IndexError):
        order_stats.order_statistics(table(spark, [None]), "x", [0])


def test_width_has_no_percentile(spark, monkeypatch):
    seen = []
    run = type(spark.range(1)).collect
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda df: seen.append(df._jdf.queryExecution().toString()) or run(df))
    values = samples(3)[-200:] + [float(k * k) for k in range(100)]
    n, iqr, width = threshold.bin_width(table(spark, values))
    low, high = (sorted(values)[round(n * q)] for q in (0.25, 0.75))
    assert (iqr, width) == (high - low, (high - low) / n ** (1 / 3))
    assert seen and not any("percentile" in s for s in seen)


def plain(h, n, s, ss, i):
    """The definition, bin by bin."""
    c, total, squares = sum(n[:i]), sum(s[:i]), sum(ss[:i])
    mean = total / c if c else h.low
    std = max(math.sqrt(max(0.0, squares / c - (mean - h.mean) ** 2)) if c else 0.0, threshold.EPS)
    mass = max(c / (h.n * h.width) * (h.high - h.low) / h.n_bins, threshold.EPS)
    out = 0.0
    for k in range(i):
        z = (h.edge(k) - mean) / std
        q = math.exp(-0.5 * z * z) / (std * math.sqrt(2 * math.pi)) + 1e-12
        p = n[k] / (h.n * h.width) / mass
        out += p * math.log(p / q) if p > 0 else 0.0
    return out


@pytest.mark.parametrize("kind", ["smooth", "outliers", "two heaps", "spike", "wide"])
def test_divergences_by_prefix_sums(kind):
    draw = random.Random(kind)
    values = {
        "smooth": [draw.gauss(0, 1) for _ in range(4000)],
        "outliers": [draw.gauss(0, 1e-3) for _ in range(2000)] + [5.0, 5.1, 9.0, -3.0],
        "two heaps": [draw.gauss(-40, 0.01) for _ in range(1000)] + [draw.gauss(40, 3) for _ in range(1000)],
        "spike": [1.5] * 3000 + [2.0, 7.5],
        "wide": [draw.gauss(0, 1) * 10 ** draw.uniform(0, 3) for _ in range(3000)],
    }[kind]
    x = np.array(values)
    nb = 400
    h = threshold.Histogram(len(x), float(x.max() - x.min()) / (nb - 0.3), float(x.min()), float(x.max()), float(x.mean()), float(x.std()), nb)
    at = np.minimum(((x - h.low) / (h.high - h.low) * nb).astype(int), nb - 1)
    n, s, ss = (np.bincount(at, w, minlength=nb) for w in (np.ones(len(x)), x, (x - h.mean) ** 2))
    made = threshold.Divergence(h, [{"n": a, "s": b, "ss": c} for a, b, c in zip(n, s, ss, strict=True)])
    kl, _, _ = made.table(np.arange(1, nb + 1))
    want = [plain(h, n, s, ss, i) for i in range(1, nb + 1)]
    assert kl == pytest.approx(want, rel=1e-6, abs=1e-6)
    edges = [h.edge(k) for k in range(nb)]
    for v in [*edges[::37], -1e9, 1e9, math.inf, -math.inf, h.mean]:
        assert made.edge_at_least(v) == int(np.searchsorted(edges, v, "left"))
    assert made.peak() == int(np.argmax(n))

"""Tiles against plain versions: components, stencils and the torus, for sides that cut through everything."""

import itertools
import math
import random

import pytest

from siteflow.functions import graph
from siteflow.operators import edges, peaks, tiles


def plain_roots(sites, sizes):
    left, out = set(sites), {}
    rank = len(sizes)
    for s in sorted(sites):
        if s not in left:
            continue
        todo = [s]
        left.discard(s)
        while todo:
            x = todo.pop()
            out[x] = s
            place, rest = [], x
            for n in reversed(sizes):
                place.insert(0, rest % n)
                rest //= n
            for o in itertools.product((-1, 0, 1), repeat=rank):
                p = [a + b for a, b in zip(place, o, strict=True)]
                if all(0 <= a < n for a, n in zip(p, sizes, strict=True)):
                    y = 0
                    for a, n in zip(p, sizes, strict=True):
                        y = y * n + a
                    if y in left:
                        left.discard(y)
                        todo.append(y)
    return out


def site_table(spark, sites):
    return spark.createDataFrame([(s,) for s in sites], "site long").repartition(5)


@pytest.mark.parametrize(("sizes", "side", "share"), [([37, 41], 8, 0.3), ([37, 41], 5, 0.45), ([9, 11, 13], 4, 0.15), ([9, 11, 13], 2, 0.2), ([30, 3], 128, 0.5)])
def test_components(spark, sizes, side, share):
    draw = random.Random(side)
    sites = [s for s in range(math.prod(sizes)) if draw.random() < share]
    want = plain_roots(sites, sizes)
    assert {r["site"]: r["root"] for r in tiles.connected(site_table(spark, sites), sizes, side).collect()} == want
    number = {r: k for k, r in enumerate(sorted(set(want.values())))}
    assert {r["site"]: r["peak"] for r in peaks.label(site_table(spark, sites), sizes, side).collect()} == {s: number[r] for s, r in want.items()}


def test_long_snake_over_many_tiles(spark):
    snake = [r * 21 + c for r in range(21) for c in range(21) if r % 2 == 0 or c == (20 if r % 4 == 1 else 0)]
    got = tiles.connected(site_table(spark, snake), [21, 21], 3)
    assert {r["root"] for r in got.collect()} == {0}


def test_unfinished_components_raise(spark):
    line = spark.createDataFrame([(k, k + 1) for k in range(200)], "a long, b long")
    with pytest.raises(RuntimeError):
        graph.least_reachable(line, rounds=2)
    assert {r["root"] for r in graph.least_reachable(line).collect()} == {0}


def resp_table(spark, sites, k, seed):
    draw = random.Random(seed)
    return spark.createDataFrame([(s, [draw.random() for _ in range(k)]) for s in sites], "site long, r array<double>").repartition(3)


def near(a, b):
    assert a.keys() == b.keys()
    for key, x in a.items():
        assert x == pytest.approx(b[key], rel=1e-9, abs=1e-12)


@pytest.mark.parametrize(("sizes", "side", "scale", "uniform"), [([23, 19], 4, 1.0, True), ([23, 19], 3, 2.0, False), ([7, 8, 9], 2, 1.0, False), ([23, 19], 128, 0.05, True)])
def test_stencil_equals_edges(spark, sizes, side, scale, uniform):
    """Halos of one and of several tiles."""
    draw = random.Random(7)
    sites = [s for s in range(math.prod(sizes)) if draw.random() < 0.6]
    resp = resp_table(spark, sites, 3, 1)
    by_edges = edges.smoother(edges.local_edges(resp.select("site"), sizes, scale, uniform=uniform), 2)(resp)
    by_tiles = edges.near_smoother(sizes, scale, 2, uniform=uniform, side=side)(resp)
    near({r["site"]: r["r"] for r in by_tiles.collect()}, {r["site"]: r["r"] for r in by_edges.collect()})


@pytest.mark.parametrize("uniform", [True, False])
def test_torus_equals_classes(spark, uniform):
    sizes, unit = [12, 20], [6, 5]
    draw = random.Random(9)
    sites = [s for s in range(240) if draw.random() < 0.7]
    resp = resp_table(spark, sites, 2, 2)
    classes = {(r["class"], r["other"]): r["w"] for r in edges.periodic_classes(resp.select("site"), sizes, unit, 0.6, uniform=uniform).collect()}
    of = {r["site"]: r["class"] for r in edges.residues(resp.select("site"), sizes, unit).collect()}
    value = {r["site"]: r["r"] for r in resp.collect()}
    for times in (1, 2):
        if times == 2:
            value = want  # noqa: F821
        want = {s: [sum(classes.get((of[s], of[o]), 0.0) * value[o][k] for o in sites) for k in range(2)] for s in sites}
        near({r["site"]: r["r"] for r in edges.periodic_smoother(sizes, unit, 0.6, times, uniform=uniform)(resp).collect()}, want)


def test_large_unit_cell(spark):
    """A million residues: sites of equal residue average, others are too far for the kernel."""
    sizes = [300, 200, 100]
    one, other = 0, (100 * 200 + 100) * 100
    resp = spark.createDataFrame([(one, [1.0, 0.0]), (other, [0.0, 1.0]), (50 * 200 * 100, [0.25, 0.75])], "site long, r array<double>")
    got = {r["site"]: r["r"] for r in edges.periodic_smoother(sizes, [100, 100, 100], 0.05)(resp).collect()}
    near(got, {one: [0.5, 0.5], other: [0.5, 0.5], 50 * 200 * 100: [0.25, 0.75]})


def test_ranks_and_empty(spark):
    with pytest.raises(ValueError):
        tiles.connected(site_table(spark, [0]), [4])
    assert tiles.connected(site_table(spark, [0]).limit(0), [4, 4]).count() == 0
    assert tiles.stencil(resp_table(spark, [0], 2, 0).limit(0), [4, 4], edges.local_offsets(2, 1.0)).count() == 0


def test_one_exchange_a_step(spark):
    resp = resp_table(spark, range(50), 2, 3)
    plan = edges.near_smoother([10, 10], 1.0, side=4)(resp)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan

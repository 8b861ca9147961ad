"""SimHash classes against plain versions: fingerprints by another library, links by comparing all pairs."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from siteflow.llm import catalog, simhash_join
from siteflow.llm.common import table

SF = "/root/testdata/sf0.001"


def fingerprint(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(ws[k : k + 3]) for k in range(len(ws) - 2)] if len(ws) > 2 else [" ".join(ws)] if ws else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    """doc_id, fingerprint, component_id of (doc_id, fingerprint)."""
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(fps):
        for b in fps[:k]:
            if (a ^ b).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, f in rows:
        r = find(f)
        known = [x for x in (least.get(r), i) if x is not None]
        least[r] = min(known, default=None)
    return [(i, f"{f:016x}", least[find(f)]) for i, f in rows]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))


def test_query(spark):
    rows = [(r["doc_id"], fingerprint(r["text"])) for r in table(spark, SF, "documents").collect()]
    want = brute(rows)
    assert len({r[2] for r in want}) < len(want)
    assert ordered(catalog.op12_simhash(spark, SF).collect()) == ordered(want)


def clustered(draw, n):
    """Fingerprints in clusters: chains of one or two flipped bits, dense balls, and many that share most bits."""
    out = {0, 1, 3, 2**63, 2**64 - 1, draw.getrandbits(64)}
    while len(out) < n:
        x = draw.choice(sorted(out)[-40:]) if draw.random() < 0.5 else draw.getrandbits(64)
        for _ in range(draw.randint(1, 4)):
            for _ in range(draw.choice([1, 2, 2, 3])):
                x ^= 1 << draw.randrange(64)
            out.add(x)
    base = draw.getrandbits(64)
    return list(out | {base ^ draw.getrandbits(14) for _ in range(n // 2)})


@pytest.mark.parametrize(("most_rows", "seed"), [(1, 1), (40, 2), (1 << 13, 3)])
def test_links_of_any_group_size(spark, most_rows, seed):
    """Small limits deal groups again and again, down to few bits."""
    fps = clustered(random.Random(seed), 500)
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    found = simhash_join.links(spark.createDataFrame([(f,) for f in signed], "fp long"), most_rows=most_rows).collect()
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in found:
        a, b = find(r["a"] % (1 << 64)), find(r["b"] % (1 << 64))
        root[max(a, b)] = min(a, b)
    want = {i: c for i, _, c in brute([(f, f) for f in fps])}
    assert {f: find(f) for f in fps} == want
    assert len(found) < 20 * len(fps)


def test_one_index_finds_every_pair():
    import numpy as np

    draw = random.Random(5)
    fps = sorted(clustered(draw, 800), key=lambda x: x ^ x >> 1)
    index = simhash_join.Index(np.array(fps, np.uint64), np.array([0]))
    got = {(int(a), int(b)) for x, y in index.pairs(2) for a, b in zip(x, y, strict=True)}
    assert got == {(i, j) for j in range(len(fps)) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= 2}


def test_odd_rows(spark):
    long = " ".join(f"w{k % 991}" for k in range(200_000))
    rows = [(1, "a b c d"), (2, None), (3, ""), (4, " \t\n"), (5, long), (6, "A b C d"), (7, "one"), (8, "one two"), (7, "one"), (None, "lost words here"), (None, "a b c d"), (9, "é 漢字 😀 x"), (10, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("fp", "v", "key", "path", "fixed", "rank", "first", "component_id")})
    assert ordered(simhash_join.classes(docs).collect()) == ordered(brute([(i, fingerprint(t)) for i, t in rows]))
    assert simhash_join.classes(docs.limit(0)).count() == 0

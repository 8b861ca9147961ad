"""Spelling variants against their SQL and against a plain comparison of all words, with any number of ranges."""

import random
import zlib
from collections import Counter

import pytest
from oracle import same
from pyspark.sql import functions as F

from siteflow.llm import catalog, spelling_variants
from siteflow.llm.oracles import ORACLES

SF = "/root/testdata/sf0.001"


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def brute(counts):
    near = {w: [v for v in counts if one_apart(w, v)] for w in counts}
    best = {w: min(vs, key=lambda v: (-counts[v], v.encode())) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if counts[v] >= 5 * counts[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n, len(near[w]), counts[form[w]] if w in form else None) for w, n in counts.items())


def got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_equals_sql(spark):
    same(catalog.op11_spelling_variants(spark, SF), ORACLES["op11_spelling_variants"], SF)


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_dense_vocabulary(spark, parts):
    """Few letters, so that words have many neighbours, repeated letters and long chains of forms."""
    draw = random.Random(parts)
    counts = {"".join(draw.choices("abé", k=draw.randint(5, 8))): draw.choice([1, 5, 6, 30, 150, 800, 4000]) for _ in range(500)}
    counts |= {"x" * 3000: 5, "x" * 2999: 40, "x" * 1500 + "y" + "x" * 1499: 300, "ÿ" * 6: 7, "ÿ" * 5 + "z": 7}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert got(spelling_variants.group(words, parts=parts)) == brute(counts)


def test_one_word_and_none(spark):
    words = spark.createDataFrame([("single", 9)], "word string, n long")
    assert got(spelling_variants.group(words)) == [("single", None, "single", 9, 0, None)]
    assert spelling_variants.group(words.limit(0)).count() == 0


def test_occurrences_of_odd_texts(spark):
    rows = [(1, "Straße STRASSE straße×÷ übermütig x1Überm"), (2, None), (3, ""), (None, "nobody nobody"), (4, "word" * 30_000), (5, "short many-hyphens façade"), (5, "short many-hyphens façade")] + [(k, "planted variants") for k in range(10, 2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("word", "n", "run", "h", "d")})
    want = Counter()
    for i, t in rows:
        run = ""
        for c in (t or "") + "\n":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
                continue
            if run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                want[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
            run = ""
    seen = spelling_variants.vocabulary(docs).collect()
    assert {r["word"]: r["n"] for r in seen} == {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}
    assert spelling_variants.variants(docs.limit(0)).count() == 0

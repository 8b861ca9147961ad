"""Operators against plain versions on the smallest tables, with the parameters of the queries."""

import collections
import hashlib
import math
import re

import pytest

from siteflow.llm import catalog, decontamination, jaccard_join, lattice_lm, line_dedup, pii, quality_rules, sentencepiece_codec, sharding
from siteflow.llm.common import table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def docs(spark):
    return sorted((r["doc_id"], r["text"]) for r in table(spark, SF, "documents").select("doc_id", "text").collect())


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(t):
    w = WORD.findall(lowered(t))
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))


def brute_components(docs):
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j]:
                same = len(sets[i] & sets[j])
                if 100 * same >= 80 * (len(sets[i]) + len(sets[j]) - same):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def brute_removed(docs, least=50):
    """Places of the lines in runs of at least `least` words that stand in an earlier place too, by lining up every pair of texts that share a line."""
    lines = [[(x.strip(BLANK), len(WORD.findall(x)), k) for k, x in enumerate((t or "").split("\n")) if x.strip(BLANK)] for _, t in docs]
    places, gone = collections.defaultdict(list), {}
    for n, (i, _) in enumerate(docs):
        mine, hit = lines[n], set()
        shifts = set()
        for k, x in enumerate(mine):
            shifts |= {(m, k - at) for m, at in places[x[0]]}
            places[x[0]].append((n, k))
        for m, shift in shifts:
            theirs, k = lines[m], max(0, shift)
            while k < len(mine) and k - shift < len(theirs):
                e = k
                while e < len(mine) and e - shift < len(theirs) and mine[e][0] == theirs[e - shift][0]:
                    e += 1
                if sum(x[1] for x in mine[k:e]) >= least:
                    hit |= {x[2] for x in mine[k:e]}
                k = e + 1
        gone[i] = sorted(hit)
    return gone


def test_op1_round_trip_and_parity(spark, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=catalog.model_bytes())
    rows = {r["doc_id"]: r for r in catalog.op1_sentencepiece(spark, SF).collect()}
    for i, t in docs:
        assert rows[i]["ids"] == sp.encode(t) and rows[i]["round_trip"] and rows[i]["parity"]
    back = sentencepiece_codec.decode(catalog.op1_sentencepiece(spark, SF), catalog.model_bytes()).collect()
    assert {r["doc_id"]: r["text"] for r in back} == dict(docs)


@pytest.mark.parametrize("text", ["a  b", " a", "a ", "", "\n", "▁x", "a\x00b", "😀 ​", "   ", "x▁y  z▁▁", "<s> </s> <0x41>"])
def test_op1_odd_texts(text):
    codec = sentencepiece_codec.Codec(catalog.model_bytes())
    ids, _, same = codec.encode([text])
    assert ids.tolist() == codec.reference.encode(text) and same.all()
    assert codec.decode(ids.tolist()) == text.replace("▁", " ")


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def proto_field(number, kind, payload):
    return varint(number << 3 | kind) + (varint(len(payload)) + payload if kind == 2 else payload)


def unigram_model(pieces, charsmap=b"", squeeze=True, dummy=True, fallback=True):
    """A model file of (piece, score, type), written by hand."""
    import struct

    out = b"".join(proto_field(1, 2, proto_field(1, 2, t.encode()) + proto_field(2, 5, struct.pack("<f", s)) + proto_field(3, 0, varint(k))) for t, s, k in pieces)
    out += proto_field(2, 2, proto_field(3, 0, varint(1)) + proto_field(35, 0, varint(int(fallback))))
    flags = b"".join(proto_field(n, 0, varint(int(v))) for n, v in ((3, dummy), (4, squeeze), (5, True)))
    return out + proto_field(3, 2, (proto_field(2, 2, charsmap) if charsmap else b"") + flags)


def test_op1_unigram_model_from_scores():
    data = unigram_model([("<unk>", 0, 2), ("▁a", -1, 1), ("b", -2, 1), ("▁ab", -1.5, 1), ("▁", -4, 1), ("a", -3, 1)], fallback=False)
    m = sentencepiece_codec.parse_model(data)
    assert m.kind == sentencepiece_codec.UNIGRAM and m.pieces[3] == "▁ab" and m.scores[4] == -4.0
    assert sentencepiece_codec.build_tokenizer(m).encode("▁ab").ids == [3]


@pytest.mark.parametrize("how", ["plain", "keep_spaces", "no_prefix", "no_bytes", "charsmap"])
def test_op1_unigram_equals_the_library(docs, how):
    """The public vocabulary as a unigram model: scores, byte fallback, control pieces in a text, white space rules, a character map."""
    import sentencepiece

    public = sentencepiece_codec.parse_model(catalog.model_bytes())
    pieces = [(p, -math.log(i + 2) if t == 1 else s, t) for i, (p, s, t) in enumerate(zip(public.pieces, public.scores, public.types, strict=True))]
    options = {"keep_spaces": {"squeeze": False}, "no_prefix": {"dummy": False}, "no_bytes": {"fallback": False}}.get(how, {})
    if how == "no_bytes":
        pieces = [x for x in pieces if x[2] != 6]
    if how == "charsmap":
        options = {"charsmap": sentencepiece_codec.parse_model(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()).charsmap}
    codec = sentencepiece_codec.Codec(unigram_model(pieces, **options))
    odd = ["a  b", " a", "a ", "", "\n", "▁x", "a\x00b", "😀 \u200b", "   ", "x▁y  z▁▁", "<s> </s> <0x41>", "ﬁne ① Ａ\u3000b", "naïve é café", "漢字 仮名", "ﷺ x", "a\u0301", "tab\there", "½ ™ Å", "x ▁ ▁"]
    lines = [x for _, t in docs[:60] for x in t.split("\n")[:8] if len(x) < 400 and not re.search(r"[%&#*!$|<>]{2}", x)]  # runs of one symbol tie
    for t in odd + lines:
        ids, _, same = codec.encode([t])
        assert ids.tolist() == codec.reference.encode(t) and same.all(), t
        if how != "no_bytes":
            assert codec.decode(ids.tolist()) == codec.reference.decode(ids.tolist()), t


def test_op2_law_and_slots(spark, docs):
    rows = catalog.op2_sharding(spark, SF).collect()
    size = {i: len(t.encode()) + 8 for i, t in docs}
    assert {r["doc_id"]: r["size"] for r in rows} == size and {r["law"] for r in rows} == {"bytes"}
    shards = collections.defaultdict(list)
    for r in rows:
        shards[r["shard"]].append(r)
    assert set(shards) == set(range(24)) and all(sorted(x["slot"] for x in s) == list(range(len(s))) for s in shards.values())
    total, most = sum(size.values()), max(size.values())
    assert all(abs(sum(x["size"] for x in s) - total / 24) <= most for s in shards.values())


def test_op2_splits_a_group_that_overfills_its_range(spark):
    rows = [(k, "same text") for k in range(600)] + [(600 + k, f"text {k}") for k in range(600)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 6).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in got]
    assert len(sizes) == 6 and max(sizes) - min(sizes) <= 40


def test_op2_splits_equal_rows_and_grows_its_ranges(spark):
    """A third of the rows are one row without id; small ranges stand for a large table."""
    rows = [(None, "one and the same text")] * 3000 + [(k, f"text {k} " + "x" * (k % 90)) for k in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for n_shards, per_shard, small in ((6, 32, 2**28), (7, 2, 500)):
        got = sharding.shard(df, n_shards, ranges_per_shard=per_shard, range_bytes=small).collect()
        assert len(got) == 9000 and sum(r["doc_id"] is None for r in got) == 3000
        shards = collections.defaultdict(list)
        for r in got:
            shards[r["shard"]].append(r)
        sizes = [sum(r["size"] for r in s) for s in shards.values()]
        most = max(sum(sizes) / n_shards / 100, 150)
        assert len(sizes) == n_shards and all(abs(x - sum(sizes) / n_shards) <= most for x in sizes), sizes
        assert all(sorted(r["slot"] for r in s) == list(range(len(s))) for s in shards.values())


def test_op2_ranges_of_keys_in_order():
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(2)
    cuts = pd.DataFrame(rng.integers(0, 4, (30, 3)), columns=sharding.KEY).drop_duplicates().sort_values(sharding.KEY, ignore_index=True)
    keys = rng.integers(0, 4, (500, 3))
    found = sharding._range_of(cuts).func(iter([tuple(pd.Series(keys[:, c]) for c in range(3))]))
    want = [sum(tuple(c) <= tuple(k) for c in cuts.to_numpy()) for k in keys]
    assert next(found).tolist() == want


def test_op3_ledger_equals_sql(spark):
    from oracle import same

    same(catalog.op3_quality_rules(spark, SF), catalog.ORACLES["op3_quality_rules"], SF)
    same(catalog.op7_url_filters(spark, SF), catalog.ORACLES["op7_url_filters"], SF)


def test_op3_ablations_sum_up(spark):
    noted = catalog.op3_quality_rules(spark, SF).cache()
    rows = {r["rule"]: r for r in quality_rules.ablations(noted).collect()}
    assert rows["symbols"]["n_failed"] == noted.where("failure_bits & 4 <> 0").count()
    assert rows["symbols"]["n_only"] == noted.where("failure_bits & 31 = 4").count()
    assert rows["few_words"]["n_rejected"] == noted.where("failure_bits & 31 <> 0").count()


def test_op4_equals_brute_force(spark, docs):
    want = brute_removed(docs)
    got = {r["doc_id"]: [int(x) for x in r["removed_places"].split(",") if x] for r in catalog.op4_line_dedup(spark, SF).collect()}
    assert got == want and any(want.values())
    from oracle import same

    same(catalog.op4_line_dedup(spark, SF), catalog.ORACLES["op4_line_dedup"], SF)


def test_op4_equals_brute_force_on_a_larger_table(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    want = brute_removed(sorted((r["doc_id"], r["text"]) for r in table(spark, sf, "documents").select("doc_id", "text").collect()))
    got = {r["doc_id"]: [int(x) for x in r["removed_places"].split(",") if x] for r in catalog.op4_line_dedup(spark, sf).collect()}
    assert got == want and sum(map(bool, want.values())) > 50


@pytest.mark.parametrize("least", [1, 4, 9])
def test_op4_few_lines_in_many_orders(spark, least):
    """Fingerprints that stand in many contexts, runs that repeat within a text, long ones, blank lines, one line in a third of all texts."""
    import random

    rng = random.Random(least)
    pool = [" ".join(f"l{k}" for _ in range(rng.randint(1, 5))) for k in range(12)] + ["", "  "]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 14)))) for i in range(150)]
    docs += [(200 + k, "\n".join(["hot line of several words here"] * (1 + k % 3) + [f"own {k} x y"])) for k in range(80)]
    docs += [(300, "\n".join(rng.choice(pool) for _ in range(600)))]
    got = {r["doc_id"]: (list(r["removed_places"]), r["text"]) for r in line_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string"), min_words=least).collect()}
    want = brute_removed(docs, least)
    assert {i: x[0] for i, x in got.items()} == want
    assert all(got[i][1] == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in set(want[i])) for i, t in docs)


def test_op4_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a b\nc d"), (2, "a b\nc d")], "doc_id long, text string").selectExpr("*", "7 AS d", "7 AS v", "7 AS `__d`", "7 AS n_lines", "7 AS n_removed", "7 AS removed_places", "7 AS cut", "7 AS runs", "7 AS `a.b`")
    out = line_dedup.dedup(df, min_words=4)
    assert out.columns == ["doc_id", "text", "d", "v", "__d", "cut", "runs", "a.b", "n_lines", "n_removed", "removed_places"]
    assert sorted(map(tuple, out.collect())) == [(1, "a b\nc d", 7, 7, 7, 7, 7, 7, 2, 0, []), (2, "", 7, 7, 7, 7, 7, 7, 2, 2, [0, 1])]


def test_op4_extends_both_ways(spark):
    passage = "\n".join(["short start", " ".join(f"w{k}" for k in range(60)), "short end"])
    rows = [(1, f"own one\n{passage}\nown two"), (2, f"other\n{passage}\n\nother end"), (3, "short start\nalone")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "other\n\nother end", 3: rows[2][1]}


def test_op5_equals_brute_force(spark, docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in catalog.op5_jaccard_join(spark, SF).collect()}
    assert got == brute_components(docs)


def test_op5_families_chains_and_small_sets(spark):
    import random

    rng, rows = random.Random(5), []
    for family in range(25):
        n = rng.choice([3, 5, 6, 8, 12, 20, 40, 70, 120])
        base = [f"f{family}w{rng.randrange(50)}" for _ in range(n)]
        for _ in range(8):
            text = list(base)
            for _ in range(rng.randrange(0, 1 + n // 20 + 1)):
                text[rng.randrange(n)] = f"z{rng.randrange(9999)}"
            rows.append((len(rows), " ".join(text)))
            base = text  # a chain: far ends differ more
    shared = " ".join(f"s{k}" for k in range(60))
    rows += [(1000 + k, shared + " " + " ".join(f"u{k}_{j}" for j in range(30 + k % 7))) for k in range(120)]  # one common passage
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


@pytest.mark.parametrize("crowd", [0, 3, 20])
def test_op5_templates_and_families(spark, monkeypatch, crowd):
    """Texts on one template, with families of near copies among them: crowded keys are left to the rarest shingles, no link is lost."""
    import random

    rng, rows = random.Random(17), []
    monkeypatch.setattr(jaccard_join, "CROWD", crowd)
    monkeypatch.setattr(jaccard_join, "HOT", 2)
    made = []
    find = jaccard_join.met_by_rare_shingles
    monkeypatch.setattr(jaccard_join, "met_by_rare_shingles", lambda *a: made.append(find(*a)) or made[-1])
    for share, n in ((0.7, 120), (0.85, 60), (0.5, 40)):
        template = [f"t{share}w{k}" for k in range(int(n * share))]
        for family in range(30):
            base = template + [f"f{share}_{family}_{k}" for k in range(n - len(template))]
            for _ in range(rng.choice([1, 1, 3])):
                text = list(base)
                for _ in range(rng.randrange(0, 2 + n // 50)):
                    text[rng.randrange(n)] = f"z{rng.randrange(99999)}"
                rows.append((len(rows), " ".join(text)))
                base = text
    rows += rows[:5]  # repeated rows
    rows += [(3, "another text of the same id with seven more words"), (None, rows[0][1]), (9999, None)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect() if r["doc_id"] not in (3, None)}
    want = brute_components(list({i: t for i, t in rows[::-1] if i is not None}.items()))
    del want[3]
    assert made and got == want


def test_op5_bands_and_agreement_hold():
    import numpy as np

    for n in range(1, 1500):
        k = int(jaccard_join.band_of(np.array([n]))[0])
        for m in range(-(-4 * n // 5), n + 1):
            low = jaccard_join.band_of(np.array([m]))
            assert low[0] in (k, k - 1)
            most = (n + m) // 9
            assert all(most <= jaccard_join.needs(np.array([x]), low)[0] for x in (n, m))
        assert jaccard_join.agreement(np.array([n]))[0] >= 1


def test_op5_similar_sets_share_the_keys_they_surely_share():
    """Random pairs at the edge of similarity, small ones most: never fewer common keys than both sets claim, also for thin sets."""
    import numpy as np

    rng, thin = np.random.default_rng(8), 0
    pairs = []
    for turn in range(6000):
        n = int(rng.integers(4, 14)) if turn % 3 else int(rng.integers(4, 200))
        x = rng.integers(0, 2**63, n).astype(np.uint64)
        extra = int(rng.integers(0, n // 4 + 1))
        drop = int(rng.integers(0, max(1, n // 5 + 1)))
        y = np.concatenate([x[drop:], rng.integers(0, 2**63, extra).astype(np.uint64)])
        if 100 * (n - drop) >= 80 * (n + extra):
            pairs.append((x, y))
    sets = [s for pair in pairs for s in pair]
    n = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), n)
    rows, keys, surely = jaccard_join.keys_of(np.concatenate(sets), row, n)
    of = collections.defaultdict(set)
    for r, k in zip(rows.tolist(), keys.tolist(), strict=True):
        of[r].add(k)
    for k in range(len(pairs)):
        a, b = 2 * k, 2 * k + 1
        if min(n[a], n[b]) <= jaccard_join.EQUAL:
            continue
        parity = int(jaccard_join.band_of(np.array([min(n[a], n[b])]))[0]) & 1
        common = sum(x & 1 == parity for x in of[a] & of[b])
        assert common >= max(surely[a, parity], surely[b, parity]) >= 1
        thin += surely[a, parity] == 1
    assert len(pairs) > 2000 and thin


def test_op5_short_texts_in_great_number(spark):
    """Distinct short texts share no key, small sets next to the smallest ones are compared exactly."""
    import random

    from pyspark.sql import functions as F

    word = lambda j: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(j)), F.lit(10**9)).cast("string"))
    many = spark.range(50_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[word(j) for j in range(3)]).alias("text"))
    assert jaccard_join.link(many).where("component_id = doc_id and n_shingles = 1").count() == 50_000
    of = jaccard_join.keys_of(*_small_sets(20_000, 8))
    assert collections.Counter(of[1].tolist()).most_common(1)[0][1] < 30
    rng, rows = random.Random(9), []
    for family in range(60):
        base = [f"f{family}w{k}" for k in range(rng.randint(1, 16))]
        for _ in range(6):
            text = list(base)
            for _ in range(rng.randint(0, 2)):
                rng.choice([lambda t: t.append(f"x{rng.randrange(3)}"), lambda t: t.pop(), lambda t: t.insert(0, "y")])(text) if text else None
            rows.append((len(rows), " ".join(text)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_op5_one_id_with_several_texts(spark):
    """Rows of one doc_id are one node: its links are those of all its texts."""
    base = {k: [f"b{k}w{j}" for j in range(30)] for k in range(12)}
    edit = lambda k, n: " ".join([*base[k][:-1], f"z{n}"])
    rows = [(k, " ".join(base[k])) for k in range(12)] + [(100 + k, edit(k, k)) for k in range(12)] + [(100, edit(5, 77)), (103, edit(7, 78)), (103, edit(9, 79)), (200, "alone"), (200, "a b c d e f g")]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    want = {k: k for k in range(12)} | {100 + k: k for k in range(12)} | {200: 200} | {5: 0, 105: 0, 7: 3, 107: 3, 9: 3, 109: 3}
    assert got == want


def _small_sets(count, n):
    import numpy as np

    sizes = np.full(count, n)
    return np.random.default_rng(3).integers(0, 2**63, count * n).astype(np.uint64), np.repeat(np.arange(count), sizes), sizes


def test_op6_base_and_lattice(spark, docs):
    rows = {r["doc_id"]: r for r in catalog.op6_lattice_lm(spark, SF).collect()}
    c, ends = collections.Counter(), 0
    for i, t in docs:
        if not lattice_lm.held_out(i):
            c.update(WORD.findall(lowered(t)))
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=catalog.model_bytes())
    pieces = collections.Counter()
    for w, k in c.items():
        for p in sp.encode(w):
            pieces[p] += k
    first = lattice_lm.Lattice(catalog.model_bytes(), {k: float(x) for k, x in pieces.items()}, float(ends))
    total = [0.0] * sp.get_piece_size()
    for w, k in c.items():
        first.expected(w, k, total)
    lattice = lattice_lm.Lattice(catalog.model_bytes(), {k: x for k, x in enumerate(total) if x > 0}, float(ends))
    for i, t in docs[:60]:
        w, r = WORD.findall(lowered(t)), rows[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(w) + 1, sum(c[x] > 0 for x in w) + 1, n, lattice_lm.held_out(i))
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1)))
        assert r["score"] == pytest.approx(sum(map(lattice.marginal, w)) + lattice.end / math.log(10))


def test_op6_expected_counts_weigh_all_segmentations():
    lattice = lattice_lm.Lattice(catalog.model_bytes())
    name = {i: p for p, i in lattice.ids.items()}

    def every(s):
        if not s:
            yield 1.0, []
        for k in range(1, len(s) + 1):
            if lattice.table.get(s[:k]) is not None:
                for p, rest in every(s[k:]):
                    yield p * math.exp(lattice.table[s[:k]]), [s[:k], *rest]

    for w in ("the", "token", "banana"):
        found = list(every("▁" + w))
        want, total = collections.Counter(), sum(p for p, _ in found)
        for p, used in found:
            for x in used:
                want[x] += 3 * p / total
        got = [0.0] * 32_000
        lattice.expected(w, 3, got)
        assert {name[k]: x for k, x in enumerate(got) if x > 1e-9} == pytest.approx({x: v for x, v in want.items() if v > 1e-9}, rel=1e-6)
    odd = [0.0] * 32_000
    for w in ("漢퟿😀", "a" * 5000, "", "\U000abcde" * 300):
        lattice.expected(w, 2, odd)
    assert all(map(math.isfinite, odd)) and odd[lattice.byte_ids[0xED]] == pytest.approx(2) and odd[lattice.byte_ids[0xF2]] == pytest.approx(600)


def test_op6_marginal_sums_all_segmentations():
    lattice = lattice_lm.Lattice(catalog.model_bytes())

    def every(s):
        total = 1.0 if not s else 0.0
        for k in range(1, len(s) + 1):
            weight = lattice.table.get(s[:k])
            if weight is not None:
                total += math.exp(weight) * every(s[k:])
        return total

    for w in ("the", "token", "ingthe"):
        assert lattice.marginal(w) == pytest.approx(math.log10(every("▁" + w)))
    assert math.isfinite(lattice.marginal("漢퟿😀")) and math.isfinite(lattice.marginal("a" * 5000))


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_secrets(t):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(found)


def check_secrets(rows, texts):
    n = 0
    for r in rows:
        found = brute_secrets(texts[r["doc_id"]] or "")
        joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in found)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == kind for _, k, _ in found) for kind in range(3)]
        n += bool(found)
    return n


def test_op8_base_spans(spark):
    """On a table that holds secrets."""
    sf = SF.replace("sf0.001", "sf0.01")
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    rows = catalog.op8_secret_scan(spark, sf).collect()
    assert len(rows) == len(texts) and check_secrets(rows, texts) > 5


def test_op8_any_number_of_spans(spark):
    import random

    from siteflow.llm import secret_scan

    rng = random.Random(4)
    make = [lambda: f"{rng.choice(['Token', 'API_KEY', 'passwd'])}{rng.choice([': ', '=', ' = '])}{rng.choice(['abcdef', 'x', 'hunter22/é'])}", lambda: "AKIA" + "".join(rng.choice("ABC123") for _ in range(rng.choice([15, 16, 20]))), lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([23, 24, 40])))]
    texts = {}
    for n in range(1, 21):
        for kinds in ([0], [1], [2], [0, 1, 2]):
            parts = [make[rng.choice(kinds)]() for _ in range(n * len(kinds))]
            texts[len(texts)] = rng.choice(["", "é ", "漢 "]) + " zy ".join(parts) + rng.choice(["", " end"])  # spans at both ends, too
    texts[len(texts)] = " ".join(make[k % 3]() for k in range(1500))
    texts[len(texts)] = None
    rows = secret_scan.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert check_secrets(rows, texts) > 70


def test_op8_randomness(spark):
    import random

    from siteflow.llm import secret_scan

    rng = random.Random(1)
    rand = ["".join(rng.choice(secret_scan.ALPHABETS["base64"][:62]) for _ in range(64)) for _ in range(12)]
    rows = [(k, f"key {x} end") for k, x in enumerate(rand)]
    rows += [(20 + k, f"abc{k}ABC" * 10) for k in range(9)] + [(40, "plain words only"), (41, 'secret=token: abcdefg "password" : hunter22')]
    got = {r["doc_id"]: r for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[k]["spans"] == "random:4:68" for k in range(12)) >= 10
    assert all(got[20 + k]["n_random"] == 0 for k in range(9)) and got[40]["spans"] == ""
    assert got[41]["n_assign"] == 1 and got[41]["spans"].startswith("assign:23:43")


WORDS = "the of and user account session manager index value report status billing order item section paragraph message stream config client table column record number update".split()


def identifier(rng, n):
    """Words in one of four styles, with numbers between them."""
    style, s = rng.choice(["camel", "lower", "upper", "path"]), ""
    while len(s) < n:
        w = rng.choice(WORDS)
        s += {"lower": w, "upper": w.upper()}.get(style, w.capitalize()) + (rng.choice("/_-") if style == "path" else "")
        s += str(rng.randrange(10 ** rng.randint(1, 4))) if rng.random() < 0.35 else ""
    return s[: n - 1] + "q"


def test_op8_false_discoveries_are_bounded_by_length(spark):
    """Random tokens among three times as many identifiers: the share of identifiers in the report stays near q in each length class."""
    import random

    from siteflow.llm import secret_scan

    rng, rows, kind = random.Random(6), [], {}
    for n in (20, 32, 64, 128):
        for alphabet in (secret_scan.ALPHABETS["base64"][:62], "0123456789abcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHJKMNPQRSTVWXYZ", "0123456789ABCDEF"):
            for _ in range(60):
                kind[len(rows)] = (n, True)
                rows.append((len(rows), "key " + "".join(rng.choice(alphabet) for _ in range(n)) + " end"))
        for _ in range(720):
            kind[len(rows)] = (n, False)
            rows.append((len(rows), "name " + identifier(rng, n) + " end"))
    got = secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).where("n_random > 0").select("doc_id").collect()
    found = collections.Counter(kind[r["doc_id"]] for r in got)
    for n in (20, 32, 64, 128):
        assert found[n, False] <= 0.07 * (found[n, False] + found[n, True])
    assert [found[n, True] / 240 >= least for n, least in ((20, 0.1), (32, 0.4), (64, 0.75), (128, 0.95))] == [True] * 4


def base_spans(t, kinds):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in kinds)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CASES = ["a@b.c@d.e f@g", "x@y@z.w", "1.2.3.4.5.6.7.8 999.1.1.1 1.2.3 12.3.4.5.", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (234) 555-6789 +12 +1--2345678)", ".@a.b..c@@d.e%+@f.g-", "0001.2.3.4", ""]


def brute_pii(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(t)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(t) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", m.start(), m.end()) for m in PHONE.finditer(t) if 8 <= len(digits(m[0])) <= 15]


def test_op9_base_spans(spark, docs):
    rows = {r["doc_id"]: r for r in catalog.op9_pii(spark, SF).collect()}
    for i, t in docs:
        assert rows[i]["base_sha256"] == hashlib.sha256(base_spans(t, brute_pii(t)).encode()).hexdigest()
    for t in CASES:
        assert [s for s in pii.proposed(t) if s[0] in pii.BASE_KINDS] == brute_pii(t)


def test_op9_checksums_and_context():
    assert pii.scan("bank account IBAN GB82 WEST 1234 5698 7654 32 here")[0] == [("iban", 18, 45)]
    assert pii.scan("code GB83 WEST 1234 5698 7654 32 here")[0] == []
    assert pii.scan("social security 123-45-6789")[0] and not pii.scan("part 123-45-6789")[0]
    near, far = pii.scan("call phone +1 (234) 555-6789")[1][0], pii.scan("article +1 (234) 555-6789")[1][0]
    assert near > far


@pytest.mark.parametrize(("before", "code", "after"), [("IBAN ", "DE89 3704 0044 0532 0130 00", " BIC COBADEFF"), ("", "DE89370400440532013000", " 250 euros"), ("AB12 ", "GB82 WEST 1234 5698 7654 32", " REF 77")])
def test_op9_iban_before_other_codes(before, code, after):
    assert ("iban", len(before), len(before) + len(code)) in pii.scan(before + code + after)[0]


def test_op9_two_ibans_and_no_part_of_a_token():
    t = "DE89370400440532013000 GB82WEST12345698765432"
    assert pii.scan(t)[0] == [("iban", 0, 22), ("iban", 23, 45)]
    for x in ("abc", "A" * 30):
        assert not any(s[0] == "iban" for s in pii.scan("DE89370400440532013000" + x)[0])


FOLD = re.compile(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def cut_words(t):
    return FOLD.sub(" ", lowered(t)).split()


def overlaps(part, passage):
    n = min(5, len(part))
    grams = {tuple(passage[k : k + n]) for k in range(len(passage) - n + 1)}
    wanted = [tuple(part[k : k + n]) for k in range(len(part) - n + 1)]
    return sum(g in grams for g in wanted) / max(1, len(wanted))


def brute_hits(docs, items, threshold=0.5, least=0.5):
    """BM25 of every item against every passage of every text, written down from the formula; (doc, item) -> best score."""
    cut = [(i, t, cut_words(t)) for i, t in items]
    cut = [x for x in cut if x[2]]
    df = collections.Counter(w for *_, c in cut for w in set(c))
    mean = sum(len(c) for *_, c in cut) / len(cut)
    out = {}
    for i, t, c in cut:
        idf = {w: math.log(1 + (len(cut) - df[w] + 0.5) / (df[w] + 0.5)) for w in c}
        gain = {w: idf[w] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(c) / mean)) for w, n in collections.Counter(c).items()}
        sentences = [s for s in map(cut_words, re.split(r"(?<=[.!?])\s+|\n+", t)) if s]
        question, answer = (sum(sentences[:-1], []), sentences[-1]) if len(sentences) > 1 else (c, c)
        stride = 64
        while stride < len(c):
            stride *= 2
        for d, text in docs:
            words = cut_words(text)
            if not set(gain) & set(words):
                continue
            for start in range(0, len(words), stride):
                score = sum(gain[w] for w in set(words[start : start + 2 * stride]) & set(gain)) / sum(gain.values())
                if score >= threshold - 1e-9 and score > out.get((d, i), 0):
                    around = words[max(0, start - stride) : start + 3 * stride]
                    if min(overlaps(question, around), overlaps(answer, around)) >= least:
                        out[d, i] = score
    return out


def planted_leaks(docs, items):
    """Whole, cut and edited copies of items inside other texts, and items of many lengths."""
    import random

    rng, rows, extra = random.Random(7), [], []
    filler = " ".join(t for _, t in docs[:30]).split()
    for k in range(40):
        words = items[k % len(items)][1].split()
        how = k % 4
        if how == 1:
            words = words[: max(8, 2 * len(words) // 3)]
        elif how == 2:
            words = [w if rng.random() > 0.12 else "changed" for w in words]
        elif how == 3:
            words = words[len(words) // 3 :]
        at = rng.randrange(len(filler) - 400)
        rows.append((10_000 + k, " ".join(filler[at : at + rng.randint(0, 200)] + words + filler[at + 200 : at + 200 + rng.randint(0, 200)])))
    for k, n in enumerate((3, 65, 130, 300)):
        words = [f"long{k}word{rng.randrange(400)}" for _ in range(n)]
        extra.append((900 + k, " ".join(words)))
        rows.append((20_000 + k, " ".join(filler[:90] + words + filler[90:180])))
    return rows, extra


@pytest.mark.parametrize("blocks", [1, 2, 5])
def test_op10_equals_plain_bm25(spark, docs, blocks):
    """Every hit and score, whatever the number of blocks; also for cut and edited copies and long items."""
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    leaks, extra = planted_leaks(docs, items)
    items += [*extra, (None, "an item without a name that stands in one text. and is found there.")]
    texts = [*docs[:120], *leaks, (30_000, f"x y {items[-1][1]} z"), (30_001, None)]
    want = brute_hits(texts, items)
    got = decontamination.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), max_items=-(-len(items) // blocks)).collect()
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in got} == pytest.approx(want) and len(got) == len(want)
    assert (30_000, None) in want and all((20_000 + k, 900 + k) in want for k in range(4))
    # Whole copies; without the answer; with an eighth of the words changed; without a third of the question.
    found = collections.Counter(k % 4 for k in range(40) if (10_000 + k, items[k % len(items)][0]) in want)
    assert found[0] == 10 and found[1] <= 3 and found[3] >= 4, found


@pytest.mark.parametrize("scale", ["0.001", "0.01"])
def test_op10_equals_sql(spark, scale):
    from oracle import same

    same(catalog.op10_decontamination(spark, f"/root/testdata/sf{scale}"), catalog.ORACLES["op10_decontamination"], f"/root/testdata/sf{scale}")


def test_op10_readings_and_ids(spark, docs):
    """Many blocks in one reading, or a reading for each, give the same hits; ids may be strings; equal items stay apart."""
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    leaks, extra = planted_leaks(docs, items)
    items += [*extra, *[items[0]] * 3]
    texts = spark.createDataFrame([(f"name {i}", t) for i, t in leaks], "doc_id string, text string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    hits = lambda **how: sorted(tuple(r) for r in decontamination.contaminated(texts, tests, **how).collect())
    whole = hits()
    assert hits(max_items=9) == whole == hits(max_items=9, pass_bytes=1) == hits(max_words=600, pass_bytes=30_000)
    assert {d for d, *_ in whole} >= {f"name {20_000 + k}" for k in range(4)}
    assert sum(d == "name 10000" and i == items[0][0] for d, i, *_ in whole) == 4


def test_op10_blocks_are_built_by_tasks(spark):
    """The driver's share is one packed block at a time: a row a block, each with the document frequencies of all items."""
    rows = [(k, f"common words here and name{k % 50} of item{k}. answer{k} is given") for k in range(400)]
    made = decontamination.index_blocks(spark.createDataFrame(rows, "item_id long, text string"), 0.5, 100, 10**6).collect()
    assert sorted(r["block"] for r in made) == [0, 1, 2, 3]
    found = [index for r in made for _, index in decontamination.pickle.loads(decontamination.zlib.decompress(r["index"]))]
    assert sorted(i for x in found for i in x.ids) == list(range(400))
    one = decontamination.ItemIndex(rows, 0.5)
    for x in found:
        for w in (b"common", b"name7"):
            ours = dict(zip((x.ids[k] for k in x.items[x.term[w]]), x.impacts[x.term[w]], strict=True))
            alone = dict(zip((one.ids[k] for k in one.items[one.term[w]]), one.impacts[one.term[w]], strict=True))
            assert ours == pytest.approx({i: alone[i] for i in ours}) and ours


def test_op10_search_returns_all_above_the_threshold(spark, docs):
    """WAND and the early drop lose nothing that a full sum of impacts finds."""
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    index = decontamination.ItemIndex(items, 0.3)
    for i, t in docs[:40]:
        for start in range(0, max(1, len(decontamination.tokens(t))), 64):
            terms = sorted({index.term[w] for w in decontamination.tokens(t)[start : start + 128] if w in index.term})
            score = collections.Counter()
            for x in terms:
                for k, v in zip(index.items[x].tolist(), index.impacts[x].tolist(), strict=True):
                    score[k] += v
            want = {k: v for k, v in score.items() if v >= 0.3 - 1e-9}
            assert dict(index.search(terms)) == pytest.approx(want)


def test_op10_finds_every_passage(spark, docs):
    items = [(r["item_id"], decontamination.tokens(r["text"])) for r in table(spark, SF, "benchmark").collect()]
    want = set()
    for i, t in docs:
        joined = b" " + b" ".join(decontamination.tokens(t)) + b" "
        want |= {(i, k) for k, toks in items if b" " + b" ".join(toks) + b" " in joined}
    got = {(r["doc_id"], r["item_id"]) for r in catalog.op10_decontamination(spark, SF).collect()}
    assert want and want <= got
    for i, k in got - want:
        assert decontamination.overlap(dict(items)[k], decontamination.tokens(dict(docs)[i])) > 0.4


def test_pipeline_equals_brute_force(spark, docs):
    """The stages, plainly, one after the other."""
    import sentencepiece

    import corpus_pipeline

    kept = {r["doc_id"] for r in catalog.op3_quality_rules(spark, SF).collect() if r["kept"]}
    left = [(i, t) for i, t in docs if i in kept]
    gone = brute_removed(left)
    cut = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in set(gone[i]))) for i, t in left]
    cut = [(i, t) for i, t in cut if not gone[i] or WORD.search(t)]
    parts = brute_components(cut)
    cut = [(i, t) for i, t in cut if not shingles(t) or parts[i][1] == i]
    hit = {d for d, _ in brute_hits(cut, [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()])}
    sp = sentencepiece.SentencePieceProcessor(model_proto=catalog.model_bytes())
    want = {i: sp.encode(t) for i, t in cut if i not in hit}
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want

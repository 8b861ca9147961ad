"""Similarity join of documents by the Jaccard index of their word shingles, exact, by partitioning the universe.

Sets are put in size bands. In a band, hashing deals the universe of shingles into m segments. Two sets that differ in at
most H shingles agree on at least m - H segments (or, with one-deletion neighbourhoods, are within one shingle
on at least m - H // 2), so similar sets share many segment keys. Small sets use the neighbourhoods, where their extra
rows are affordable and segments would be too small without; large sets use whole segments.

Empty segments are no keys, and sets of up to three shingles have none at all, since only equal sets are similar to them.

Allocation by cost: a set may leave out as many shared keys as it has to spare (one less than the agreement its own
segments guarantee), and leaves out those that most sets share: boilerplate. Only what is left is joined, under
conditions that similar sets must fulfil (sizes, a parity sketch, the number of shared keys). A pair is then checked exactly on
its shingle sets.

Large groups never become all pairs: sets that are equal form one class; then neighbours in a key's order are checked
and linked; only sets whose keys still join different components are probed against each other.

A key on which many sets of different components still meet (a template that texts share without being similar) is crowded. Its
sets are not paired there: they meet by their rarest shingles instead. Similar sets share at least t of the n shingles of either, so of any n - t + 1
shingles of a set, a similar one has some; the rarest of a common order are taken, which for texts on a template are their own.

Nulls: null and empty texts have empty sets and no links; a null doc_id is not linked and its own component is
null. Rows of one doc_id are one node. Repeated rows give repeated result rows. Empty tables give no rows. Other columns are ignored.
Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from xxhash import xxh64_intdigest

from siteflow.llm.common import discard, written
from siteflow.llm.components import components
from siteflow.llm.sentencepiece_codec import pieces_of

WIDTH = 5
SPARE = 0.25  # segments beyond those that pigeonhole needs, as a share
DELETION_BELOW = 64  # sets of bands below this size use one-deletion neighbourhoods
BITS = 256  # of a sketch
EQUAL = 3  # sets of up to so many shingles are similar only to equal ones
DEALS = 6
HOT = 64  # rows of a key beyond which a set would rather leave it out
CROWD = 256  # sets of a key outside its largest component beyond which they meet by their rarest shingles instead
SEND_IDS = 1_000_000  # most ids that are broadcast (8 MB)

U = np.uint64
#: Lower ends of the bands: each band reaches up by a quarter, so a similar smaller set is in the same band or the one below.
LOWS = np.unique(np.ceil(1.25 ** np.arange(0, 100)).astype(np.int64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor shifts and odd multipliers)."""
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def shingle_sets(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """All sets in one array, each sorted and without repeats, and the size of each."""
    cut = [(t or "").encode().lower().split() for t in texts]
    n = np.array([len(c) for c in cut], np.int64)
    h = np.fromiter((xxh64_intdigest(w) for c in cut for w in c), U, int(n.sum()))
    row = np.repeat(np.arange(len(cut)), n)
    place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
    size = np.repeat(n, n)
    key = np.zeros(len(h), U)
    starts = np.flatnonzero((place == 0) | (place <= size - WIDTH))  # a short text has one start, its first word
    for k in range(WIDTH):
        at = starts[place[starts] + k < size[starts]]
        key[at] = mix(key[at] * U(0x9E3779B97F4A7C15) + h[at + k] + U(k + 1))
    row, key = row[starts], key[starts]
    ends = np.cumsum(np.bincount(row, minlength=len(cut)))
    for low, high in zip((ends - np.diff(ends, prepend=0)).tolist(), ends.tolist(), strict=True):
        key[low:high].sort()
    first = np.append(True, (row[1:] != row[:-1]) | (key[1:] != key[:-1])) if len(row) else np.zeros(0, bool)
    return key[first], np.bincount(row[first], minlength=len(cut)).astype(np.int64)


def band_of(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(LOWS, n, "right") - 1


def needs(n: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Most shingles by which a set of n can differ from a similar set, where the smaller of the two is in the band."""
    return np.where(band == band_of(n), n // 4, (n + LOWS[band + 1] - 1) // 9)


def deletes(band: np.ndarray) -> np.ndarray:
    return LOWS[band + 1] <= DELETION_BELOW


def segments(band: np.ndarray) -> np.ndarray:
    """Segments of a band: what pigeonhole asks of its largest set, and some to spare."""
    most = (LOWS[band + 1] - 1) // 4
    need = np.where(deletes(band), most // 2 + 1, most + 1)
    return need + np.ceil(need * SPARE).astype(np.int64)


def survivors(filled: np.ndarray, single: np.ndarray, most: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Filled segments of a set that surely agree with a set that differs in at most `most` shingles.

    Such a set can spoil a whole segment with one shingle. Under one-deletion neighbourhoods that takes two, or one where the
    segment holds a single shingle.
    """
    lost = np.minimum(most, single)
    return filled - np.where(deletes(band), lost + (most - lost) // 2, most)


def agreement(n: np.ndarray) -> np.ndarray:
    """Segments, empty ones included, on which a set of n agrees with any similar one: the scale of a fair part."""

    def at(band: np.ndarray) -> np.ndarray:
        most = needs(n, band)
        return segments(band) - np.where(deletes(band), most // 2, most)

    own = band_of(n)
    return np.where(own > 0, np.minimum(at(own), at(np.maximum(own - 1, 0))), at(own))


def sketches(tokens: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(sets, 4) words of BITS parities: a set's tokens flip one bit each, so two sets differ in at least as many tokens as bits."""
    row = np.repeat(np.arange(len(n)), n)
    bit = (mix(tokens + U(5)) & U(BITS - 1)).astype(np.int64)
    odd = (np.bincount(row * BITS + bit, minlength=len(n) * BITS) & 1).astype(np.uint8).reshape(len(n), BITS)
    return np.packbits(odd, axis=1).view(np.int64)


def keys_of(tokens: np.ndarray, row: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key) of every filled segment of every set, in its own band and the one below, and of its one-deletion neighbours; and
    (sets, 2): on how many keys of an even and an odd band a set surely agrees with any similar one.

    An empty segment is no key: small sets would all share it. A set whose filled segments could all be spoiled is thin. If two
    similar sets agree on no filled segment, each of them is thin, so thin sets are dealt out once more with another
    salt, and so on; the last deal, which hardly any set reaches, takes empty segments too. Sets of at most EQUAL shingles are
    similar only to equal ones, which are one class, and give no keys. The lowest bit of a key is its band's parity.
    """
    rows, keys = [], []
    surely = np.full((len(n), 2), 1, np.int64)
    for below in (0, 1):
        band = np.maximum(band_of(n) - below, 0)
        active = (n > EQUAL) & (band_of(n) >= below) & (LOWS[band + 1] - 1 > EQUAL)
        most = needs(n, band)
        for deal in range(DEALS):
            m = np.where(active, segments(band), 0)
            offset = np.cumsum(m) - m
            total = int(m.sum())
            taken = active[row]
            r, t = row[taken], tokens[taken]
            salt = mix(band[r].astype(U) + U(77 + 1000 * deal))
            seg = offset[r] + (mix(t ^ salt) % m[r].astype(U)).astype(np.int64)
            grain = mix(t + salt)
            content = np.zeros(total, U)
            np.add.at(content, seg, grain)
            size = np.bincount(seg, minlength=total)
            owner = np.repeat(np.arange(len(n)), m)
            filled, single = (np.bincount(owner[size >= 1], minlength=len(n)), np.bincount(owner[size == 1], minlength=len(n)))
            sure = survivors(filled, single, most, band)
            if deal == 0:
                surely[np.arange(len(n)), band & 1] = np.maximum(np.where(active, sure, 1), 1)
            thin = active & (sure <= 0)
            every = thin if deal == DEALS - 1 else np.zeros(len(n), bool)
            name = mix((np.arange(total) - np.repeat(offset, m)).astype(U) * U(0xD6E8FEB86659FD93) + (band[owner] + 1000 * deal).astype(U))
            parity = (band & 1).astype(U)
            whole = (size >= 1) | every[owner]
            rows.append(owner[whole])
            keys.append((mix(content ^ name) & ~U(1))[whole] | parity[owner[whole]])
            less = deletes(band)[r] & ((size[seg] >= 2) | every[r])
            rows.append(r[less])
            keys.append((mix((content[seg] - grain)[less] ^ name[seg][less]) & ~U(1)) | parity[r[less]])
            active = thin
            if not active.any():
                break
    return np.concatenate(rows), np.concatenate(keys), surely


def _slices(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for part in pieces_of(texts, 1_000_000):
            yield batch.column(0).slice(part.start, part.stop - part.start), texts[part]


SKETCH = ["x0", "x1", "x2", "x3"]
SETS = pa.schema([(c, pa.int64()) for c in ("doc_id", "n", "d1", "d2", *SKETCH)])


def set_table(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), a 128-bit digest and the sketch of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _slices(batches):
            tokens, n = shingle_sets(texts)
            d1, d2 = _digests(tokens, n)
            yield pa.record_batch([ids, pa.array(n), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), *(pa.array(x) for x in sketches(tokens, n).T.copy())], schema=SETS)

    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in SETS.names))


def _digests(tokens: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    row = np.repeat(np.arange(len(n)), n)
    out = []
    for salt in (11, 23):
        d = np.zeros(len(n), U)
        np.add.at(d, row, mix(tokens + U(salt)))
        out.append(d)
    return out[0], out[1]


def key_table(docs: DataFrame) -> DataFrame:
    """key, doc: one row per segment key; of equal sets in one task only the first gives keys."""
    schema = pa.schema([("key", pa.int64()), ("doc", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for ids, texts in _slices(batches):
            tokens, n = shingle_sets(texts)
            new = np.zeros(len(n), bool)
            for k, digest in enumerate(zip(*(d.tolist() for d in _digests(tokens, n)), strict=True)):
                if n[k] and digest not in seen:
                    seen.add(digest)
                    new[k] = True
            row = np.repeat(np.arange(len(n)), n)
            rows, keys, _ = keys_of(tokens, row, np.where(new, n, 0))
            docs_ = ids.to_numpy(zero_copy_only=False)
            for at in range(0, len(rows), 500_000):
                yield pa.record_batch([pa.array(keys[at : at + 500_000].view(np.int64)), pa.array(docs_[rows[at : at + 500_000]].astype(np.int64))], schema=schema)

    return docs.mapInArrow(run, "key long, doc long")


def picked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents with these ids (a written table); ids are broadcast only up to SEND_IDS of them."""
    return docs.join(F.broadcast(ids) if ids.count() <= SEND_IDS else ids, "doc_id", "left_semi")


def sure_table(docs: DataFrame) -> DataFrame:
    """doc_id, even, odd: on how many keys of a parity a document's set surely agrees with any similar one."""
    schema = pa.schema([("doc_id", pa.int64()), ("even", pa.int64()), ("odd", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _slices(batches):
            tokens, n = shingle_sets(texts)
            surely = keys_of(tokens, np.repeat(np.arange(len(n)), n), n)[2]
            yield pa.record_batch([ids, pa.array(surely[:, 0].copy()), pa.array(surely[:, 1].copy())], schema=schema)

    return docs.mapInArrow(run, "doc_id long, even long, odd long")


def shingle_table(docs: DataFrame) -> DataFrame:
    """rep, n, of, token: every shingle of every set; `of` tells the sets of one id apart."""
    schema = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("of", pa.int64()), ("token", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _slices(batches):
            tokens, n = shingle_sets(texts)
            columns = (ids.to_numpy(zero_copy_only=False), n, _digests(tokens, n)[0].view(np.int64))
            row = np.repeat(np.arange(len(n)), n)
            for at in range(0, len(row), 500_000):
                part = row[at : at + 500_000]
                yield pa.record_batch([*(pa.array(c[part]) for c in columns), pa.array(tokens[at : at + 500_000].view(np.int64))], schema=schema)

    return docs.mapInArrow(run, "rep long, n long, of long, token long")


def met_by_rare_shingles(docs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """a, b: pairs of different components that may be similar, among docs. sets: rep, part, n and the sketch of their sets.

    Shingles of one set alone come first in the order and meet nobody, so only the others are kept, with as many places as the
    first ones leave. Rows of a shingle's largest component meet only the shingle's other rows, never each other.
    """
    shingle = written(shingle_table(docs), "shingles")
    common = shingle.groupBy("token").agg(F.count("*").alias("sets")).where("sets > 1")
    own = ["rep", "n", "of"]
    order = Window.partitionBy(*own).orderBy("sets", "token")
    # Equal rows share their ranks.
    ranked = shingle.join(common, "token").select("*", F.dense_rank().over(order).alias("rank"))
    ranked = ranked.select("*", F.max("rank").over(Window.partitionBy(*own)).alias("kept"))
    # Of n shingles at least ceil(threshold * n / 100) are shared with a similar set.
    places = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") / 100) + 1
    keyed = ranked.where(F.col("rank") + F.col("n") - F.col("kept") <= places).select("rep", "n", "token")
    rows = written(keyed.join(sets, ["rep", "n"]).distinct(), "rare")
    by_part = rows.groupBy("token", "part").agg(F.count("*").alias("rows"))
    major = by_part.groupBy("token").agg(F.max_by("part", F.struct("rows", "part")).alias("major"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    marked = rows.join(major, "token")
    side = lambda mark: marked.select("token", *[F.col(c).alias(f"{c}_{mark}") for c in ("rep", "part", "major", "n", *SKETCH)])
    left, right = side("r"), side("s").where("part_s <> major_s")
    once = (F.col("part_r") == F.col("major_r")) | (F.col("rep_r") < F.col("rep_s"))
    close = (F.col("part_r") != F.col("part_s")) & once & alike("r", "s", threshold)
    met = left.join(right, (left["token"] == right["token"]) & close)
    out = written(met.select(F.least("rep_r", "rep_s").alias("a"), F.greatest("rep_r", "rep_s").alias("b")).distinct(), "rare_met")
    discard(shingle, rows)
    return out


def verified(pairs: DataFrame, docs: DataFrame, threshold: int) -> DataFrame:
    """Those pairs (a, b) whose sets have 100 * intersection >= threshold * union. Only the documents in pairs move."""
    ids = written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids")
    chosen = picked(docs, ids)
    schema = pa.schema([("doc_id", pa.int64()), ("tokens", pa.binary())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _slices(batches):
            tokens, n = shingle_sets(texts)
            ends = np.cumsum(n)
            yield pa.record_batch([keys, pa.array([tokens[e - k : e].tobytes() for k, e in zip(n, ends, strict=True)], pa.binary())], schema=schema)

    made = written(chosen.mapInArrow(sets, "doc_id long, tokens binary"), "sets")
    both = pairs.join(made.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y")), "b").join(made.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x")), "a")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(s.as_buffer(), U) for s in (x, y))
                same = len(np.intersect1d(p, q, assume_unique=True)) if threshold * max(len(p), len(q)) <= 100 * min(len(p), len(q)) else 0
                keep.append(100 * same >= threshold * (len(p) + len(q) - same))
            keep = pa.array(keep, pa.bool_())
            yield pa.record_batch([batch.column(0).filter(keep), batch.column(1).filter(keep)], schema=out)

    return both.select("a", "b", "x", "y").mapInArrow(judge, "a long, b long").distinct()


def link(docs: DataFrame, *, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row. threshold: the Jaccard index in hundredths, 80 or more."""
    if threshold < 80:
        raise ValueError("bands and segments are laid out for a similarity of 0.8 or more")
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = chosen.where("doc_id is not null")
    sets = written(set_table(chosen), "sizes")
    whole = sets.where("n > 0 and doc_id is not null")
    classes = written(whole.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep")), "classes")
    class_of = whole.join(classes, ["n", "d1", "d2"]).select("doc_id", "n", "rep", *SKETCH)

    # Keys of at least two sets. A key's rows are sorted and streamed, never gathered in memory.
    of_key = Window.partitionBy("key").orderBy("doc")
    rows = key_table(known).withColumn("prev", F.lag("doc").over(of_key)).withColumn("next", F.lead("doc").over(of_key))
    shared = written(rows.where("prev is not null or next is not null"), "shared")
    named = written(class_of.join(shared.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi").distinct(), "named")

    # First round: neighbours that share a fair part of the keys that similar sets must share.
    near = shared.where("prev is not null and prev <> doc").groupBy(F.col("prev").alias("a"), F.col("doc").alias("b")).count()
    first = written(verified(_between_classes(near, named, threshold), known, threshold), "links")
    parts = written(components(first), "parts")

    # Second round: sets of different components that share a key. Dearest keys are left out while there are some to spare.
    part_of = named.join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left").select(F.col("doc_id").alias("doc"), "rep", F.coalesce("component", "rep").alias("part"))
    here = Window.partitionBy("key")
    keyed = shared.select("key", "doc").join(part_of, "doc").select("key", "rep", "part")
    mixed = keyed.select("*", (F.min("part").over(here) != F.max("part").over(here)).alias("differs"), F.count("*").over(here).alias("rows"))
    known_sets = named.select("rep", "n", *SKETCH).distinct()  # several rows for an id with several texts
    open_ = written(mixed.where("differs").drop("differs").dropDuplicates(["key", "rep"]).join(known_sets, "rep").withColumn("parity", F.col("key").bitwiseAND(F.lit(1))), "open")
    own = ["rep", "parity", "n", *SKETCH]
    by_cost = Window.partitionBy(*own).orderBy(F.col("rows").desc(), "key")
    reps = written(open_.select(F.col("rep").alias("doc_id")).distinct(), "reps")
    sure = written(sure_table(picked(known, reps)).groupBy(F.col("doc_id").alias("rep")).agg(F.min("even").alias("even"), F.min("odd").alias("odd")), "sure")
    ranked = open_.join(sure, "rep").select("*", F.row_number().over(by_cost).alias("rank"), F.when(F.col("parity") == 0, F.col("even")).otherwise(F.col("odd")).alias("sure"))
    skipped = (F.col("rows") > HOT) & (F.col("rank") < F.col("sure"))
    probes = ranked.select("*", F.sum(skipped.cast("int")).over(Window.partitionBy(*own)).alias("left_out"), skipped.alias("skipped")).where("not skipped")
    # Similar sets that meet on a crowded key are both crowded; those that meet on none lose nothing without these keys.
    by_part = open_.where(F.col("rows") > CROWD).groupBy("key", "part").agg(F.count("*").alias("sets"))
    busy = written(by_part.groupBy("key").agg((F.sum("sets") - F.max("sets")).alias("others")).where(F.col("others") > CROWD).select("key"), "busy")
    n_busy = busy.count()
    rare, made = None, [busy]
    if n_busy:
        busy_keys = F.broadcast(busy) if n_busy <= SEND_IDS else busy
        probes = written(probes.join(busy_keys.withColumn("crowded", F.lit(True)), "key", "left"), "probes")
        crowd = written(probes.where("crowded").select(F.col("rep").alias("doc_id")).distinct(), "crowd")
        crowd_sets = probes.where("crowded").select("rep", "part", "n", *SKETCH).distinct()
        rare = met_by_rare_shingles(picked(known, crowd), crowd_sets, threshold)
        made += [probes, crowd, rare]
        probes = probes.where("crowded is null").drop("crowded")
    side = lambda mark: probes.select("key", *[F.col(c).alias(f"{c}_{mark}") for c in ("rep", "part", "n", "sure", "left_out", *SKETCH)])
    # Both leave out the dearest keys of one common order, so the keys they lose are those that one of them left out.
    close = (F.col("rep_r") < F.col("rep_s")) & (F.col("part_r") != F.col("part_s")) & alike("r", "s", threshold)
    least = F.greatest("sure_r", "sure_s") - F.greatest("left_out_r", "left_out_s")
    left, right = side("r"), side("s")
    met = left.join(right, (left["key"] == right["key"]) & close).groupBy(F.col("rep_r").alias("a"), F.col("rep_s").alias("b"), least.alias("least")).count().where("count >= least")
    met = met.select("a", "b") if rare is None else met.select("a", "b").union(rare)
    fresh = met.distinct().join(first, ["a", "b"], "left_anti")
    fresh = written(fresh, "met")
    second = verified(fresh, known, threshold)
    ends = written(components(first.union(second)), "ends")
    discard(shared, named, first, parts, open_, reps, sure, fresh, *made)

    nodes = sets.join(classes, ["n", "d1", "d2"], "left").join(ends.select(F.col("node").alias("rep"), "component"), "rep", "left")
    return nodes.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))


@F.pandas_udf(LongType())
def usual(n: pd.Series) -> pd.Series:
    return pd.Series(agreement(n.to_numpy()))


def alike(r: str, s: str, threshold: int) -> Column:
    """What sizes and sketches of similar sets must fulfil."""
    n, m = F.col(f"n_{r}"), F.col(f"n_{s}")
    bits = sum((F.bit_count(F.col(f"{x}_{r}").bitwiseXOR(F.col(f"{x}_{s}"))) for x in SKETCH), F.lit(0))
    return (100 * F.least(n, m) >= threshold * F.greatest(n, m)) & (bits * 9 <= n + m)


def _between_classes(pairs: DataFrame, named: DataFrame, threshold: int) -> DataFrame:
    """Pairs of class representatives for counted pairs of documents that may be similar, without those inside a class."""
    side = lambda mark: named.select(F.col("doc_id").alias(mark), *[F.col(c).alias(f"{c}_{mark}") for c in ("rep", "n", *SKETCH)], usual("n").alias(f"sure_{mark}"))
    fair = (4 * F.col("count") >= F.greatest("sure_a", "sure_b")) & alike("a", "b", threshold)
    both = pairs.join(side("a"), "a").join(side("b"), "b").where((F.col("rep_a") != F.col("rep_b")) & fair)
    return written(both.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct(), "near")

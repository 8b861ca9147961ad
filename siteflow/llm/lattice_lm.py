"""Language-model scores: a unigram base over words, and the marginal likelihood of a subword lattice.

The vocabulary is an existing one; it is never trained. A piece's weight is a mixture: VOCABULARY_SHARE of it is the
vocabulary's own score, whatever the size of the corpus, and the rest is the piece's expected share in all segmentations of
the training documents' words (one step of expectation-maximisation from counts of the vocabulary's own segmentation). A text's score sums the probability of all its segmentations: a forward recursion in log space runs over every distinct word once, since
no segmentation crosses a word boundary. Counts and statistics cover all documents.

Spark side: words are counted with a combine inside each task; each distinct word is scored once; words that make up
at least HEAD_SHARE of all tokens (so at most 1 / HEAD_SHARE of them) travel to the documents, the documents' other
words travel to the word table. Common words therefore never gather in one task.

Nulls: a null text is empty and has the end token alone; a null doc_id trains. Repeated rows give one row each, with
equal values, and are counted as often as they occur. Rows of one doc_id with different texts are told apart, by a 64-bit
hash of the text. An empty table gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteflow.llm.common import written
from siteflow.llm.sentencepiece_codec import BPE, BYTE, CONTROL, MARK, UNKNOWN, parse_model, pieces_of

FOLDS, HELD_OUT = 7, 2
HEAD_SHARE = 1e-5
#: Part of every piece's weight that is the vocabulary's own score, however much text there is.
VOCABULARY_SHARE = 0.1
FLUSH = 250_000
SMALLEST = 1e-290
LOG10 = math.log(10.0)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A to Z) words; bytes split at exactly the space and 9 to 13."""
    return (text or "").encode().lower().split()


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


class Lattice:
    """Log weights of pieces; `marginal` sums over all segmentations of a word."""

    def __init__(self, data: bytes, counts: dict[int, float] | None = None, ends: float = 0.0, share: float = VOCABULARY_SHARE):
        m = parse_model(data)
        prior = self._prior(m)
        counts = counts or {}
        total = sum(counts.values()) + ends
        share = share if total else 1.0
        end = 1 / (len(prior) + 1)  # the vocabulary has no score for the end, which stands as one piece of average weight
        mixed = lambda own, c: math.log(max(share * own + (1 - share) * c / max(1.0, total), 1e-300))
        log = lambda i: mixed((1 - end) * prior[i], counts.get(i, 0.0))
        self.end = mixed(end, ends)
        self.bytes = {int(p[3:5], 16): log(i) for i, (p, t) in enumerate(zip(m.pieces, m.types, strict=True)) if t == BYTE}
        weights = {p: log(i) for i, (p, t) in enumerate(zip(m.pieces, m.types, strict=True)) if t not in (BYTE, CONTROL, UNKNOWN) and p}
        #: Every prefix of a piece is a key, so that a walk ends as soon as no piece can follow; None: not a piece itself.
        self.table: dict[str, float | None] = {}
        for p in weights:
            for k in range(1, len(p)):
                self.table.setdefault(p[:k], None)
        self.table.update(weights)
        self.ids = {p: i for i, (p, t) in enumerate(zip(m.pieces, m.types, strict=True)) if p in weights and t not in (BYTE, CONTROL, UNKNOWN)}
        self.products: dict[str, tuple[int, float] | None] | None = None
        self.byte_ids = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(m.pieces, m.types, strict=True)) if t == BYTE}

    @staticmethod
    def _prior(m) -> list[float]:
        """The vocabulary's own scores as probabilities: a BPE model scores by rank, which Zipf's law turns into weights."""
        special = (CONTROL, UNKNOWN)
        if m.kind == BPE:
            raw = [0.0 if t in special else 1.0 / (2.0 - s) if s <= 0 and t != BYTE else 1e-6 for s, t in zip(m.scores, m.types, strict=True)]
        else:
            raw = [0.0 if t in special else math.exp(s) for s, t in zip(m.scores, m.types, strict=True)]
        total = sum(raw)
        return [x / total for x in raw]

    def marginal(self, word: str) -> float:
        """log10 of the summed probability of all segmentations of the marker and the word."""
        s = MARK + word
        n, table = len(s), self.table
        arriving: list[list[float]] = [[] for _ in range(n + 1)]
        arriving[0].append(0.0)
        for i in range(n):
            got = arriving[i]
            if not got:
                continue
            if len(got) == 1:
                here = got[0]
            else:
                top = max(got)
                here = top + math.log(sum([math.exp(x - top) for x in got]))
            covered = False
            for j in range(i + 1, n + 1):
                sub = s[i:j]
                if sub not in table:
                    break
                v = table[sub]
                if v is not None:
                    arriving[j].append(here + v)
                    covered |= j == i + 1
            if not covered:  # byte fallback for a character without a piece
                arriving[i + 1].append(here + sum(self.bytes.get(b, -20.0) for b in s[i].encode("utf-8", "replace")))
            arriving[i] = []
        got = arriving[n]
        top = max(got)
        return (top + math.log(sum(math.exp(x - top) for x in got))) / LOG10


    def expected(self, word: str, times: float, into: list[float]) -> None:
        """Adds to `into`, by piece, how often each piece is expected in `times` draws of the word's segmentations.

        Forward; then backward each place shares out its own expected visits over the pieces that lead to it. Products stand for sums
        of logs here; a long word whose probability is too small for a double is counted half by half.
        """
        self._expected(MARK + word, times, into)

    def _expected(self, s: str, times: float, into: list[float]) -> None:
        n, pieces = len(s), self._products()
        here = [0.0] * (n + 1)
        here[0] = 1.0
        steps = []
        for i in range(n):
            x = here[i]
            if not x:
                continue
            covered = False
            for j in range(i + 1, n + 1):
                sub = s[i:j]
                if sub not in pieces:
                    break
                piece = pieces[sub]
                if piece is not None:
                    here[j] += x * piece[1]
                    steps.append((i, j, piece))
                    if j == i + 1:
                        covered = True
            if not covered:
                spelled = s[i].encode("utf-8", "replace")
                weight = math.exp(sum(self.bytes.get(b, -20.0) for b in spelled))
                here[i + 1] += x * weight
                steps.append((i, i + 1, ([self.byte_ids[b] for b in spelled if b in self.byte_ids], weight)))
        if here[n] < SMALLEST and n > 1:
            self._expected(s[: n // 2], times, into)
            self._expected(s[n // 2 :], times, into)
            return
        visits = [0.0] * (n + 1)
        visits[n] = times
        for i, j, (piece, weight) in reversed(steps):
            if visits[j]:
                share = visits[j] * here[i] * weight / here[j]
                visits[i] += share
                if type(piece) is int:
                    into[piece] += share
                else:
                    for k in piece:
                        into[k] += share

    def _products(self) -> dict[str, tuple[int, float] | None]:
        if self.products is None:
            self.products = {p: None if v is None else (self.ids[p], math.exp(v)) for p, v in self.table.items()}
        return self.products


@lru_cache(maxsize=1)
def _reference(data: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=data)


def count_words(docs: DataFrame) -> DataFrame:
    """word, c (in training documents), n (in all), each word once. docs: doc_id, text."""
    schema = pa.schema([("word", pa.string()), ("c", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train: Counter = Counter()
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            found = list(train.keys() | held.keys())
            a, b = np.fromiter((train[w] for w in found), np.int64, len(found)), np.fromiter((held[w] for w in found), np.int64, len(found))
            return pa.record_batch([pa.array(found, pa.binary()).cast(pa.string()), pa.array(a), pa.array(a + b)], schema=schema)

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in pieces_of(texts, 1_000_000):
                for k, t in zip(keys[part], texts[part], strict=True):
                    (held if held_out(k) else train).update(words_of(t))
                if len(train) + len(held) > FLUSH:
                    yield rows()
                    train.clear()
                    held.clear()
        yield rows()

    return docs.mapInArrow(run, "word string, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def piece_counts(counted: DataFrame, model: bytes) -> dict[int, float]:
    """How often each piece occurs in the vocabulary's own segmentation of the training words: at most one row a piece."""
    shipped = counted.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("piece", pa.int32()), ("c", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _reference(shipped.value)
        total = np.zeros(sp.get_piece_size(), np.int64)
        for batch in batches:
            ids = sp.encode(batch.column(0).to_pylist(), num_threads=1)
            if ids:
                sizes = [len(x) for x in ids]
                np.add.at(total, np.fromiter((i for x in ids for i in x), np.int64, sum(sizes)), np.repeat(batch.column(1).to_numpy(), sizes))
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], schema=schema)

    found = counted.where("c > 0").select("word", "c").mapInArrow(run, "piece int, c long")
    return {r["piece"]: float(r["c"]) for r in found.groupBy("piece").agg(F.sum("c").alias("c")).collect()}


def expected_counts(counted: DataFrame, model: bytes, pieces: dict[int, float], ends: float) -> dict[int, float]:
    """How often each piece is expected over all segmentations of the training words, under the weights of first counts."""
    shipped = counted.sparkSession.sparkContext.broadcast((model, pieces, ends))
    schema = pa.schema([("piece", pa.int32()), ("c", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*shipped.value)
        total = [0.0] * (max([*lattice.ids.values(), *lattice.byte_ids.values()], default=0) + 1)
        for batch in batches:
            for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lattice.expected(w, c, total)
        at = [k for k, x in enumerate(total) if x > 0]
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array([total[k] for k in at], pa.float64())], schema=schema)

    found = counted.where("c > 0").select("word", "c").mapInArrow(run, "piece int, c double")
    return {r["piece"]: r["c"] for r in found.groupBy("piece").agg(F.sum("c").alias("c")).collect()}


def score_words(counted: DataFrame, model: bytes, pieces: dict[int, float], ends: float) -> DataFrame:
    """word, n, known, base (log10 of count plus one) and lattice (log10 marginal) of every distinct word."""
    shipped = counted.sparkSession.sparkContext.broadcast((model, pieces, ends))
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("lattice", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*shipped.value)
        for batch in batches:
            c = batch.column(1).to_numpy()
            marginals = [lattice.marginal(w) for w in batch.column(0).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array((c > 0).astype(np.int64)), pa.array(np.log10(c + 1.0)), pa.array(marginals, pa.float64())], schema=schema)

    return counted.select("word", "c", "n").mapInArrow(run, "word string, n long, known long, base double, lattice double")


ROW = pa.schema(
    [("doc_id", pa.int64()), ("v", pa.int64()), ("word", pa.string()), ("tf", pa.int64()), ("copies", pa.int64()), ("tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("lattice", pa.float64())]
)


def document_rows(docs: DataFrame, head: dict[bytes, tuple[int, float, float]]) -> DataFrame:
    """For each document: one row that sums its head words, under a key no word can equal, and one per other word."""
    shipped = docs.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {w: k for k, w in enumerate(shipped.value)}
        values = np.array([*shipped.value.values(), (0, 0.0, 0.0)])  # the last row stands for other words
        get, none = index.get, len(index)
        for batch in batches:
            keys, versions, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for part in pieces_of(texts, 1_000_000):
                cols: list[list] = [[] for _ in ROW]
                for k, v, t in zip(keys[part], versions[part], texts[part], strict=True):
                    ws = words_of(t)
                    codes = np.fromiter((get(w, none) for w in ws), np.int64, len(ws))
                    known, base, lattice = values[codes].sum(axis=0) if ws else (0, 0.0, 0.0)
                    other = Counter(map(ws.__getitem__, np.flatnonzero(codes == none).tolist()))
                    n = len(other)
                    cols[0] += [k] * (n + 1)
                    cols[1] += [v] * (n + 1)
                    cols[2] += [b" %d %d" % (k or 0, v), *other.keys()]
                    cols[3] += [0, *other.values()]
                    for at, x in zip(range(4, 9), (1, len(ws) + 1, int(known), float(base), float(lattice)), strict=True):
                        cols[at] += [x] + [0] * n
                cols[2] = pa.array(cols[2], pa.binary()).cast(pa.string())
                yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, ROW, strict=True)], schema=ROW)

    ddl = "doc_id long, v long, word string, tf long, copies long, tokens long, known long, base double, lattice double"
    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("v"), "text").mapInArrow(run, ddl)


def score(docs: DataFrame, model: bytes, *, id_col: str = "doc_id", text_col: str = "text", head_share: float = HEAD_SHARE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; scores are log10 probabilities of whole texts."""
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT
    counted = written(count_words(chosen), "counted")
    ends = chosen.where(~out).count()
    stats = counted.agg(F.sum("c").alias("c"), F.sum("n").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    n, v = (stats["c"] or 0) + ends, stats["v"] + (1 if ends else 0)

    pieces = expected_counts(counted, model, piece_counts(counted, model), float(ends))
    scored = written(score_words(counted, model, pieces, float(ends)), "scored")
    often = scored.where(F.col("n") > F.lit(head_share * (stats["n"] or 0)))  # fewer than 1 / head_share rows
    head = {r["word"].encode(): (r["known"], r["base"], r["lattice"]) for r in often.collect()}
    rare = scored.where(F.col("n") <= F.lit(head_share * (stats["n"] or 0))).select("word", F.col("known").alias("k"), F.col("base").alias("b"), F.col("lattice").alias("l"))

    rows = document_rows(chosen, head).join(rare, "word", "left")
    part = lambda own, word: F.sum(F.col(own) + F.col("tf") * F.coalesce(F.col(word), F.lit(0.0))).alias(own)
    sums = rows.groupBy("doc_id", "v").agg(F.sum("copies").alias("copies"), F.sum("tokens").alias("tokens"), part("known", "k"), part("base", "b"), part("lattice", "l"))
    end_known, end_base, end_log = (1 if ends else 0), math.log10(ends + 1.0), Lattice(model, pieces, float(ends)).end / LOG10
    each = sums.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    tokens = (F.col("tokens") / F.col("copies")).cast("long")
    return each.select(
        "doc_id", out.alias("held_out"), tokens.alias("n_tokens"),
        (F.round(F.col("known") / F.col("copies")).cast("long") + end_known).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("copies") + F.lit(end_base) - tokens * F.lit(math.log10(n + v + 1))).alias("base_score"),
        (F.col("lattice") / F.col("copies") + F.lit(end_log)).alias("score"),
    )

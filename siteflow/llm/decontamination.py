"""Benchmark decontamination: a BM25 inverted index of test items, queried by every passage of every document.

Items are scored as a share of their own best score, so one threshold fits short and long items. Document frequencies
and the mean length cover all items, however the items are dealt out to blocks. An item is held against passages of
2 * stride words that overlap by half, where its stride is the least of LEAST_STRIDE, twice that, four times and so on that
holds the item: it always stands whole in a passage, and other items change neither passages nor scores.

A passage is dropped early when a bound cannot reach the threshold: common words are the non-essential lists
(all of them together give an item at most `common_share` of the threshold), and the essential words' block maxima
bound every block of items. What is left goes through block-max WAND, which returns all items above the
threshold; a hit counts when question and answer of the item overlap the passage and its surroundings (one stride each way).

An index holds a block of about max_items items or max_words words at most. Tasks build the blocks; packed, they are shipped to every task of
a reading of the documents, as many of them at once as a stated number of bytes holds. The blocks' hits together are those of one index.

Nulls: null or empty texts have no passages; items without words are not indexed; hits of an item without an id have a null
item_id. Repeated rows give repeated hits. Empty tables give no rows. Only id and text columns are read, so clashing names do
no harm.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from siteflow.llm.common import written

K1, B = 1.2, 0.75
LEAST_STRIDE = 64
#: Letters are lowered, ASCII punctuation and controls become spaces; other bytes stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(FOLD).split()


def stride_of(words: int) -> int:
    """The least stride that holds an item of so many words."""
    return LEAST_STRIDE << max(0, math.ceil(math.log2(max(1, words) / LEAST_STRIDE)))


class Corpus(NamedTuple):
    """Statistics over all items: how many, their mean length, and in how many of them each word stands."""

    n: int
    mean: float
    df: dict[bytes, int]

    @staticmethod
    def of(cut: list[list[bytes]]) -> Corpus:
        cut = [c for c in cut if c]
        return Corpus(len(cut), sum(map(len, cut)) / max(1, len(cut)), Counter(w for c in cut for w in set(c)))


class ItemIndex:
    """Postings by term in item order, with block maxima."""

    def __init__(self, items: list[tuple[int | None, str]], threshold: float, corpus: Corpus | None = None, block: int = 2, common_share: float = 0.4):
        self.threshold, self.block = threshold, block
        kept = [(i, t, toks) for i, t in items if (toks := tokens(t))]
        corpus = corpus or Corpus.of([toks for _, _, toks in kept])
        self.ids = [i for i, _, _ in kept]
        self.parts = [self._parts(t, toks) for _, t, toks in kept]
        df, mean = corpus.df, corpus.mean
        self.term = {w: k for k, w in enumerate(sorted({w for _, _, toks in kept for w in toks}))}
        postings: list[list[tuple[int, float]]] = [[] for _ in self.term]
        for k, (_, _, toks) in enumerate(kept):
            norm = K1 * (1 - B + B * len(toks) / mean)
            impact = {w: np.log1p((corpus.n - df[w] + 0.5) / (df[w] + 0.5)) * n * (K1 + 1) / (n + norm) for w, n in Counter(toks).items()}
            best = sum(impact.values())
            for w, x in impact.items():
                postings[self.term[w]].append((k, x / best))
        self.items = [np.array([k for k, _ in p], np.int64) for p in postings]
        self.impacts = [np.array([x for _, x in p]) for p in postings]
        n_blocks = len(kept) // block + 1
        self.blocks = []  # by term: block -> largest impact
        for k, x in zip(self.items, self.impacts, strict=True):
            top = np.zeros(n_blocks)
            np.maximum.at(top, k // block, x)
            self.blocks.append({int(b): float(top[b]) for b in np.flatnonzero(top)})
        self.highest = np.array([x.max() for x in self.impacts]) if postings else np.zeros(0)
        self._choose_essential(len(kept), n_blocks, common_share)

    @staticmethod
    def _parts(text: str, toks: list[bytes]) -> tuple[list[bytes], list[bytes]]:
        """Question and answer: the last sentence is the answer; a single sentence is both."""
        sentences = [s for s in map(tokens, SENTENCE.split(text)) if s]
        return (sum(sentences[:-1], []), sentences[-1]) if len(sentences) > 1 else (toks, toks)

    def _choose_essential(self, n_items: int, n_blocks: int, common_share: float) -> None:
        """The commonest terms stay non-essential while no item gets more than common_share of the threshold from them."""
        share, self.common = np.zeros(max(1, n_items)), set()
        for t in sorted(range(len(self.items)), key=lambda t: -len(self.items[t])):
            more = share.copy()
            more[self.items[t]] += self.impacts[t]
            if len(self.items[t]) < 3 or more.max() > common_share * self.threshold:
                break
            share, _ = more, self.common.add(t)
        self.rest = np.zeros(n_blocks)  # by block: most that common terms can add
        np.maximum.at(self.rest, np.arange(len(share)) // self.block, share)
        lists = [[] if t in self.common else sorted(self.blocks[t].items()) for t in range(len(self.items))]
        self.list_at = np.append(0, np.cumsum([len(x) for x in lists])).astype(np.int64)
        self.list_block = np.array([b for x in lists for b, _ in x], np.int64)
        self.list_top = np.array([v for x in lists for _, v in x])
        self.n_blocks = n_blocks

    def hopeful(self, terms: np.ndarray, windows: np.ndarray, n_windows: int) -> np.ndarray:
        """Windows in which some block of items can reach the threshold; (term, window) pairs are distinct."""
        sizes = self.list_at[terms + 1] - self.list_at[terms]
        before = np.cumsum(sizes) - sizes
        at = np.repeat(self.list_at[terms] - before, sizes) + np.arange(int(sizes.sum()))
        cell = np.repeat(windows, sizes) * self.n_blocks + self.list_block[at]
        cells, inverse = np.unique(cell, return_inverse=True)
        bound = np.bincount(inverse, self.list_top[at], len(cells)) + self.rest[cells % self.n_blocks]
        return np.unique(cells[bound >= self.threshold - 1e-9] // self.n_blocks)

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """Block-max WAND: every item whose score for these distinct terms reaches the threshold."""
        need = self.threshold - 1e-9
        cursors = [[int(self.items[t][0]), 0, t] for t in terms]
        found = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(cursors):
                bound += self.highest[t]
                if bound >= need:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            b = item // self.block
            if sum(self.blocks[t].get(b, 0.0) for _, _, t in cursors[: pivot + 1]) < need:
                # No item of this block can do it with these lists: go on to the next block or the next list's item.
                target = (b + 1) * self.block
                if pivot + 1 < len(cursors):
                    target = min(target, cursors[pivot + 1][0])
                target = max(target, item + 1)
                moved = range(pivot + 1)
            elif cursors[0][0] == item:
                total = sum(float(self.impacts[t][at]) for _, at, t in cursors[: pivot + 1])
                if total >= need:
                    found.append((item, total))
                target, moved = item + 1, range(pivot + 1)
            else:
                target, moved = item, [k for k in range(pivot) if cursors[k][0] < item]
            for k in moved:
                c = cursors[k]
                c[1] += int(np.searchsorted(self.items[c[2]][c[1] :], target))
                c[0] = int(self.items[c[2]][c[1]]) if c[1] < len(self.items[c[2]]) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return found


def overlap(part: list[bytes], passage: list[bytes], n: int = 5) -> float:
    """Share of the n-grams of `part` (the whole, if it is shorter) that stand in the passage."""
    n = min(n, len(part))
    grams = {tuple(passage[k : k + n]) for k in range(len(passage) - n + 1)}
    wanted = [tuple(part[k : k + n]) for k in range(len(part) - n + 1)]
    return sum(g in grams for g in wanted) / max(1, len(wanted))


def hits_in(index: ItemIndex, cut: list[list[bytes]], stride: int, least: float) -> list[tuple[int, int, float, float, float, int]]:
    """(row, item, score, question overlap, answer overlap, first word) of verified hits, best passage of each row and item."""
    lengths = np.array([len(c) for c in cut], np.int64)
    get = index.term.get
    ids = np.fromiter((get(w, -1) for c in cut for w in c), np.int64, int(lengths.sum()))
    row_start = np.cumsum(lengths) - lengths
    first_block = np.cumsum(lengths // stride + 2) - (lengths // stride + 2)  # a spare block between rows
    known = np.flatnonzero(ids >= 0)
    row = np.repeat(np.arange(len(cut)), lengths)[known]
    term, block = ids[known], first_block[row] + (known - row_start[row]) // stride
    # Window k holds blocks k and k + 1 of a row.
    n_windows = int((lengths // stride + 2).sum())
    lower = np.where(block > first_block[row], block - 1, block)
    cells = np.unique(np.concatenate([block, lower]) * len(index.term) + np.concatenate([term, term])) if len(index.term) else np.zeros(0, np.int64)
    windows, terms = cells // max(1, len(index.term)), cells % max(1, len(index.term))
    best: dict[tuple[int, int], tuple[float, float, float, int]] = {}
    for w in index.hopeful(terms, windows, n_windows):
        inside = slice(*np.searchsorted(windows, [w, w + 1]))
        r = int(np.searchsorted(first_block, w, "right") - 1)
        start = int(w - first_block[r]) * stride
        for item, score in index.search(terms[inside].tolist()):
            score = round(score, 9)  # of passages that score the same the first counts
            question, answer = index.parts[item]
            passage = cut[r][max(0, start - stride) : start + 3 * stride]
            q, a = overlap(question, passage), overlap(answer, passage)
            if min(q, a) >= least and score > best.get((r, item), (0.0,))[0]:
                best[r, item] = (score, q, a, start)
    return [(r, item, *x) for (r, item), x in sorted(best.items())]


HITS = pa.schema([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("first_word", pa.int64())])
DDL = "item_id long, score double, question_overlap double, answer_overlap double, first_word long"


def item_words(items: DataFrame) -> DataFrame:
    """item_id, text, n_words and words (each once) of the items that have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [tokens(t) for t in batch.column(1).to_pylist()]
            keep = pa.array([bool(c) for c in cut], pa.bool_())
            words = pa.array([sorted(set(c)) for c in cut], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(c) for c in cut], pa.int64()), words], ["item_id", "text", "n_words", "words"]).filter(keep)

    chosen = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    return chosen.mapInArrow(run, "item_id long, text string, n_words long, words array<binary>")


def index_blocks(items: DataFrame, threshold: float, max_items: int, max_words: int) -> DataFrame:
    """block, index: one row a block, whose packed indexes (one a stride) a task builds from the block's items and its words' document frequencies.

    Rows of items are dealt to blocks by hash, equal rows apart, so a block holds about max_items items or max_words words at most.
    """
    cut_items = written(item_words(items).withColumn("row", F.monotonically_increasing_id()), "items")
    n, words = cut_items.agg(F.count("*"), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    blocks = max(1, -(-n // max_items), -(-words // max_words))
    tests = cut_items.withColumn("block", F.pmod(F.xxhash64("item_id", "text", "row"), F.lit(blocks)).cast("int"))
    in_block = tests.select("block", F.explode("words").alias("word")).groupBy("word", "block").agg(F.count("*").alias("n"))
    frequency = in_block.groupBy("word").agg(F.sum("n").alias("df"))
    of_block = in_block.select("word", F.col("block").alias("of")).join(frequency, "word")  # a word has at most a row a block
    mean = words / max(1, n)

    def build(mine: pa.Table, known: pa.Table) -> pa.Table:
        rows = sorted(zip(*(mine.column(c).to_pylist() for c in ("item_id", "text", "n_words")), strict=True), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        corpus = Corpus(n, mean, dict(zip(known.column("word").to_pylist(), known.column("df").to_pylist(), strict=True)))
        made = [(s, ItemIndex([x[:2] for x in rows if stride_of(x[2]) == s], threshold, corpus)) for s in sorted({stride_of(x[2]) for x in rows})]
        return pa.table({"block": pa.array(mine.column("block").to_pylist()[:1], pa.int32()), "index": pa.array([zlib.compress(pickle.dumps(made, 5), 1)], pa.binary())})

    return tests.select("block", "item_id", "text", "n_words").groupBy("block").cogroup(of_block.groupBy("of")).applyInArrow(build, "block int, index binary")


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    *,
    threshold: float = 0.5,
    least_overlap: float = 0.5,
    max_items: int = 20_000,
    max_words: int = 2_000_000,
    pass_bytes: int = 200_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Hits (doc_id, item_id, score, question_overlap, answer_overlap, first_word), no shuffle of documents.

    Documents without a hit have no row. A doc_id may be an integer or a string. One reading of the documents serves all blocks whose packed
    indexes take pass_bytes together; a task unpacks one block at a time. Through the driver goes one packed block after the other.
    """
    spark = docs.sparkSession
    textual = isinstance(docs.schema[id_col].dataType, StringType)
    chosen = docs.select(F.col(id_col).cast("string" if textual else "long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([pa.field("doc_id", pa.string() if textual else pa.int64()), *list(HITS)])
    ddl = f"doc_id {'string' if textual else 'long'}, {DDL}"

    def one(shipped: list[Broadcast]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            only = unpacked(shipped[0]) if len(shipped) == 1 else None
            for keys, texts in stretches(batches, 2_000_000 if only else 16_000_000):
                cut = [tokens(t) for t in texts]
                for block in shipped:
                    for stride, index in only or unpacked(block):
                        if found := hits_in(index, cut, stride, least_overlap):
                            rows = [(keys[r], index.ids[item], *x) for r, item, *x in found]
                            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        return chosen.mapInArrow(run, ddl)

    passes: list[DataFrame] = []
    shipped, size = [], 0
    for row in written(index_blocks(items, threshold, max_items, max_words), "index").toLocalIterator():
        if shipped and size + len(row["index"]) > pass_bytes:
            passes.append(one(shipped))
            shipped, size = [], 0
        shipped.append(spark.sparkContext.broadcast(bytes(row["index"])))
        size += len(row["index"])
    return reduce(DataFrame.unionByName, [*passes, one(shipped)] if shipped else [spark.createDataFrame([], ddl)])


def unpacked(block: Broadcast) -> list[tuple[int, ItemIndex]]:
    return pickle.loads(zlib.decompress(block.value))


def stretches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, list]]:
    """Ids and texts in stretches of about so many characters, over the borders of batches."""
    keys, texts, size = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keys.append(key)
            texts.append(text)
            size += len(text or "")
            if size >= most:
                yield keys, texts
                keys, texts, size = [], [], 0
    if keys:
        yield keys, texts

"""SimHash near-duplicates through a Gray-order hierarchical index.

A fingerprint has 64 bits, one for each bit that more than half of a text's shingle hashes have. Distinct fingerprints are linked
when at most `most` bits differ, and documents when their fingerprints are equal or linked.

Fingerprints are sorted by Gray rank, where neighbours differ in few bits, and FANOUT neighbours at a time become a node, whose mask is the
bits that all of them share and whose pattern is those bits; nodes become nodes in turn. A query carries its differences from the
top down, adding at each node only bits that the nodes above did not share, and drops a whole group once more than `most`
differ. At the bottom all 64 bits are counted, so nothing has to be verified.

Two fingerprints within `most` bits agree in one of most + 1 blocks of bits. For each block they are rotated so that it comes
first; as the first bits of a Gray rank depend on the first bits only, equal blocks are neighbours in the order, and one index is built for
each. A group of over MOST_ROWS fingerprints with equal blocks is dealt again by the blocks of its other bits, and so on, which
ends as bits run out: no group is larger, and none is cut. Exact copies are one fingerprint throughout. Groups send a tree of
their links, not all pairs.

Nulls: a null text counts as empty, and texts without words have fingerprint zero, linked like any other. A null doc_id has a row and never is
a component_id unless all its component's ids are null. Empty tables give no rows; repeated rows get equal rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteflow.llm.common import discard, lower_ascii, words, written
from siteflow.llm.components import components
from siteflow.llm.quality_rules import once

SHINGLE, MOST_BITS = 3, 2
FANOUT, MOST_ROWS = 8, 1 << 13
#: Hashes whose bits are counted at a time, and comparisons that a step of a search may hold.
COUNTED, FRONTIER = 1 << 17, 1 << 22
#: Keys of large groups are broadcast up to this many, joined beyond it.
SEND_KEYS = 1_000_000


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """XXH64 (seed 42) of every shingle of the lower-cased words, repeats included; fewer words are one shingle, none give none."""

    def hashes(ws: Column) -> Column:
        each = F.transform(F.slice(ws, 1, F.greatest(F.size(ws) - (size - 1), F.lit(0))), lambda w, i: F.xxhash64(F.concat_ws(" ", w, *[F.get(ws, i + k) for k in range(1, size)])))
        return F.when(F.size(ws) >= size, each).when(F.size(ws) > 0, F.array(F.xxhash64(F.array_join(ws, " ")))).otherwise(F.array().cast("array<bigint>"))

    return once(words(lower_ascii(text.cast("string"))), hashes)


def majority(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of hashes, which lie one behind the other and end at `ends`."""
    out = np.zeros(len(ends), np.int64)
    for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
        if b > a:
            bits = np.zeros(64, np.int64)
            for low in range(a, b, COUNTED):
                part = hashes[low : min(b, low + COUNTED)]
                bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
            out[k] = np.packbits(2 * bits > b - a, bitorder="little").view(np.int64)[0]
    return out


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (a long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            offsets = lists.offsets.to_numpy()
            values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False)[offsets[0] :], np.int64)
            yield pa.record_batch([b.column(0), pa.array(majority(values, offsets[1:] - offsets[0]))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), shingle_hashes(F.col(text_col)).alias("h")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(v: Column) -> Column:
    """Place of v in the Gray sequence."""
    halves = F.array(*[F.lit(k) for k in (32, 16, 8, 4, 2, 1)])
    return F.aggregate(halves, v, lambda x, k: x.bitwiseXOR(F.call_function("shiftrightunsigned", x, k)))


def turned(v: Column, mask: Column, low: Column, by: Column) -> Column:
    """v with its last `low` bits, those in the mask, rotated left."""
    rest = v.bitwiseAND(mask)
    moved = F.call_function("shiftleft", rest, by).bitwiseOR(F.call_function("shiftrightunsigned", rest, low - by)).bitwiseAND(mask)
    return v.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(moved)


def blocks(free: int, n: int) -> list[int]:
    """Sizes of n blocks of the free bits, the larger ones first."""
    return [free // n + (k < free % n) for k in range(n)]


class Index:
    """The hierarchy over rows of one or more groups, each in Gray order, and the search for pairs within it."""

    def __init__(self, v: np.ndarray, starts: np.ndarray):
        """v: fingerprints (unsigned, turned); starts: where each group begins."""
        self.v = v
        group = np.repeat(np.arange(len(starts)), np.diff([*starts, len(v)]))
        self.group, self.sizes = group, np.diff([*starts, len(v)])
        every, some, last = v, v, np.arange(len(v))
        #: From the rows up: pattern, mask, last row, first child and their number of each node.
        self.levels = [(v, np.full(len(v), ~np.uint64(0)), last, None, None)]
        while len(every) > len(starts):
            first = np.searchsorted(group, np.arange(len(starts)))
            heads = np.flatnonzero((np.arange(len(group)) - first[group]) % FANOUT == 0)
            every, some = np.bitwise_and.reduceat(every, heads), np.bitwise_or.reduceat(some, heads)
            ends = np.append(heads[1:], len(group))
            last, group = last[ends - 1], group[heads]
            mask = ~(every ^ some)
            self.levels.append((every & mask, mask, last, heads, ends - heads))

    def search(self, queries: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, later row of its group) of at most `most` differing bits."""
        pattern, mask, last, *_ = self.levels[-1]
        q, node = queries, self.group[queries]
        differ = np.bitwise_count((self.v[q] ^ pattern[node]) & mask[node])
        for k in range(len(self.levels) - 1, 0, -1):
            keep = (differ <= most) & (last[node] > q)
            q, node, differ = q[keep], node[keep], differ[keep]
            _, above, _, first, n = self.levels[k]
            pattern, mask, last, *_ = self.levels[k - 1]
            parent = np.repeat(np.arange(len(q)), n[node])
            within = np.arange(len(parent)) - np.repeat(np.cumsum(n[node]) - n[node], n[node])
            child = first[node][parent] + within
            q, differ = q[parent], differ[parent] + np.bitwise_count((self.v[q[parent]] ^ pattern[child]) & mask[child] & ~above[node][parent])
            node = child
        keep = (differ <= most) & (node > q)
        return q[keep], node[keep]

    def pairs(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All of them, so many queries at a time that no step holds much more than FRONTIER comparisons."""
        work = np.cumsum(self.sizes[self.group]) // FRONTIER
        for part in np.split(np.arange(len(self.v)), np.flatnonzero(np.diff(work)) + 1):
            yield self.search(part, most)


def trees(n: int, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least row of the component of each of n rows."""
    root = np.arange(n)
    for a, b in found:
        while len(a):
            x, y = root[a], root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root != (up := root[root])).any():
                root = up
    return root


def group_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b of a tree over each component within a group; rows (path, key, v, fp) come sorted, groups one behind the other."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(cols: list[np.ndarray]) -> pa.RecordBatch:
        path, key, v, fp = cols
        new = np.ones(len(v), bool)
        new[1:] = (path[1:] != path[:-1]) | (key[1:] != key[:-1])
        group = np.cumsum(new) - 1
        several = np.bincount(group, minlength=1)[group] > 1 if len(v) else np.zeros(0, bool)
        v, fp, group = v[several].view(np.uint64), fp[several], group[several]
        if not len(v):
            return pa.record_batch([pa.array([], pa.int64())] * 2, schema=schema)
        index = Index(v, np.flatnonzero(np.r_[True, group[1:] != group[:-1]]))
        root = trees(len(v), index.pairs(MOST_BITS))
        linked = root != np.arange(len(v))
        return pa.record_batch([pa.array(fp[linked]), pa.array(fp[root[linked]])], schema=schema)

    held = [np.zeros(0, np.int64)] * 4
    for b in batches:
        cols = [np.concatenate([h, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for h, c in zip(held, b.columns, strict=True)]
        path, key = cols[:2]
        whole = len(path) if not len(path) else int(np.flatnonzero((path != path[-1]) | (key != key[-1]))[-1:].sum() + ((path != path[-1]) | (key != key[-1])).any())
        held = [c[whole:] for c in cols]
        yield links([c[:whole] for c in cols])
    yield links(held)


def links(fps: DataFrame, *, most_rows: int = MOST_ROWS) -> DataFrame:
    """a, b: links that connect what fingerprints within MOST_BITS bits of each other connect; fps has distinct longs fp."""
    n = MOST_BITS + 1
    most_rows = max(most_rows, 1 << MOST_BITS)  # with no more than MOST_BITS bits left a group has no more rows, so every deal leaves fewer bits
    rows = fps.select(F.lit(0).cast("long").alias("path"), F.col("fp").alias("v"), "fp")
    ready, fixed = None, {0: 0}
    while True:
        # Each row once for each block of the bits that its group does not share yet. A path names the blocks that came first so far.
        moves, now = [], {}
        for path, bits in fixed.items():
            low, sizes = 64 - bits, blocks(64 - bits, n)
            for k, by in enumerate(accumulate([0, *sizes[:-1]])):
                now[path * n + k + 1] = bits + sizes[k]
                moves.append((path, path * n + k + 1, 64 - bits - sizes[k], -1 if low == 64 else (1 << low) - 1, low, by))
        ways = F.broadcast(rows.sparkSession.createDataFrame(moves, "path long, way long, free int, mask long, low int, by int"))
        dealt = rows.join(ways, "path").select(F.col("way").alias("path"), turned(F.col("v"), F.col("mask"), F.col("low"), F.col("by")).alias("v"), "fp", "free")
        dealt = dealt.withColumn("rank", gray_rank(F.col("v"))).withColumn("key", F.call_function("shiftrightunsigned", F.col("rank"), F.col("free")))
        size = dealt.groupBy("path", "key").count()
        hot = written(size.where(F.col("count") > most_rows).select("path", "key"), "hot")
        n_hot = hot.count()
        small = F.broadcast(hot) if n_hot <= SEND_KEYS else hot
        done = (dealt.join(small, ["path", "key"], "left_anti") if n_hot else dealt).select("path", "key", "rank", "v", "fp")
        ready = done if ready is None else ready.unionByName(done)
        if not n_hot:
            break
        rows = written(dealt.join(small, ["path", "key"], "left_semi").select("path", "v", "fp"), "hot_rows")
        found = {r["path"] for r in hot.select("path").distinct().collect()}  # ways to order the bits, not rows
        fixed = {p: b for p, b in now.items() if p in found}
    return ready.repartition("path", "key").sortWithinPartitions("path", "key", "rank").select("path", "key", "v", "fp").mapInArrow(group_links, "a long, b long")


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable)."""
    named = written(fingerprints(docs, id_col=id_col, text_col=text_col), "fingerprints")
    distinct = written(named.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    edges = written(links(distinct.select("fp"), most_rows=most_rows), "links")
    roots = components(edges).select(F.col("node").alias("fp"), "component")
    placed = written(distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component")), "placed")
    discard(edges, distinct)
    least = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = placed.join(least, "component").select("fp", "component_id")
    return named.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

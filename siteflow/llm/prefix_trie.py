"""Prefix trie of conversations: adaptive radix trees over fixed-width big-endian turn ids.

A turn's id is 20 bytes: 16 of a hash of role and text, then the number of words of the text. A conversation is the byte
string of its turns' ids, and conversations with equal turns are one key with its members' number, least id and digest. Keys
are dealt to key ranges of about PART_BYTES; a range becomes one radix tree (layouts that grow with the children, compressed
paths), of which only the depths at whole turns are nodes of the trie: a compressed path holds several, a branch inside an id none.

Splitters of the ranges are sampled keys, cut after the first turn in which they differ from the splitter before. So a node has
conversations in two ranges only if it is a proper prefix of a splitter. Those few nodes (the root is always one) are summed
over the ranges and finished on the driver, whose table grows with the number of ranges; all others are finished where they are.

No group is gathered: a node's members are chunks of ids that one task streams through the digest, and a common first turn is cut
by splitters behind it. One conversation is one key, 20 bytes a turn.

Nulls: rows without a conv_id belong to no conversation; null role or text counts as empty; turns come by number, null first, and equal
numbers by id. Repeated rows are repeated turns. An empty table has no nodes. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteflow.llm.common import discard, words, written

WIDTH = 20
PART_BYTES = 1 << 18
#: Most key ranges; beyond it they grow in size. So many sampled keys stand for each.
MOST_PARTS, SAMPLED = 1 << 18, 4
#: Members of a node come to its digest in chunks of at most 1 << CHUNK_BITS.
CHUNK_BITS = 12
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = pa.schema([("open", pa.int32()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("open_parent", pa.int32()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())])
NODE_DDL = "open int, conv_id long, depth long, parent_conv_id long, open_parent int, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


class Node:
    """A radix node: the compressed bytes that lead to it, its children by their first byte, and a value.

    Up to SORTED children lie beside their sorted bytes, up to INDEXED behind a table of 256 slot numbers, more in 256 slots.
    """

    __slots__ = ("keys", "path", "slots", "value")
    SORTED, INDEXED = 16, 48

    def __init__(self, path: bytes, value: object = None):
        self.path, self.value, self.keys, self.slots = path, value, bytearray(), []

    def slot(self, byte: int) -> int:
        """Where the child with this byte lies, -1 if there is none."""
        if self.keys is None:
            return -1 if self.slots[byte] is None else byte
        return self.keys[byte] - 1 if len(self.keys) == 256 else self.keys.find(byte)

    def add(self, byte: int, child: Node) -> None:
        if self.keys is None:
            self.slots[byte] = child
        elif len(self.keys) == 256 and len(self.slots) < self.INDEXED:
            self.slots.append(child)
            self.keys[byte] = len(self.slots)
        elif len(self.keys) < self.SORTED:
            at = bisect_left(self.keys, byte)
            self.keys.insert(at, byte)
            self.slots.insert(at, child)
        else:
            self.grow()
            self.add(byte, child)

    def grow(self) -> None:
        if len(self.keys) == 256:
            self.slots, self.keys = [self.slots[k - 1] if k else None for k in self.keys], None
        else:
            table = bytearray(256)
            for at, byte in enumerate(self.keys, 1):
                table[byte] = at
            self.keys = table

    def children(self) -> list[Node]:
        """In order of their bytes."""
        if self.keys is None:
            return [x for x in self.slots if x is not None]
        return [self.slots[k - 1] for k in self.keys if k] if len(self.keys) == 256 else self.slots


def insert(root: Node, key: bytes, value: object) -> None:
    node, at = root, 0
    while at < len(key):
        slot = node.slot(key[at])
        if slot < 0:
            node.add(key[at], Node(key[at:], value))
            return
        child = node.slots[slot]
        path = child.path
        if not key.startswith(path, at):
            same = next((k for k, (x, y) in enumerate(zip(path, key[at:], strict=False)) if x != y), min(len(path), len(key) - at))
            fork = Node(path[:same])
            child.path = path[same:]
            fork.add(path[same], child)
            node.slots[slot] = child = fork
        node, at = child, at + len(child.path)
    node.value = value


class Turn:
    """A node of the trie while its subtree is walked."""

    __slots__ = ("children", "closed", "conv_id", "depth", "ends", "leaves", "n", "open", "saved", "words")

    def __init__(self, depth: int, words: int, open: int):
        self.depth, self.words, self.open = depth, words, open
        self.n = self.children = self.leaves = self.saved = 0
        self.conv_id, self.ends, self.closed = None, NO_ENDS, []

    def take(self, n: int, conv_id: int) -> None:
        self.n += n
        self.conv_id = conv_id if self.conv_id is None else min(self.conv_id, conv_id)

    def row(self, parent_conv_id: int | None, open_parent: int) -> tuple:
        return self.open, self.conv_id, self.depth, parent_conv_id, open_parent, self.n, self.children, self.leaves, self.saved, self.ends


def trie_nodes(root: Node, open_nodes: dict[bytes, int]) -> list[tuple]:
    """Rows of NODE for every depth at whole turns. An open node's row sums what is in this tree without its open children."""
    rows, path = [], bytearray()
    turns = [Turn(0, 0, open_nodes[b""])]
    todo: list[tuple[Node, int]] = [(root, -1)]
    while todo:
        node, opened = todo.pop()
        if opened < 0:  # on the way down
            before = len(path) // WIDTH
            path += node.path
            for depth in range(before + 1, len(path) // WIDTH + 1):
                end = WIDTH * depth
                turns.append(Turn(depth, int.from_bytes(path[end - 4 : end], "big"), open_nodes.get(bytes(path[:end]), -1) if turns[-1].open >= 0 else -1))
            if node.value is not None:
                turns[-1].take(*node.value[:2])
                turns[-1].ends = node.value[2]
            todo.append((node, len(path) // WIDTH - before))
            todo += [(x, -1) for x in node.children()]
            continue
        for _ in range(opened):
            t, above = turns.pop(), turns[-1]
            if t.open >= 0:
                rows.append(t.row(None, above.open))
                continue
            t.leaves = t.leaves or 1
            t.saved += (t.n - 1) * t.words
            rows += [x.row(t.conv_id, -1) for x in t.closed]
            t.closed = []
            above.take(t.n, t.conv_id)
            above.children, above.leaves, above.saved = above.children + 1, above.leaves + t.leaves, above.saved + t.saved
            if above.open >= 0:
                rows.append(t.row(None, above.open))
            else:
                above.closed.append(t)
        del path[len(path) - len(node.path) :]
    return [*rows, turns[0].row(None, -1)]


def turn_ids(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, id (hex)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    named = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    return conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.concat(named, F.lpad(F.hex(F.size(words(text))), 8, "0")).alias("id"))


def own_turns(conversations: DataFrame) -> DataFrame:
    """conv_id and turns, the ids in order."""
    return turn_ids(conversations).groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "id"))), lambda x: x["id"]).alias("turns"))


def rebuilt(own: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Every conversation behind the first turns of its group's first one: as many as its own number decides, below `most`."""
    heads = own.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("donor"), F.slice("turns", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    joined = own.select("conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % group).alias("donor"), h.alias("h")).join(heads, "donor", "left")
    none = F.array().cast("array<string>")
    return joined.select("conv_id", F.concat(F.slice(F.coalesce("head", none), 1, F.col("h")), F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, n, conv_id (the least), ends: of rows sorted by kid and bucket, whose chunks of ids go through the digest in turn."""
    schema = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("conv_id", pa.int64()), ("ends", pa.string())])
    last, held = None, None
    for batch in batches:
        done = []
        for kid, key, n, first, ids in zip(*[batch.column(c).to_pylist() for c in ("kid", "key", "n", "first", "ids")], strict=True):
            if kid == last:
                held[1] += n
                held[3].update(b"," + ids.encode())
                continue
            if last is not None:
                done.append((*held[:3], held[3].hexdigest()))
            last, held = kid, [key, n, first, hashlib.sha256(ids.encode())]
        yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True) if done else [[]] * 4, schema, strict=True)], schema=schema)
    if last is not None:
        yield pa.record_batch([pa.array([x], f.type) for x, f in zip([*held[:3], held[3].hexdigest()], schema, strict=True)], schema=schema)


def distinct_keys(sequences: DataFrame) -> DataFrame:
    """key, n, conv_id, ends of each distinct sequence of turns; members with as many turns as the node are its ends."""
    members = sequences.select("conv_id", F.unhex(F.array_join("turns", "")).alias("key")).withColumn("kid", F.unhex(F.md5("key")))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    chunks = members.groupBy("kid", F.shiftright("conv_id", CHUNK_BITS).alias("bucket")).agg(F.first("key").alias("key"), F.count("*").alias("n"), F.min("conv_id").alias("first"), ids.alias("ids"))
    return chunks.repartition("kid").sortWithinPartitions("kid", "bucket").mapInArrow(digests, "key binary, n long, conv_id long, ends string")


def splitters(keys: DataFrame, part_bytes: int) -> list[bytes]:
    """Cut keys, ascending: a sample's quantiles up to the first turn that differs from the one before."""
    n, size = keys.agg(F.count("*"), F.coalesce(F.sum(F.length("key")), F.lit(0))).first()
    parts = min(MOST_PARTS, -(-size // part_bytes))
    if parts < 2:
        return []
    drawn = sorted({bytes(r["key"]) for r in keys.sample(min(1.0, SAMPLED * parts / n), seed=7).select("key").collect()} - {b""})
    picked = drawn[:: max(1, len(drawn) // parts)][1:]
    out, last = [], b""
    for key in picked:
        turn = next(k for k in range(0, len(key), WIDTH) if key[k : k + WIDTH] != last[k : k + WIDTH])
        out.append(key[: turn + WIDTH])
        last = key
    return out


def nodes(sequences: DataFrame, *, part_bytes: int = PART_BYTES) -> DataFrame:
    """The trie of sequences (conv_id, turns: array of hex ids): one row a node, COLUMNS."""
    spark = sequences.sparkSession
    keys = written(distinct_keys(sequences), "keys")
    cuts = splitters(keys, part_bytes)
    open_nodes = {p: k for k, p in enumerate(sorted({b""} | {c[:k] for c in cuts for k in range(0, len(c), WIDTH)}))}
    shipped = spark.sparkContext.broadcast((cuts, open_nodes))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = shipped.value[0]
        for b in batches:
            yield pa.record_batch([*b.columns, pa.array([bisect_right(ends, k) for k in b.column("key").to_pylist()], pa.int32())], names=[*b.schema.names, "part"])

    def built(root: Node) -> pa.RecordBatch:
        rows = trie_nodes(root, shipped.value[1])
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), NODE, strict=True)], schema=NODE)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, root = None, None
        for b in batches:
            for p, *row in zip(*[b.column(c).to_pylist() for c in ("part", "key", "n", "conv_id", "ends")], strict=True):
                if p != part:
                    if root is not None:
                        yield built(root)
                    part, root = p, Node(b"")
                insert(root, row[0], tuple(row[1:]))
        if root is not None:
            yield built(root)

    dealt = keys.mapInArrow(deal, "key binary, n long, conv_id long, ends string, part int")
    found = written(dealt.repartition("part").sortWithinPartitions("part").mapInArrow(grow, NODE_DDL), "nodes")
    discard(keys)
    # One row for each open node of each range: as many as splitters have turns.
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    end = F.max(F.when(F.col("ends_sha256") != NO_ENDS, F.col("ends_sha256"))).alias("ends_sha256")
    upper = {r["open"]: r.asDict() for r in found.where("open >= 0").groupBy("open").agg(F.min("conv_id").alias("conv_id"), *sums, end).collect()}
    rest = found.where("open < 0")
    if not upper:
        return rest.select(COLUMNS)
    finished = _finish(upper, open_nodes)
    # No larger than what the driver holds anyway.
    above = F.broadcast(spark.createDataFrame([(r["open"], r["conv_id"]) for r in finished], "open_parent int, above long"))
    own = spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in finished], ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in COLUMNS))
    return rest.join(above, "open_parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above")).select(COLUMNS).unionByName(own)


def _finish(upper: dict[int, dict], open_nodes: dict[bytes, int]) -> list[dict]:
    """Open nodes with their open children added, deepest first."""
    paths = sorted(open_nodes, key=len, reverse=True)
    for path in paths:
        me = upper[open_nodes[path]]
        me |= {"depth": len(path) // WIDTH, "ends_sha256": me["ends_sha256"] or NO_ENDS, "parent_conv_id": None}
        me["saved_tokens"] += (me["n_convs"] - 1) * int.from_bytes(path[-4:], "big") if path else 0
        if path:
            above = upper[open_nodes[path[:-WIDTH]]]
            above["conv_id"] = me["conv_id"] if above["conv_id"] is None else min(above["conv_id"], me["conv_id"])
            above["n_children"] += 1
            for c in ("n_convs", "n_leaves", "saved_tokens"):
                above[c] += me[c]
        else:
            me["n_leaves"] = me["n_leaves"] or 1  # only turnless conversations
    for path in paths:
        if path:
            upper[open_nodes[path]]["parent_conv_id"] = upper[open_nodes[path[:-WIDTH]]]["conv_id"]
    return list(upper.values())


def trie(conversations: DataFrame, *, part_bytes: int = PART_BYTES) -> DataFrame:
    """Nodes of the trie of a table of turns (conv_id, turn, role, text)."""
    return nodes(own_turns(conversations), part_bytes=part_bytes)


def rebuilt_trie(conversations: DataFrame, *, part_bytes: int = PART_BYTES) -> DataFrame:
    """The same after conversations are rebuilt from their group's first one."""
    own = written(own_turns(conversations), "own")
    return nodes(rebuilt(own), part_bytes=part_bytes)

"""The prefix trie against its SQL, with key ranges of any size, and against a plain version on odd tables."""

import collections
import hashlib
import random
import zlib

import pytest
from oracle import connect, plain

from siteflow.llm import prefix_trie
from siteflow.llm.common import table
from siteflow.llm.oracles import OP13

SF = "/root/testdata/sf0.01"


def brute(rows, rebuild=True):
    """rows: (conv_id, turn, role, text)."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            named = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0), named, (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    made = own
    if rebuild:
        made = {}
        for c, v in own.items():
            h = zlib.crc32(str(c).encode()) % 4
            made[c] = own.get(c - c % 20, [])[:h] + v[h:]
    members = collections.defaultdict(list)
    for c, v in made.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids, below = collections.Counter(), collections.defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]] += 1
        for d in range(len(node) + 1):
            below[node[:d]].append(node)
    words = lambda t: len(t.replace("\n", " ").replace("\t", " ").split())
    saved = {n: (len(m) - 1) * words(n[-1][1]) if n else 0 for n, m in members.items()}
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), kids[n], sum(not kids[x] for x in below[n]), sum(saved[x] for x in below[n]),
         hashlib.sha256(",".join(str(c) for c in sorted(m) if len(made[c]) == len(n)).encode()).hexdigest())
        for n, m in members.items()
    )


def got(df):
    return sorted((tuple(r) for r in df.select(prefix_trie.COLUMNS).collect()), key=lambda r: tuple((x is not None, x) for x in r))


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("part_bytes", [60, 2000, 1 << 18])
def test_equals_sql_for_any_ranges(spark, part_bytes):
    rows = prefix_trie.rebuilt_trie(table(spark, SF, "conversations"), part_bytes=part_bytes).collect()
    con = connect(SF).execute(OP13)
    names = [d[0] for d in con.description]
    assert sorted(plain(tuple(r[n] for n in names)) for r in rows) == sorted(plain(tuple(r)) for r in con.fetchall())


@pytest.mark.parametrize("part_bytes", [40, 400, 1 << 18])
@pytest.mark.parametrize("seed", [1, 2])
def test_many_shared_prefixes(spark, part_bytes, seed):
    draw = random.Random(seed)
    rows = []
    for c in range(260):
        n = 40 if c % 90 == 0 else draw.randint(0, 6)
        for t in range(n):
            rows.append((c * 97 % 5003, t, "user" if t % 2 == 0 else "assistant", "hot start" if t == 0 and c % 3 else f"say {draw.randint(0, 2)} again"))
    convs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert got(prefix_trie.rebuilt_trie(convs, part_bytes=part_bytes)) == ordered(brute(rows))
    assert got(prefix_trie.trie(convs, part_bytes=part_bytes)) == ordered(brute(rows, False))


def test_hot_conversation_and_wide_root(spark):
    """Thousands of equal conversations, whose ids fill several chunks, and more first turns than any layout but the largest holds."""
    rows = [(c, 0, "user", "the same") for c in range(9000)] + [(20_000 + c, 0, "user", f"number {c}") for c in range(700)]
    convs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert got(prefix_trie.trie(convs, part_bytes=500)) == ordered(brute(rows, False))


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", ""), (1, 0, "user", "b a"), (1, 0, "user", "b a"), (None, 0, "user", "lost"), (2, 5, "u", "se"), (2, 6, "us", "e"), (-3, 0, "user", "x " * 3000), (7, 0, None, "é 漢字"), (27, 1, "user", "a"), (20, 0, "", "first"), (20, 1, "", "second")]
    convs = spark.createDataFrame([(*r, 1, "clash") for r in rows], "conv_id long, turn long, role string, text string, depth int, key string")
    for size in (20, 1 << 18):
        assert got(prefix_trie.trie(convs, part_bytes=size)) == ordered(brute(rows, False))
    plain_rows = [r for r in rows if r[0] != -3]  # a remainder below zero is SQL's
    assert got(prefix_trie.rebuilt_trie(convs.where("conv_id <> -3"), part_bytes=40)) == ordered(brute(plain_rows))


def test_turnless_and_empty(spark):
    convs = spark.createDataFrame([(1, 0, "user", "only")], "conv_id long, turn long, role string, text string")  # 1 takes one turn of conversation 0, which is absent
    assert zlib.crc32(b"1") % 4 > 0
    assert got(prefix_trie.rebuilt_trie(convs)) == [(1, 0, None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())]
    assert prefix_trie.rebuilt_trie(convs.limit(0)).count() == 0


def test_layouts_grow():
    draw = random.Random(3)
    keys = {bytes(draw.choices(range(256), k=draw.randint(1, 3))) for _ in range(3000)}
    root = prefix_trie.Node(b"")
    for k in keys:
        prefix_trie.insert(root, k, k)
    seen, todo = set(), [(root, b"")]
    while todo:
        node, path = todo.pop()
        path += node.path
        if node.value is not None:
            assert node.value == path
            seen.add(path)
        kids = node.children()
        assert [k.path[0] for k in kids] == sorted(k.path[0] for k in kids) or node.keys is not None and len(node.keys) == 256
        todo += [(k, path) for k in kids]
    assert seen == keys and root.keys is None

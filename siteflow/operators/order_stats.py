"""Exact order statistics by distributed selection: digits of order-preserving keys are counted until a rank is pinned.

A double becomes an unsigned 64-bit key in the same order. Each pass counts, among the keys that share a rank's digits so far, the next
DIGIT bits, which tells the digit of the rank's key. A task holds 2 ** DIGIT counters for each rank, whatever the data; no values
are sorted or gathered until a rank is among at most FEW of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGIT = 12
#: A rank that is among so many values at most is picked from them.
FEW = 1 << 14
SIGN = 1 << 63


def keys(x: np.ndarray) -> np.ndarray:
    """Unsigned keys in the order of the doubles; zeros of both signs are equal, and NaN comes last."""
    bits = np.ascontiguousarray(np.where(np.isnan(x), np.nan, x + 0.0)).view(np.uint64)
    return np.where(bits >= np.uint64(SIGN), ~bits, bits ^ np.uint64(SIGN))


def value_of(key: int) -> float:
    bits = key ^ SIGN if key >= SIGN else key ^ (2 * SIGN - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def leading(k: np.ndarray, known: int) -> np.ndarray:
    """The first `known` bits."""
    return k >> np.uint64(64 - known) if known else np.zeros(len(k), np.uint64)


def digit_counts(x: DataFrame, prefixes: list[int], known: int, width: int) -> dict[int, np.ndarray]:
    """prefix -> how many of its keys have each next digit."""
    heads = np.array(prefixes, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(heads), 1 << width), np.int64)
        for b in batches:
            k = keys(b.column(0).to_numpy(zero_copy_only=False))
            head = leading(k, known)
            at = np.minimum(np.searchsorted(heads, head), len(heads) - 1)
            mine = heads[at] == head
            digit = (k[mine] >> np.uint64(64 - known - width)) & np.uint64((1 << width) - 1)
            total += np.bincount(at[mine] * (1 << width) + digit.astype(np.int64), minlength=total.size).reshape(total.shape)
        at, digit = np.nonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(digit.astype(np.int32)), pa.array(total[at, digit])], names=["at", "digit", "n"])

    found = {p: np.zeros(1 << width, np.int64) for p in prefixes}
    for r in x.mapInArrow(run, "at int, digit int, n long").groupBy("at", "digit").agg(F.sum("n").alias("n")).collect():  # at most 2 ** DIGIT a rank
        found[prefixes[r["at"]]][r["digit"]] = r["n"]
    return found


def members(x: DataFrame, wanted: list[tuple[int, int]]) -> dict[tuple[int, int], list[float]]:
    """(prefix, known) -> its values in order, at most FEW of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(0).to_numpy(zero_copy_only=False)
            k = keys(v)
            for at, (prefix, known) in enumerate(wanted):
                mine = v[leading(k, known) == np.uint64(prefix)]
                yield pa.record_batch([pa.array(np.full(len(mine), at, np.int32)), pa.array(mine)], names=["at", "x"])

    out: dict[tuple[int, int], list[float]] = {w: [] for w in wanted}
    for r in x.mapInArrow(run, "at int, x double").collect():
        out[wanted[r["at"]]].append(r["x"])
    return {w: sorted(v, key=lambda y: int(keys(np.array([y]))[0])) for w, v in out.items()}


def order_statistics(df: DataFrame, column: str, ranks: list[int]) -> list[float]:
    """The values at the given places (from 0) of the ascending order; nulls do not count, NaN comes last."""
    x = df.select(F.col(column).cast("double").alias("x")).where("x IS NOT NULL")
    state = {r: (0, r) for r in set(ranks)}  # its key's first digits, and its place among the keys that share them
    picked: dict[int, float] = {}
    small: dict[int, tuple[int, int, int]] = {}
    known = 0
    while state and known < 64:
        width = min(DIGIT, 64 - known)
        counts = digit_counts(x, sorted({p for p, _ in state.values()}), known, width)
        for r, (prefix, place) in list(state.items()):
            ends = np.cumsum(counts[prefix])
            if not 0 <= place < ends[-1]:
                raise IndexError(f"no value at place {r} of {ends[-1]}")
            digit = int(np.searchsorted(ends, place, "right"))
            place -= int(ends[digit - 1]) if digit else 0
            state[r] = (prefix << width | digit, place)
            if counts[prefix][digit] <= FEW:
                small[r] = (*state.pop(r), known + width)
        known += width
    picked |= {r: value_of(p) for r, (p, _) in state.items()}
    if small:
        held = members(x, sorted({(p, k) for p, _, k in small.values()}))
        picked |= {r: held[p, k][place] for r, (p, place, k) in small.items()}
    return [picked[r] for r in ranks]

"""SentencePiece encoding and decoding through the tokenizers library.

The model protobuf is parsed here (wire format only), and from it the tokenizer is rebuilt: character map or
identity normaliser, the metaspace marker, a unigram model from the scores or a BPE model whose merges follow
the scores, and byte fallback. Encoding runs per Arrow batch inside Spark tasks; every distinct piece of text
between markers is encoded once per task and checked against the SentencePiece library (parity). The library adds scores up
in 32 bits, so segmentations of a unigram model that score the same can come out either way; parity tells.

Nulls: a null text has null ids and pieces count 0. An empty text has no ids. Rows with equal texts give equal ids.
Columns of the input that are not asked for are ignored, so clashing names do no harm.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
# Piece types and wire numbers fixed by the public sentencepiece_model.proto.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(buf: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) pairs of one protobuf message; fixed32 values stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = buf[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(buf):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, buf[at : at + n]
            at += n
        else:
            n = {5: 4, 1: 8}[kind]
            yield tag >> 3, buf[at : at + n]
            at += n


@dataclass
class Model:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze_spaces: bool = True
    escape_spaces: bool = True


def parse_model(data: bytes) -> Model:
    import struct

    m = Model()
    for number, value in _fields(data):
        if number == 1:
            text, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    text = v.decode("utf-8")
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            m.pieces.append(text)
            m.scores.append(score)
            m.types.append(kind)
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    m.kind = v
                elif n == 35:
                    m.byte_fallback = bool(v)
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    m.charsmap = v
                elif n == 3:
                    m.dummy_prefix = bool(v)
                elif n == 4:
                    m.squeeze_spaces = bool(v)
                elif n == 5:
                    m.escape_spaces = bool(v)
    return m


def merges_by_score(m: Model) -> list[tuple[str, str]]:
    """Every way to make a piece of two pieces, best score first, so that BPE merges as the scores say."""
    score = {p: s for p, s, t in zip(m.pieces, m.scores, m.types, strict=True) if t in (NORMAL, USER_DEFINED)}
    found = []
    for piece, s in score.items():
        for cut in range(1, len(piece)):
            left, right = piece[:cut], piece[cut:]
            if left in score and right in score:
                found.append((-s, cut, left, right))
    return [(left, right) for _, _, left, right in sorted(found)]


def build_tokenizer(m: Model):
    """A tokenizers.Tokenizer without normaliser steps for the marker: `Codec` adds it when it splits."""
    from tokenizers import Tokenizer, models

    if m.kind == BPE:
        vocab = {p: i for i, p in enumerate(m.pieces)}
        model = models.BPE(vocab=vocab, merges=merges_by_score(m), unk_token=m.pieces[m.types.index(UNKNOWN)], fuse_unk=True, byte_fallback=m.byte_fallback)
    elif m.kind == UNIGRAM:
        # A text never stands for a control, unused or byte piece, so these get names that no text holds; `Codec` spells unknowns in bytes.
        named = [p if t in (NORMAL, USER_DEFINED) else f"\U0010ffff{i}\U0010ffff" for i, (p, t) in enumerate(zip(m.pieces, m.types, strict=True))]
        model = models.Unigram(list(zip(named, m.scores, strict=True)), unk_id=m.types.index(UNKNOWN), byte_fallback=False)
    else:
        raise ValueError(f"model type {m.kind} is not supported")
    return Tokenizer(model)


class Codec:
    """Encodes and decodes texts. Each distinct chunk (marker and what follows it) is encoded once; about `cache` are kept.

    A chunk is looked up by its text after the marker; a chunk of several markers by its whole text.
    """

    def __init__(self, data: bytes, threads: int = 1, cache: int = 500_000, verify: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true" if threads > 1 else "false")
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        self.model = m = parse_model(data)
        self.tokenizer = build_tokenizer(m)
        self.charsmap = None
        if m.charsmap:
            from tokenizers import normalizers

            self.charsmap = normalizers.Precompiled(m.charsmap)
        # Cutting before a run of markers loses nothing when no piece holds a marker after another character.
        self.cuts = m.dummy_prefix and m.escape_spaces and not any(MARK in p.lstrip(MARK) for p in m.pieces)
        if self.cuts:
            from tokenizers import pre_tokenizers

            self.cutter = pre_tokenizers.Metaspace(replacement=MARK, prepend_scheme="never", split=True)
        self.reference = None
        if verify:
            import sentencepiece

            self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.opens = np.array([p.startswith(MARK) for p in m.pieces])
        self.bytes_of = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else p.replace(MARK, " ").encode() for p, t in zip(m.pieces, m.types, strict=True)]
        self.unknown = m.types.index(UNKNOWN)
        self.spelled = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(m.pieces, m.types, strict=True)) if t == BYTE} if m.kind == UNIGRAM and m.byte_fallback else None
        self.limit = cache
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.start, self.length, self.good = (np.zeros(0, t) for t in (np.int64, np.int64, bool))
        self.pool = np.zeros(0, np.int32)

    def normalise(self, text: str) -> str:
        if self.charsmap is not None:
            text = self.charsmap.normalize_str(text)
        if self.model.squeeze_spaces:
            text = re.sub(" +", " ", text.strip(" "))
            text = text.rstrip(f" {MARK}") if self.model.escape_spaces else text  # a marker in the text counts as a space at its end
        return text

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        if not self.cuts:
            text = text.replace(" ", MARK) if self.model.escape_spaces else text
            return [MARK + (MARK + text if self.model.dummy_prefix else text)]
        found = text.split(" ")
        if MARK in text or "" in found:  # several markers in a row
            whole = MARK + text.replace(" ", MARK)
            return [x[1:] if x[1:2] != MARK and len(x) > 1 else MARK + x for x in re.findall(f"{MARK}+[^{MARK}]*", whole)]
        return found

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; unknown characters of a unigram model become their bytes."""
        coded = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if self.spelled is None:
            return coded
        for k in [k for k, ids in enumerate(coded) if (ids == self.unknown).any()]:
            e = self.tokenizer.encode(texts[k], add_special_tokens=False)
            spelled = [[self.spelled[b] for b in texts[k][a:z].encode()] if i == self.unknown else [i] for i, (a, z) in zip(e.ids, e.offsets, strict=True)]
            coded[k] = np.array(list(chain.from_iterable(spelled)), np.int32)
        return coded

    def _together(self, plain: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of chunks with one marker each, encoded as long strings: a piece with a marker opens a chunk."""
        self.tokenizer.pre_tokenizer = self.cutter
        groups = [MARK + MARK.join(plain[k : k + 2000]) for k in range(0, len(plain), 2000)]
        ids = np.concatenate(self._ids(groups))
        at = np.flatnonzero(self.opens[ids])
        if len(at) != len(plain):
            raise AssertionError("a chunk did not open with a marked piece")
        return ids, np.diff(np.append(at, len(ids)))

    def learn(self, wanted: set[str]) -> None:
        """Encode the chunks not seen yet in multithreaded batches; hold them against the library's ids and their own text."""
        new = [c for c in wanted if c not in self.index]
        if not new:
            return
        if len(self.index) + len(new) > self.limit:
            self.forget()
            new = list(wanted)
        plain = [c for c in new if not c.startswith(MARK)] if self.cuts else []
        odd = [c for c in new if c.startswith(MARK)] if self.cuts else new
        ids, sizes = self._together(plain) if plain else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        if odd:
            self.tokenizer.pre_tokenizer = None
            coded = self._ids([c[1:] for c in odd])
            ids, sizes = np.concatenate([ids, *coded]), np.append(sizes, [len(x) for x in coded])
        ends = np.cumsum(sizes)
        self.index.update(zip(plain + odd, range(len(self.start), len(self.start) + len(new)), strict=True))
        self.good = np.append(self.good, self._checked(plain, odd, ids, ends))
        self.start = np.append(self.start, len(self.pool) + ends - sizes)
        self.length = np.append(self.length, sizes)
        self.pool = np.append(self.pool, ids)

    def _checked(self, plain: list[str], odd: list[str], ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        good = np.ones(len(ends), bool)
        if self.reference is None:
            return good
        n = len(plain)
        if n:
            theirs = np.array([i for k in range(0, n, 32) for i in self.reference.encode(" ".join(plain[k : k + 32]))], np.int32)
            ours = ids[: ends[n - 1]]
            if not np.array_equal(theirs, ours):
                parts = np.split(ours, ends[: n - 1])
                good[:n] = [np.array_equal(a, self.reference.encode(c)) for a, c in zip(parts, plain, strict=True)]
        for k, c in enumerate(odd, n):
            given = c[2:] if self.model.dummy_prefix else c[1:]  # markers stay: the library would squeeze spaces
            good[k] = np.array_equal(ids[ends[k - 1] if k else 0 : ends[k]], self.reference.encode(given)) if given else True
        return good

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids in one array, the number of ids of each text, and whether all its chunks agree with the library."""
        cut = [self.chunks(self.normalise(t)) for t in texts]
        self.learn(set().union(*cut))
        n_chunks = np.array([len(c) for c in cut], np.int64)
        codes = np.fromiter(map(self.index.__getitem__, chain.from_iterable(cut)), np.int64, int(n_chunks.sum()))
        sizes = self.length[codes]
        before = np.cumsum(sizes) - sizes
        ids = self.pool[np.repeat(self.start[codes] - before, sizes) + np.arange(int(sizes.sum()))]
        ends = np.cumsum(n_chunks)
        per_text = np.append(0, np.cumsum(sizes))[np.append(0, ends)]
        bad = np.append(0, np.cumsum(~self.good[codes]))[np.append(0, ends)]
        return ids, np.diff(per_text), np.diff(bad) == 0

    def decode(self, ids) -> str:
        """Text of the ids: byte pieces join into UTF-8, control pieces vanish, the first marker goes where the model adds one or squeezes spaces."""
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if (self.model.dummy_prefix or self.model.squeeze_spaces) and text.startswith(" ") else text


@lru_cache(maxsize=2)
def _codec(data: bytes, threads: int, verify: bool) -> Codec:
    """One codec for all tasks of a Python worker, so that chunks learnt by one task serve the next."""
    return Codec(data, threads, verify=verify)


ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("round_trip", pa.bool_()), ("parity", pa.bool_())])


def pieces_of(batch_texts: list, most_chars: int) -> Iterator[slice]:
    """Slices of a batch holding about most_chars characters each, so that memory stays bounded."""
    start = total = 0
    for k, t in enumerate(batch_texts):
        total += len(t or "")
        if total >= most_chars:
            yield slice(start, k + 1)
            start, total = k + 1, 0
    if start < len(batch_texts):
        yield slice(start, len(batch_texts))


def encode(docs: DataFrame, model: bytes, *, id_col: str = "doc_id", text_col: str = "text", threads: int = 2, verify: bool = True, most_chars: int = 2_000_000) -> DataFrame:
    """One row per input row: doc_id, ids, n_tokens, round_trip (decoding gives the text back), parity.

    round_trip is false where the text itself holds the marker character, which SentencePiece reads as a space.
    No shuffle: the scan is followed by one Arrow map. Memory is bounded by slices of most_chars characters.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # a model file of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shipped.value, threads, verify)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for part in pieces_of(texts, most_chars):
                some = texts[part]
                ids, sizes, same = codec.encode([t or "" for t in some])
                listed = ids.tolist()
                ends = np.cumsum(sizes).tolist()
                back = [None if t is None else codec.decode(listed[e - n : e]) == codec.normalise(t) for t, n, e in zip(some, sizes.tolist(), ends, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(ids, pa.int32()), mask=pa.array([t is None for t in some]))
                yield pa.record_batch(
                    [
                        keys.slice(part.start, part.stop - part.start),
                        lists,
                        pa.array(sizes, pa.int64()),
                        pa.array(back, pa.bool_()),
                        pa.array(same, pa.bool_()),
                    ],
                    schema=ENCODED,
                )

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, round_trip boolean, parity boolean")


def decode(encoded: DataFrame, model: bytes, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of each row of ids; null ids give null text."""
    shipped = encoded.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shipped.value, 1, False)
        for batch in batches:
            texts = [None if ids is None else codec.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], schema=schema)

    chosen = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
    return chosen.mapInArrow(run, "doc_id long, text string")

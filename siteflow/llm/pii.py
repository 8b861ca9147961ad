"""Personal data: patterns propose spans, checksums confirm them, nearby words move their score.

Positions are code points, ends exclusive. Every scan is linear in the text, so very long texts stay cheap: e-mail
addresses grow from each @, dotted numbers are cut in fours, and no pattern can backtrack over more than its match.

Nulls: a null text counts as empty. Ties cannot occur within a kind (matches do not overlap). Equal rows give equal
results; an empty table gives no rows; other columns are ignored, so clashing names do no harm.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteflow.llm.sentencepiece_codec import pieces_of

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+){3,}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
#: Lengths that countries have fixed.
IBAN_LENGTH = {
    c: n
    for n, cs in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in cs.split()
}

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "iban", "national"]
#: Score of a confirmed span before its context, and what a word nearby adds or takes.
START = {"email": 0.8, "ip": 0.5, "card": 0.8, "phone": 0.6, "iban": 0.9, "national": 0.3}
BONUS, MALUS, REACH, LEAST = 0.2, 0.3, 48, 0.5
#: Fixed words that speak for a kind (lower case) and words that speak against personal data.
FOR = {
    "email": {"mail", "email", "e-mail", "contact", "write", "correo", "courriel"},
    "ip": {"ip", "address", "host", "login", "server", "client", "from"},
    "card": {"card", "visa", "mastercard", "credit", "payment", "tarjeta", "carte", "karte"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "telefon", "telefono", "téléphone"},
    "iban": {"iban", "bank", "account", "konto", "compte", "cuenta"},
    "national": {"ssn", "social", "security", "insurance", "taxpayer", "national"},
}
AGAINST = {"version", "isbn", "issn", "order", "article", "section", "invoice", "example"}
NEAR = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) << (k & 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def mod97(code: str) -> bool:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def emails(t: str) -> Iterator[tuple[int, int]]:
    floor, at = 0, t.find("@")
    while at >= 0:
        head = t[floor:at]
        start = floor + len(head.rstrip(LOCAL))
        found = DOMAIN.match(t, at + 1) if start < at else None
        if found:
            yield start, found.end()
        floor = found.end() if found else at + 1
        at = t.find("@", floor)


def addresses(t: str) -> Iterator[tuple[int, int]]:
    for run in DOTTED.finditer(t):
        parts, at = run[0].split("."), run.start()
        for k in range(0, len(parts) - 3, 4):
            end = at + sum(map(len, parts[k : k + 4])) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in parts[k : k + 4]):
                yield at, end
            at = end + 1


def ibans(t: str) -> Iterator[tuple[int, int]]:
    """Of the ends of tokens that the checksum confirms, the country's length wins, else the longest; the search goes on behind."""
    found = IBAN.search(t)
    while found:
        start, best = found.start(), (False, 0)
        for end in range(start + 15, found.end() + 1):
            if t[end - 1] != " " and t[end : end + 1] not in ALNUM:
                code = t[start:end].replace(" ", "")
                if 15 <= len(code) <= 34 and mod97(code):
                    best = max(best, (len(code) == IBAN_LENGTH.get(code[:2]), end))
        if best[1]:
            yield start, best[1]
        found = IBAN.search(t, best[1] or start + 1)


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def proposed(t: str) -> Iterator[tuple[str, int, int]]:
    """Spans that pattern and checksum agree on, by kind and then start."""
    if "@" in t:
        for start, end in emails(t):
            yield "email", start, end
    if not re.search("[0-9]", t):
        return
    for start, end in addresses(t):
        yield "ip", start, end
    for m in CARD.finditer(t):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    if "+" in t:
        for m in PHONE.finditer(t):
            if 8 <= len(_digits(m[0])) <= 15:
                yield "phone", m.start(), m.end()
    for start, end in ibans(t):
        yield "iban", start, end
    if "-" in t:
        for m in NATIONAL.finditer(t):
            yield "national", m.start(), m.end()


def score(t: str, kind: str, start: int, end: int) -> float:
    near = {w.lower() for w in NEAR.findall(t[max(0, start - REACH) : start] + " " + t[end : end + REACH])}
    value = START[kind] + (BONUS if near & FOR[kind] else 0) - (MALUS if near & AGAINST else 0)
    return round(min(1.0, max(0.0, value)), 2)


def scan(text: str | None) -> tuple[list[tuple[str, int, int]], list[float]]:
    """Base spans always; the other kinds where their score in context reaches LEAST and no base span lies over them."""
    t = text or ""
    spans, scores, base = [], [], []
    for kind, start, end in proposed(t):
        value = score(t, kind, start, end)
        if kind in BASE_KINDS:
            base.append((start, end))
        elif value < LEAST or any(a < end and start < b for a, b in base):
            continue
        spans.append((kind, start, end))
        scores.append(value)
    return spans, scores


FOUND = pa.schema(
    [("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("scores", pa.list_(pa.float64()))]
)
DDL = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, scores array<double>"


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts by kind, spans `kind:start:end`, their scores, and a digest of the base spans. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in pieces_of(texts, 4_000_000):
                rows = [scan(t) for t in texts[part]]
                counts = [pa.array([sum(s[0] == k for s in spans) for spans, _ in rows], pa.int64()) for k in KINDS]
                base = [hashlib.sha256(joined(s for s in spans if s[0] in BASE_KINDS).encode()).hexdigest() for spans, _ in rows]
                yield pa.record_batch(
                    [batch.column(0).slice(part.start, part.stop - part.start), *counts, pa.array(base), pa.array([joined(s) for s, _ in rows], pa.string()), pa.array([x for _, x in rows], FOUND.field("scores").type)],
                    schema=FOUND,
                )

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, DDL)


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text with every span replaced by its kind in angle brackets; null text stays null."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def clean(t: str | None) -> str | None:
        if t is None:
            return None
        out, floor = [], 0
        for kind, start, end in sorted(scan(t)[0], key=lambda s: (s[1], -s[2])):
            if start >= floor:
                out += [t[floor:start], f"<{kind}>"]
                floor = end
        return "".join([*out, t[floor:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([clean(t) for t in batch.column(1).to_pylist()], pa.string())], schema=schema)

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, text string")

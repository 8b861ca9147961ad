"""Secrets: three fixed patterns, and a randomness test battery for other long tokens. DataFrame functions only.

A long token of a known encoding (hex, three forms of base32, base36, base64; upper or lower case where one case is
enough) goes through three tests: chi-squared for a uniform alphabet, runs of one kind of symbol (digits, lower,
upper), and serial correlation. The null hypothesis of the report is prose: a name or identifier made of words. Such
tokens repeat letters at least as often as words do and change the kind of symbol at most CHANGE_SHARE as often as random
ones; the p-value is the chance that prose looks as random as the token. A token that clearly is not random (p below GATE
when the three tests are joined the other way round) gets p-value 1. Benjamini-Hochberg within each
length class then bounds the expected share of prose among the tokens that are reported, so short tokens, for which
the tests have little power, are reported only when the evidence suffices. Reported tokens are `random` spans where no base span
lies over them; tokens of letters alone are never candidates.

Positions are code points, ends exclusive. The texts are read once; the false-discovery step reads only a histogram of
p-values (length classes x BINS, whatever the input).

Nulls: a null text counts as empty. Equal rows give equal results. An empty table gives no rows. A text may hold any number of
spans of each kind. Only id and text are read, so clashing names do no harm.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteflow.llm.common import written
from siteflow.llm.quality_rules import once

KINDS = ["assign", "access", "hex"]
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
ALPHABETS = {
    "hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base32hex": "0123456789ABCDEFGHIJKLMNOPQRSTUV", "crockford": "0123456789ABCDEFGHJKMNPQRSTVWXYZ",
    "base36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: Lower ends of the length classes.
CLASSES = [20, 32, 64, 128]
#: Quarters of an octave of the p-value.
BINS = 256
GATE = 0.001
#: Chance that two letters of prose are equal, for all letters and among a to f alone; share of digits in identifiers.
COINCIDENCE, COINCIDENCE_HEX, DIGITS = 0.066, 0.26, 0.3
#: Identifiers change the kind of symbol at most this share as often as random tokens.
CHANGE_SHARE = 0.7
BLOCK = 256


def matches(text: Column, pattern: str, keep=None) -> Column:
    """Array of (start, end, hit) of the leftmost non-overlapping matches that `keep` accepts.

    Matches and the gaps between them, laid end to end, give the places. They are summed in blocks, so that a text with very
    many matches never grows one long array step by step.
    """
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    laid = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, hit: F.struct(F.char_length(gap).alias("gap"), F.char_length(hit).alias("len"), hit.alias("hit")))

    def place(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), (start + x["len"]).alias("end"), x["hit"].alias("hit"))
        return F.struct((start + x["len"]).alias("at"), F.concat(acc["found"], F.array(span)).alias("found"))

    def in_blocks(hits: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / BLOCK).cast("int")), lambda b: F.slice(hits, b * BLOCK + 1, BLOCK))
        length = lambda block: F.aggregate(block, F.lit(0), lambda a, x: a + x["gap"] + x["len"])
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,hits:array<struct<gap:int,len:int,hit:string>>>>").alias("blocks"))
        begun = F.aggregate(blocks, first, lambda acc, b: F.struct((acc["at"] + length(b)).alias("at"), F.concat(acc["blocks"], F.array(F.struct(acc["at"].alias("at"), b.alias("hits")))).alias("blocks")), lambda acc: acc["blocks"])
        return F.flatten(F.transform(begun, lambda b: F.aggregate(b["hits"], F.struct(b["at"].alias("at"), none.alias("found")), place, lambda acc: acc["found"])))

    placed = once(F.filter(laid, lambda x: x["hit"].isNotNull()), in_blocks)
    placed = F.filter(placed, lambda x: keep(x["hit"])) if keep else placed
    return F.when(text.rlike(pattern), placed).otherwise(none)


def _encoding(token: Column) -> Column:
    """Smallest encoding that a token could have: only mixtures of letters and digits are taken, so that words are left out."""
    digits, lower, upper = token.rlike("[0-9]"), token.rlike("[a-z]"), token.rlike("[A-Z]")
    return (
        F.when(digits & (lower | upper) & token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), F.lit("hex"))
        .when(digits & (lower | upper) & token.rlike("^([A-Z2-7]+|[a-z2-7]+)=*$"), F.lit("base32"))
        .when(digits & (lower | upper) & token.rlike("^([0-9A-V]+|[0-9a-v]+)=*$"), F.lit("base32hex"))
        .when(digits & (lower | upper) & token.rlike("^([0-9A-HJKMNP-TV-Z]+|[0-9a-hjkmnp-tv-z]+)=*$"), F.lit("crockford"))
        .when(digits & (lower | upper) & token.rlike("^([0-9A-Z]+|[0-9a-z]+)=*$"), F.lit("base36"))
        .when(digits & lower & upper, F.lit("base64"))
    )


def upper_tail(z: Column) -> Column:
    """Upper tail of the normal distribution, from published bounds, never below the true value."""
    a = F.abs(z)
    density = F.exp(-0.5 * a * a) / math.sqrt(2 * math.pi)
    return F.when(z >= 0, density * 4 / (3 * a + F.sqrt(a * a + 8))).otherwise(1 - density * 2 / (a + F.sqrt(a * a + 4)))


def _prose(name: str) -> tuple[str, int, float, float]:
    """Alphabet, its size, how far identifiers are from uniform (size times the chance of equal symbols, less one), and how often they change kind."""
    alphabet = ALPHABETS[name]
    k = len(alphabet)
    letters = COINCIDENCE_HEX if name == "hex" else COINCIDENCE
    excess = k * ((1 - DIGITS) ** 2 * letters + DIGITS**2 / 10) - 1
    n_kinds = sum(c.isalnum() for c in alphabet)
    kinds = [sum(f(c) for c in alphabet) / n_kinds for f in (str.isdigit, str.islower, str.isupper)]
    return alphabet, k, excess, CHANGE_SHARE * (1 - sum(x * x for x in kinds))


def p_prose(token: Column, encoding: Column) -> Column:
    """Chance that prose in the token's encoding looks as random as the token; 1 for a token that is clearly not random."""
    rows = {n: F.struct(*[F.lit(v).alias(c) for c, v in zip(("a", "k", "excess", "change"), _prose(n), strict=True)]) for n in ALPHABETS}
    of = F.element_at(F.create_map(*[x for n, v in rows.items() for x in (F.lit(n), v)]), encoding)
    plain = F.when(encoding == "hex", F.lower(token)).when(encoding == "base64", F.translate(F.rtrim(token, F.lit("=")), "-_", "+/")).otherwise(F.upper(F.rtrim(token, F.lit("="))))

    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, y: a + y)
    pairs = lambda x, f: F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), f)
    fields = lambda v, names: [v[c].alias(c) for c in names]
    floor = F.lit(1e-300)

    def once_over(v: Column) -> Column:
        x, k = v["x"], v["of"]["k"]
        squares = total(F.transform(F.array_distinct(x), lambda c: F.pow(F.size(F.filter(x, lambda y: y == c)), 2.0)))
        high = total(F.transform(x, lambda y: F.when(2 * y >= k, 1.0).otherwise(0.0)))
        runs = 1 + total(pairs(x, lambda a, b: F.when((2 * a >= k) != (2 * b >= k), 1.0).otherwise(0.0)))
        return F.struct(*fields(v, ["x", "of", "kinds", "steps"]), F.size(x).cast("double").alias("n"), k.cast("double").alias("k"), (total(x) / F.size(x)).alias("mean"), squares.alias("squares"), high.alias("high"), runs.alias("runs"))

    def twice_over(v: Column) -> Column:
        around = total(F.transform(v["x"], lambda y: (y - v["mean"]) * (y - v["mean"])))
        lagged = total(pairs(v["x"], lambda a, b: (a - v["mean"]) * (b - v["mean"])))
        rho = F.when(around > 0, lagged / F.greatest(around, F.lit(1e-9))).otherwise(1.0)
        chi = F.greatest(F.lit(0.0), v["k"] / v["n"] * v["squares"] - v["n"])
        expected = 2 * v["high"] * (v["n"] - v["high"]) / v["n"] + 1
        spread = F.sqrt(F.greatest(F.lit(1e-9), (expected - 1) * (expected - 2) / (v["n"] - 1)))
        z_runs = F.when((v["high"] == 0) | (v["high"] == v["n"]), 9.0).otherwise((v["runs"] - expected) / spread)
        return F.struct(*fields(v, ["of", "kinds", "n", "k"]), F.greatest(F.lit(1.0), v["steps"] - 1.0).alias("steps"), chi.alias("chi"), z_runs.alias("z_runs"), (rho * F.sqrt(v["n"])).alias("z_serial"))

    def chances(v: Column) -> Column:
        root = lambda mean, f: (F.pow(v["chi"] / mean, 1.0 / 3) - (1 - 2 / (9 * f))) / F.sqrt(2 / (9 * f))
        both = lambda z: F.least(F.lit(1.0), 2 * upper_tail(F.abs(z)))
        log = lambda p: F.ln(F.greatest(p, floor))
        df, far, change = v["k"] - 1, v["n"] * v["of"]["excess"], v["of"]["change"]  # far: noncentrality under prose
        p_even = upper_tail(-root(df + far, (df + far) * (df + far) / (df + 2 * far)))
        p_changes = upper_tail((v["kinds"] - 1.5 - change * v["steps"]) / F.sqrt(v["steps"] * change * (1 - change)))
        # Fisher's method. Words' letters are hardly correlated by rank, so correlation speaks only against randomness.
        return F.struct((-log(p_even) - log(p_changes)).alias("prose"), (-log(upper_tail(root(df, df))) - log(both(v["z_runs"])) - log(both(v["z_serial"]))).alias("random"))

    def joined(v: Column) -> Column:
        random = F.exp(-v["random"]) * (1 + v["random"] + v["random"] * v["random"] / 2)
        return F.when(random < GATE, F.lit(1.0)).otherwise(F.exp(-v["prose"]) * (1 + v["prose"]))

    ranks = lambda v: F.filter(F.transform(F.split(v["s"], ""), lambda c: F.instr(v["of"]["a"], c) - 1), lambda y: y >= 0)
    kinds = lambda v: F.regexp_count(v["bare"], F.lit("[0-9]+|[a-z]+|[A-Z]+"))
    bare = F.translate(plain, "+/", "")  # separators join words, so they do not count as a change
    read = once(F.struct(plain.alias("s"), bare.alias("bare"), of.alias("of")), lambda v: F.struct(ranks(v).alias("x"), kinds(v).alias("kinds"), F.char_length(v["bare"]).alias("steps"), v["of"].alias("of")))
    for step in (once_over, twice_over, chances, joined):
        read = once(read, step)
    return read


def _class(length: Column) -> Column:
    out = F.lit(CLASSES[0])
    for low in CLASSES[1:]:
        out = F.when(length >= low, F.lit(low)).otherwise(out)
    return out


def limits(found: DataFrame, q: float) -> dict[int, int]:
    """By length class, the least bin of p-values that Benjamini-Hochberg reports at level q; BINS where it reports none."""
    by = found.select(F.explode("tokens").alias("t")).groupBy(_class(F.col("t.end") - F.col("t.start")).alias("c"), "t.bin").count()
    counts: dict[int, dict[int, int]] = {c: {} for c in CLASSES}
    for r in by.collect():  # at most classes x bins rows
        counts[r["c"]][r["bin"]] = r["count"]
    out = {}
    for c, by_bin in counts.items():
        total, seen, out[c] = sum(by_bin.values()), 0, BINS
        for b in range(BINS - 1, -1, -1):
            seen += by_bin.get(b, 0)
            if seen and 2 ** (-b / 4) <= q * seen / total:
                out[c] = b
    return out


def _kind(n: int):
    """A span as (start, kind, end), which sorts by start and then kind."""
    return lambda x: F.struct(x["start"].alias("start"), F.lit(n).alias("k"), x["end"].alias("end"))


def scan(docs: DataFrame, *, q: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_assign, n_access, n_hex, base_sha256, spans, n_random. q: bound of the expected share of prose among random spans."""
    text = F.col("text")
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    hits = base.select(
        "doc_id",
        matches(text, ASSIGN, lambda hit: F.char_length(F.regexp_extract(hit, ASSIGN, 2)) >= 6).alias("assign"),
        matches(text, ACCESS).alias("access"),
        matches(text, HEX).alias("hex"),
        F.filter(F.transform(matches(text, TOKEN), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["hit"].alias("hit"), _encoding(x["hit"]).alias("encoding"))), lambda x: x["encoding"].isNotNull()).alias("tokens"),
    )
    bin_of = lambda p: F.least(F.lit(BINS - 1), F.floor(-4 * F.log2(F.greatest(p, F.lit(1e-300))))).cast("int")
    tested = F.transform("tokens", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), bin_of(p_prose(x["hit"], x["encoding"])).alias("bin")))
    spans = F.array_sort(F.concat(*[F.transform(k, _kind(n)) for n, k in enumerate(KINDS)]))
    found = written(hits.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], spans.alias("base"), tested.alias("tokens")), "secrets")

    least = F.create_map(*[F.lit(x) for kv in limits(found, q).items() for x in kv])
    reported = lambda t: t["bin"] >= F.element_at(least, _class(t["end"] - t["start"]))
    clear = lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    extra = F.transform(F.filter("tokens", lambda t: reported(t) & clear(t)), _kind(len(KINDS)))
    names = F.array(*[F.lit(k) for k in [*KINDS, "random"]])
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", extra))).alias("spans"),
        F.size(extra).cast("long").alias("n_random"),
    )

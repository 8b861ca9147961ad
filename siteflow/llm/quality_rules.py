"""Quality rules as a bitmask ledger: every rule is evaluated once, policies and ablations only read bits.

All measurements are DataFrame expressions over whole texts; there is no shuffle. Repeated windows are found with
hashes of eight consecutive words; only texts with some repeated window have their positions sorted.

Nulls: a null text counts as empty, has no words and fails the word-count rule. Equal rows get equal results. An
empty table gives no rows. Only the id and text columns are read, so clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteflow.llm.common import WORD, words

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"

#: Bit of each rule in the ledger, in order; adding a rule appends.
RULES = ["few_words", "repeated_windows", "symbols", "duplicate_lines", "mean_word_length", "one_long_word"]
#: Versioned policies: the rules that reject. v1 is the base of the contract; v2 adds the method's own rules.
POLICIES = {"v1": ["few_words", "repeated_windows"], "v2": ["few_words", "repeated_windows", "symbols", "duplicate_lines", "mean_word_length"]}


def mask_of(policy: str) -> int:
    return sum(1 << RULES.index(r) for r in POLICIES[policy])


def window_hashes(ws: Column, window: int = WINDOW) -> Column:
    """Hash of the `window` words from each position on; null where there are too few for two windows."""
    return F.when(F.size(ws) > window, F.transform(F.sequence(F.lit(1), F.size(ws) - (window - 1)), lambda i: F.xxhash64(F.slice(ws, i, window))))


def once(value: Column, then) -> Column:
    """then(value), with value computed a single time: lambdas would compute an outer expression for each element."""
    return F.transform(F.array(value), then)[0]


def words_in_repeats(hashes: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window found at least twice, first occurrence included."""

    def covered(placed: Column) -> Column:
        def twice(x: Column, k: Column) -> Column:
            return F.coalesce(F.get(placed, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(placed, k + 1)["h"] == x["h"], F.lit(False))

        starts = F.array_sort(F.transform(F.filter(placed, twice), lambda x: x["i"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last"))
        step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(window), p - acc["last"])).alias("n"), p.alias("last"))
        return F.aggregate(starts, zero, step, lambda acc: acc["n"])

    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(hashes.isNull() | (F.size(F.array_distinct(hashes)) == F.size(hashes)), F.lit(0)).otherwise(once(placed, covered))


def accepted(docs: DataFrame, *, policy: str = "v2", text_col: str = "text") -> DataFrame:
    """The rows of docs that the policy keeps, with their own columns alone."""
    noted = ledger(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text")), policy=policy, id_col="row")
    # A filter alone would be pushed below the measurements and repeat them; one that needs a row number stays above.
    numbered = noted.select("doc_id", "kept", F.monotonically_increasing_id().alias("at"))
    return numbered.where(F.col("kept") & (F.col("at") >= 0)).select("doc_id.*")


def ledger(docs: DataFrame, *, policy: str = "v2", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, measurements, failure_bits, base_failed, kept. kept applies `policy` to the bits."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    cut = base.select("doc_id", "text", words(F.col("text")).alias("ws"), F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)).alias("lines"))
    cut = cut.withColumn("hashes", window_hashes(F.col("ws")))
    measured = cut.select(
        "doc_id",
        F.size("ws").cast("long").alias("n_words"),
        F.char_length(F.array_join("ws", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        words_in_repeats(F.col("hashes")).cast("long").alias("n_repeat_words"),
    )
    n = F.col("n_words")
    fails = {
        "few_words": n < 20,
        "repeated_windows": 100 * F.col("n_repeat_words") > 30 * n,
        "symbols": 10 * F.col("n_symbols") > 2 * n,
        "duplicate_lines": (F.col("n_lines") >= 4) & (2 * F.col("n_dup_lines") > F.col("n_lines")),
        "mean_word_length": (n > 0) & ((F.col("word_chars") > 20 * n) | (F.col("word_chars") < 2 * n)),
        "one_long_word": (n > 0) & (n < 5) & (F.col("word_chars") > 1000),
    }
    bits = F.lit(0)
    for k, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(fails[rule], F.lit(1 << k)).otherwise(F.lit(0)))
    noted = measured.withColumn("failure_bits", bits)
    return noted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "failure_bits",
        rejected("v1").alias("base_failed"), (~rejected("v1") & ~rejected(policy)).alias("kept"),
    )


def rejected(policy: str) -> Column:
    return F.col("failure_bits").bitwiseAND(F.lit(mask_of(policy))) != 0


def ablations(noted: DataFrame, policy: str = "v2") -> DataFrame:
    """For each rule of a policy: rows that fail it, rows that only it rejects, rows that any rule rejects.

    The ledger is first counted by bitmask (at most 2 ** rules rows), so the sums never read the texts again.
    """
    mask = mask_of(policy)
    by_bits = noted.groupBy("failure_bits").count()
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).alias("bit")) for r in POLICIES[policy]])).alias("r")
    hit = F.col("failure_bits").bitwiseAND(F.lit(mask))
    total = lambda cond: F.sum(F.when(cond, F.col("count")).otherwise(F.lit(0))).alias
    return (
        by_bits.select("count", "failure_bits", hit.alias("hit"), rules)
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(total(F.col("hit").bitwiseAND(F.col("r.bit")) != 0)("n_failed"), total(F.col("hit") == F.col("r.bit"))("n_only"), total(F.col("hit") != 0)("n_rejected"))
    )

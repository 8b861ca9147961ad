"""Line deduplication by winnowing over line hashes. DataFrame functions only.

A window is the shortest row of consecutive lines with at least min_words words. The smallest line hash of each window
is its fingerprint (the last one on ties), so any run of that many words that stands in two places gives both places the
same fingerprint at the same line. Only these selected positions are joined: every later position of a fingerprint meets the first one, and
the match is extended line by line to the left and to the right as long as the lines are equal. With min_words words or more
it is deleted. Runs around a later position that the match does not contain differ from the first place; they meet
further places in the order of documents, among positions of the same fingerprint with the same run. A line goes if it lies in a
run of at least min_words words that also stands in an earlier place (by doc_id, then line).

Lines are compared without white space at their ends, by two 64-bit hashes with different seeds, runs by two hashes of those: at 1e12
lines the chance of any wrong match is about 1e-14. Blank lines take no part and stay. Every deleted line has an
earlier copy, so the first copy of any line always stays. No pairs are built: a position meets one place, a run one more. Keys
with more than HOT_SHARE of all rows (so fewer than 1 / HOT_SHARE keys) are joined by broadcast and never gather in a task.
Shuffles carry hashes, not texts, until the marked lines are joined back.

Nulls: a null text stays null; a null doc_id comes first. Rows with the same doc_id and text count as one document and
get the same result. Empty texts stay. Empty tables give no rows. `dedup` returns every other input column as it was; input columns
named like its own three (n_lines, n_removed, removed_places) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteflow.llm.common import SPACES, discard, words, written
from siteflow.llm.quality_rules import once

LEAST = -(2**63)
MIN_WORDS = 50
HOT_SHARE = 1e-3
OWN = ["n_lines", "n_removed", "removed_places"]


def _keys(text: Column, doc_id: str) -> list[Column]:
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(LEAST)).alias("d"), F.xxhash64(text).alias("v")]


def line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """d, v (document key) and lines: (h and g, two hashes; n, words; i, place) of every line that is not blank."""
    text = F.col(text_col).cast("string")
    cut = F.transform(F.split(text, "\n"), lambda x, i: F.struct(F.btrim(x, F.lit(SPACES)).alias("x"), i.alias("i")))
    lines = F.transform(F.filter(cut, lambda x: x["x"] != ""), lambda x: F.struct(F.xxhash64(x["x"]).alias("h"), F.xxhash64(F.lit("g"), x["x"]).alias("g"), F.size(words(x["x"])).alias("n"), x["i"].alias("i")))
    return docs.where(text.isNotNull()).select(*_keys(text, id_col), lines.alias("lines")).where(F.size("lines") > 0)


def postings(lines: DataFrame, min_words: int) -> DataFrame:
    """d, v, fp, at (line of the fingerprint), off (its place in near), near (the lines around it) and windows (s, end, stop).

    Windows that selected the position, counted from the first line of near: their first line, the end of the window, and the end of the
    longest run from s that no later window contains.
    """
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("len"), F.lit(2**63 - 1).alias("fp"), F.lit(0).alias("at"))

    def step(acc: Column, x: Column) -> Column:
        lower = x["h"] <= acc["fp"]
        more = F.struct((acc["n"] + x["n"]).alias("n"), (acc["len"] + 1).alias("len"), F.when(lower, x["h"]).otherwise(acc["fp"]).alias("fp"), F.when(lower, acc["len"]).otherwise(acc["at"]).alias("at"))
        return F.when(acc["n"] >= min_words, acc).otherwise(more)

    # A line that is not blank has a word, so min_words lines always suffice. Windows start at lines 0, 1, ... without a gap.
    begun = F.transform("lines", lambda x, s: F.struct(s.alias("s"), F.when(x["n"] >= min_words, step(start, x)).otherwise(F.aggregate(F.slice("lines", s + 1, min_words), start, step)).alias("w")))
    placed = F.transform(F.filter(begun, lambda x: x["w"]["n"] >= min_words), lambda x: F.struct(x["s"].alias("s"), (x["s"] + x["w"]["len"]).alias("end"), x["w"]["fp"].alias("fp"), (x["s"] + x["w"]["at"]).alias("at")))

    def with_stops(ws: Column) -> Column:
        """The next window takes over at its last line; the last window's runs go on to the text's end."""
        return F.transform(ws, lambda w, k: F.struct(w["s"].alias("s"), w["end"].alias("end"), F.greatest(w["end"], F.coalesce(F.get(ws, k + 1)["end"] - 1, F.size("lines"))).alias("stop"), w["fp"].alias("fp"), w["at"].alias("at")))

    def selected(ws: Column) -> Column:
        """Windows in a row that have one position between them become one posting."""
        firsts = F.filter(F.transform(ws, lambda w, k: F.when(F.coalesce(F.get(ws, k - 1)["at"] == w["at"], F.lit(False)), F.lit(None).cast("int")).otherwise(k)), lambda k: k.isNotNull())

        def posting(k: Column, last: Column) -> Column:
            low, stop = F.get(ws, k)["s"], F.get(ws, last)["stop"]
            spans = F.transform(F.slice(ws, k + 1, last - k + 1), lambda w: F.struct((w["s"] - low).alias("s"), (w["end"] - low).alias("end"), (w["stop"] - low).alias("stop")))
            return F.struct(F.get(ws, k)["fp"].alias("fp"), F.get(ws, k)["at"].alias("at"), (F.get(ws, k)["at"] - low).alias("off"), F.slice("lines", low + 1, stop - low).alias("near"), spans.alias("windows"))

        return once(firsts, lambda ks: F.transform(ks, lambda k, j: posting(k, F.coalesce(F.get(ks, j + 1) - 1, F.size(ws) - 1))))

    each = once(once(placed, with_stops), selected)
    return lines.select("d", "v", F.explode(each).alias("p")).select("d", "v", "p.*")


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], rows: int, how: str) -> DataFrame:
    """left joined with right, which has one row a key and its number n of left rows; keys with over HOT_SHARE of the rows are broadcast."""
    often = F.col("n") > F.lit(HOT_SHARE * rows)
    hot = F.broadcast(right.where(often).drop("n"))  # fewer than 1 / HOT_SHARE keys
    rest = left.join(hot.select(keys), keys, "left_anti").join(right.where(~often).drop("n"), keys, how)
    return left.join(hot, keys, how).unionByName(rest)


def extended(met: DataFrame, min_words: int) -> DataFrame:
    """d, v, fp, from, to (the match's places, null if it is too short) and others: the runs around the position that it does not contain.

    met: postings with first_off and first_near of their fingerprint's first place.
    """

    def equal(k: Column) -> Column:
        a, b = F.get("near", F.col("off") + k), F.get("first_near", F.col("first_off") + k)
        return F.coalesce((a["h"] == b["h"]) & (a["g"] == b["g"]), F.lit(False))

    right = F.filter(F.sequence(F.lit(0), F.size("near") - F.col("off")), lambda k: ~equal(k))[0]
    left = F.filter(F.sequence(F.lit(1), F.col("off") + 1), lambda k: ~equal(-k))[0] - 1
    spans = met.withColumn("low", F.col("off") - left).withColumn("high", F.col("off") + right)  # lines low to high - 1 are equal
    total = F.aggregate(F.slice("near", F.col("low") + 1, F.greatest(F.lit(0), F.col("high") - F.col("low"))), F.lit(0), lambda acc, x: acc + x["n"])
    hits = spans.withColumn("hit", (right > 0) & (total >= min_words))

    def runs(w: Column) -> Column:
        """The window's run and the longer ones, of which those that the match contains are left out."""
        start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("g"), F.lit(0).alias("k"), F.array().cast("array<struct<from:int,to:int,h:bigint,g:bigint>>").alias("runs"))

        def longer(acc: Column, x: Column) -> Column:
            h, g, end = F.xxhash64(acc["h"], x["h"]), F.xxhash64(acc["g"], x["g"]), w["s"] + acc["k"] + 1
            known = F.col("hit") & (F.col("low") <= w["s"]) & (end <= F.col("high"))
            run = F.struct(F.get("near", w["s"])["i"].alias("from"), x["i"].alias("to"), h.alias("h"), g.alias("g"))
            return F.struct(h.alias("h"), g.alias("g"), (acc["k"] + 1).alias("k"), F.when((end < w["end"]) | known, acc["runs"]).otherwise(F.concat(acc["runs"], F.array(run))).alias("runs"))

        inside = F.col("hit") & (F.col("low") <= w["s"]) & (w["stop"] <= F.col("high"))
        return F.when(inside, start["runs"]).otherwise(F.aggregate(F.slice("near", w["s"] + 1, w["stop"] - w["s"]), start, longer, lambda acc: acc["runs"]))

    place = lambda k: F.when(F.col("hit"), F.get("near", k)["i"])
    return hits.select("d", "v", "fp", place(F.col("low")).alias("from"), place(F.col("high") - 1).alias("to"), F.flatten(F.transform("windows", runs)).alias("others"))


def repeated_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """d, v and runs: disjoint (from, to) of the places to delete, in order, one row per document with any."""
    found = written(postings(lines, min_words), "postings")
    place = F.struct("d", "v", "at")
    shared = written(found.groupBy("fp").agg(F.min(place).alias("a"), F.max(place).alias("z"), F.count("*").alias("n")).where("a <> z").select("fp", "n", "a", F.col("n").alias("times")), "shared")
    hopeful = written(spread_join(found, shared, ["fp"], found.count(), "inner"), "hopeful")
    first = hopeful.where(place == F.col("a")).select("fp", F.col("times").alias("n"), F.col("off").alias("first_off"), F.col("near").alias("first_near")).dropDuplicates(["fp"])
    met = spread_join(hopeful.where(place != F.col("a")).drop("a", "times"), first, ["fp"], hopeful.count(), "inner")
    matched = written(extended(met, min_words), "matched")
    discard(found, shared, hopeful)

    # What differs from the first place, among itself.
    run = matched.select("d", "v", "fp", F.explode("others").alias("r")).select("d", "v", "fp", "r.*")
    spot, keys = F.struct("d", "v", "from"), ["fp", "h", "g"]
    again = written(run.groupBy(keys).agg(F.min(spot).alias("first"), F.max(spot).alias("last"), F.count("*").alias("n")).where("first <> last").drop("last"), "again")
    later = spread_join(run, again, keys, run.count(), "inner").where(spot != F.col("first")).select("d", "v", "from", "to")
    gone = matched.where("from IS NOT NULL").select("d", "v", "from", "to").unionByName(later)

    # Overlapping or touching runs of a document are one.
    line = Window.partitionBy("d", "v").orderBy("from", "to")
    reach = F.max("to").over(line.rowsBetween(Window.unboundedPreceding, -1))
    return (
        gone.withColumn("new", F.when(F.coalesce(F.col("from") <= reach + 1, F.lit(False)), 0).otherwise(1))
        .withColumn("island", F.sum("new").over(line))
        .groupBy("d", "v", "island").agg(F.min("from").alias("from"), F.max("to").alias("to"))
        .groupBy("d", "v").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("runs"))
    )


def dedup(docs: DataFrame, *, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated lines taken out of the text, and n_lines, n_removed, removed_places added."""
    lines = written(line_table(docs, id_col, text_col), "lines")
    marked = repeated_runs(lines, min_words)
    text = F.col(text_col).cast("string")
    named = docs.select(*_keys(text, id_col), text.alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], F.lit(0)).alias("row"))
    cut = named.join(marked, ["d", "v"], "left").select("row", "text", "runs", F.split("text", "\n").alias("cut"))
    blank = lambda x: F.btrim(x, F.lit(SPACES)) == ""

    def rest(ls: Column) -> Column:
        """Lines between runs, and the blank lines inside; one step of the text for each run."""
        end = F.array(F.struct(F.size(ls).alias("from"), F.size(ls).alias("to")))
        between = lambda r, k: F.coalesce(F.get("runs", k - 1)["to"] + 1, F.lit(0))
        piece = lambda r, k: F.concat(F.slice(ls, between(r, k) + 1, r["from"] - between(r, k)), F.filter(F.slice(ls, r["from"] + 1, r["to"] - r["from"] + 1), blank))
        return F.flatten(F.transform(F.concat("runs", end), piece))

    gone = F.flatten(F.transform("runs", lambda r: F.filter(F.sequence(r["from"], r["to"]), lambda i: ~blank(F.get("cut", i)))))
    done = cut.select("row", "text", "runs", F.when(F.col("text").isNull(), 0).otherwise(F.size("cut")).cast("long").alias("n_lines"), F.when(F.col("runs").isNull(), F.array().cast("array<int>")).otherwise(gone).alias("removed_places"), F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join(once(F.col("cut"), rest), "\n")).alias("kept"))
    others = [F.col("kept").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns if c not in OWN]
    return done.select(*others, "n_lines", F.size("removed_places").cast("long").alias("n_removed"), "removed_places")

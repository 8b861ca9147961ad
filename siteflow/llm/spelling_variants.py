"""Spelling variants of the vocabulary by a dictionary of pairs of trie nodes.

The words' prefixes are the nodes of a trie and their suffixes those of the trie of the reversed words; both are numbered. A
word of L code points lies at L + 1 pairs (prefix node i, node of the suffix behind position i) and, one code point skipped, at L pairs
(prefix node i, node of the suffix behind i + 1). Words that meet at an integer pair are exactly one replaced (both skip) or one inserted
code point (one skips) apart, and all such words meet; no candidate has to be checked, nothing hashed.

Numbering reads each sorted range of words once, like the stack of a depth-first walk: a word makes new nodes from the first code point
in which it differs from the word before. Only the path to a range's first word may have been numbered in an earlier range
too; the last path of every range (a word and its numbers) goes to the driver, which names those nodes anew. Work is linear in
the letters, also for words of any length. At a pair meet at most the alphabet's size plus one words (one may be whole, and
the others differ in one place), so groups are bounded.

Nulls: a null text has no words; a null doc_id is spelled as nothing. Empty tables have no words. Repeated rows count again.
Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteflow.llm.common import discard, lower_ascii, written

#: Code points of a word (A-Z are lower-cased, others stay) and how it is drawn from a text.
LETTERS = "A-Za-zÀ-ÿ"
LEAST_LETTERS, LEAST_COUNT, FORM_FACTOR, TYPO_EVERY = 6, 5, 5, 199
#: Numbers of a range's words and nodes have so many bits below the range's own.
SHIFT = 40
#: Counts grow by FORM_FACTOR from form to form, so 64-bit counts allow chains of 27 at most, which 5 doublings reach.
MOST_ROUNDS = 6


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word: one row an occurrence of at least LEAST_LETTERS code points, some with one deleted as a hash of doc_id and run decides.

    Shorter runs cannot become words, so the pattern leaves them out.
    """
    runs = F.regexp_extract_all(lower_ascii(F.col(text_col).cast("string")), F.lit(f"[{LETTERS}]{{{LEAST_LETTERS},}}"), F.lit(0))
    each = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("d"), F.explode(runs).alias("run"))
    hashed = each.select("run", F.crc32(F.concat("d", F.lit(":"), "run")).alias("h"))
    at = F.expr("cast(h % char_length(run) as int)")
    typo = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return hashed.select(F.when(F.col("h") % TYPO_EVERY == 0, typo).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n."""
    counted = occurrences(docs, id_col, text_col).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where((F.col("n") >= LEAST_COUNT) & (F.char_length("word") >= LEAST_LETTERS))


def shared(a: str, b: str) -> int:
    """Length of the common prefix, by halving over slices."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one sorted range of words (columns w, word): w (given, or the place in the order) and path, the numbers of the nodes from the root to the word.

    One more row ends the range: word and path of its last word, first of its first word, w null.
    """
    schema = pa.schema([("w", pa.int64()), ("word", pa.string()), ("first", pa.string()), ("path", pa.list_(pa.int64()))])
    base = TaskContext.get().partitionId() << SHIFT
    stack, last, first, rank, fresh = [], None, None, 0, 0
    for batch in batches:
        ws, words = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out_w, paths = [], []
        for w, word in zip(ws, words, strict=True):
            keep = 0 if last is None else shared(last, word) + 1
            first = word if last is None else first
            del stack[keep:]
            more = len(word) + 1 - keep
            stack += range(base + fresh, base + fresh + more)
            fresh, last = fresh + more, word
            out_w.append(base + rank if w is None else w)
            paths.append(stack.copy())
            rank += 1
        yield pa.record_batch([pa.array(out_w, pa.int64()), batch.column(1), pa.nulls(len(words), pa.string()), pa.array(paths, schema.field("path").type)], schema=schema)
    if last is not None:
        yield pa.record_batch([pa.array([None], pa.int64()), pa.array([last]), pa.array([first]), pa.array([stack], schema.field("path").type)], schema=schema)


def numbered(words: DataFrame, parts: int) -> tuple[DataFrame, dict[int, int]]:
    """w, word, path of every row of words (w, word), and what the numbers of nodes met in an earlier range become: at most a path a range."""
    ranges = words.select("w", "word").repartitionByRange(parts, "word").sortWithinPartitions("word")
    found = written(ranges.mapInArrow(number, "w long, word string, first string, path array<long>"), "numbered")
    again: dict[int, int] = {}
    last, end = None, []
    for r in sorted(found.where("w IS NULL").select("first", "word", "path").collect(), key=lambda r: r["path"][0]):
        base, same = r["path"][0], 0
        if last is not None:
            same = shared(last, r["first"]) + 1
            again |= {base + k: end[k] for k in range(same)}
        last, end = r["word"], [again.get(k, k) for k in r["path"]]
    return found.where("w IS NOT NULL").select("w", "word", "path"), again


def pairs(words: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """w, word in code-point order of w; and w, a, b: the pairs of nodes where each word lies, whole and with one code point skipped."""
    forward, again_a = numbered(words.select(F.lit(None).cast("long").alias("w"), "word"), parts)
    backward, again_b = numbered(forward.select("w", F.reverse("word").alias("word")), parts)
    both = forward.join(backward.select("w", F.reverse("path").alias("back")), "w")
    whole = F.arrays_zip(F.col("path").alias("a"), F.col("back").alias("b"))
    n = F.size("path") - 1
    skip = F.arrays_zip(F.slice("path", 1, n).alias("a"), F.slice("back", 2, n).alias("b"))
    rows = both.select("w", F.explode(F.concat(whole, skip)).alias("p")).select("w", F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    for c, again in (("a", again_a), ("b", again_b)):
        if again:  # a path a range at most, which the driver has held already
            names = F.broadcast(words.sparkSession.createDataFrame(list(again.items()), f"{c} long, now long"))
            rows = rows.join(names, c, "left").withColumn(c, F.coalesce("now", c)).drop("now")
    return forward.select("w", "word"), rows


def near(rows: DataFrame) -> DataFrame:
    """w, v: words at one pair, each pair of words once in both directions."""
    met = rows.groupBy("a", "b").agg(F.collect_set("w").alias("ws")).where(F.size("ws") > 1)
    return met.select(F.explode("ws").alias("w"), "ws").select("w", F.explode("ws").alias("v")).where("w <> v")


def group(words: DataFrame, *, parts: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n of a vocabulary (word, n)."""
    spark = words.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = written(words.select("word", "n"), "words")
    names, rows = pairs(words, parts)
    named = written(names.join(words, "word"), "named")  # w, word, n
    counts = named.select(F.col("w").alias("v"), F.col("n").alias("n_v"))
    # One exchange by w serves both groupings.
    linked = near(rows).join(counts, "v").repartition("w").groupBy("w", "v").agg(F.first("n_v").alias("n_v"))
    best = linked.groupBy("w").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_v")).alias("less"), "v")).alias("best"))
    judged = written(named.join(best, "w", "left").select("w", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.less") >= FORM_FACTOR * F.col("n"), F.col("best.v")).alias("f"), (-F.col("best.less")).alias("n_f")), "judged")
    discard(words, named)
    up = written(judged.where("f IS NOT NULL").select("w", F.col("f").alias("root")), "up")
    for _ in range(MOST_ROUNDS):
        step = up.join(up.select(F.col("w").alias("root"), F.col("root").alias("far")), "root", "left").select("w", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved"))
        new = written(step, "up")
        discard(up)
        up, moved = new.select("w", "root"), not new.where("moved").isEmpty()
        up._folder = new._folder
        if not moved:
            break
    spelled = judged.select(F.col("w").alias("x"), F.col("word").alias("spelling"))
    return (
        judged.join(up, "w", "left")
        .join(spelled.select(F.col("x").alias("f"), F.col("spelling").alias("form")), "f", "left")
        .join(spelled.select(F.col("x").alias("root"), F.col("spelling").alias("root_word")), "root", "left")
        .select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", F.when(F.col("f").isNotNull(), F.col("n_f")).alias("form_n"))
    )


def variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The vocabulary of the texts with its variants grouped."""
    return group(vocabulary(docs, id_col, text_col))

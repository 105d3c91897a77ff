"""Quality rules by importance of hashed n-grams, in DataFrame functions only (operator 2).

Words and neighbouring word pairs are hashed to ``BUCKETS`` buckets.  Their counts over a trusted target and over the whole
raw corpus, smoothed, are two multinomials; a document's score is the mean over its n-grams of the logarithm of the two
probabilities' ratio.  A document is kept if it passes the base rules and scores at least ``THRESHOLD``: the rule is a
fixed one, so the verdict on a text depends on nothing but the text and the two multinomials.

One pass counts all n-grams (the partial counts of a task are at most one per bucket); the table of bucket weights, whose
size is fixed by ``BUCKETS``, reaches the second pass as a literal with all digits (subqueries aren't allowed in array
functions).

Cases: null or empty texts have no words and fail the base rules; an empty target gives every bucket the same ratio;
repeated rows count as often as they occur, and a score equal to the threshold is kept; a null id is never trusted; an empty
table gives no rows; other columns pass through ``score``, whose own replace columns of the same names.  A very long text
takes some 100 bytes a word.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.llm.common import cleared, table

BUCKETS = 1 << 14
SMOOTHING = 0.5
THRESHOLD = -0.05
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"


def words(text: str | Column) -> Column:
    """The words of a text: runs of characters other than blank, tab, LF, VT, FF and CR."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), "\t\n\v\f\r", " " * 5), " ", -1), "")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once per row, however often an array function's body names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def repeated_words(w: Column) -> Column:
    """Words covered by three-word windows that occur twice or more in the text."""

    def covered(placed: Column) -> Column:
        # windows beside their places, sorted: equal ones are neighbours
        same = lambda i, j: F.coalesce(F.get(placed, j)["s"] == F.get(placed, i)["s"], F.lit(False))
        twice = F.filter(F.transform(placed, lambda x, i: F.when(same(i, i - 1) | same(i, i + 1), x["i"])), lambda x: x.isNotNull())
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"))
        return F.aggregate(F.sort_array(twice), start, step)["n"]

    def over(w: Column, named: Column) -> Column:
        # windows with different hashes differ, so most texts need no strings
        three = lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        places = F.filter(named, lambda x: x["again"])
        return F.when(F.size(places) == 0, F.lit(0)).otherwise(let(F.sort_array(F.transform(places, lambda x: F.struct(three(x["i"]).alias("s"), x["i"].alias("i")))), covered))

    def marked(h: Column) -> Column:
        # places of windows whose hash is found twice: equal ones are neighbours
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda p, i, j: F.coalesce(F.get(p, j)["h"] == F.get(p, i)["h"], F.lit(False))
        twice = lambda p: F.transform(p, lambda x, i: F.struct(x["i"].alias("i"), (same(p, i, i - 1) | same(p, i, i + 1)).alias("again")))
        none = F.array().cast("array<struct<i:int,again:boolean>>")
        return F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(let(placed, twice))

    def windows(w: Column) -> Column:
        hashed = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(let(hashed, marked), lambda named: over(w, named)))

    return let(w, windows)


def base_columns(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    return _based(df, text).drop(WORDS)


#: The column of a text's words, which are split once.
WORDS = "__words"


def _based(df: DataFrame, text: str) -> DataFrame:
    """df with the base columns and ``WORDS``."""
    t, w = F.coalesce(F.col(text), F.lit("")), F.col(WORDS)
    full = lambda x: F.filter(x, lambda y: F.length(F.translate(y, " \t\n\v\f\r", "")) > 0)
    repeated = lambda x: F.size(x) - F.size(F.array_distinct(x))
    out = df.withColumn(WORDS, words(F.col(text))).withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(F.split(t, "\n", -1), lambda x: F.when(repeated(x) == 0, F.lit(0)).otherwise(let(full(x), repeated))).cast("long"),
        "n_repeat_words": repeated_words(w).cast("long"),
    })
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def grams(w: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of a text's words and word pairs."""
    bucket = lambda *x: F.pmod(F.xxhash64(*x), F.lit(buckets)).cast("int")
    single = lambda w: F.transform(w, lambda x: bucket(x))
    pairs = lambda w: F.when(F.size(w) < 2, _empty("int")).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: bucket(F.get(w, i), F.get(w, i + 1))))
    return let(w, lambda w: F.concat(single(w), pairs(w)))


def weights(df: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id", buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """One row, column ``w``: the log ratio of each bucket.  ``trusted`` has ids, of any number."""
    ids = trusted.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_t", F.lit(1))
    marked = df.select(key, text).join(ids.hint("merge"), key, "left")  # as on large tables, whatever the size
    each = marked.select("_t", F.explode(grams(words(F.col(text)), buckets)).alias("b"))
    counts = each.groupBy("b").agg(F.count("*").alias("r"), F.count("_t").alias("t"))
    spark = df.sparkSession
    every = spark.range(buckets).select(F.col("id").cast("int").alias("b"), F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("t"))
    full = counts.union(every).groupBy("b").agg(F.sum("r").alias("r"), F.sum("t").alias("t"))
    one = full.agg(F.sum("r").alias("nr"), F.sum("t").alias("nt"), F.sort_array(F.collect_list(F.struct("b", "r", "t"))).alias("all"))
    share = lambda n, total: (n + smoothing) / (total + smoothing * buckets)
    return one.select(F.transform("all", lambda x: F.log(share(x["t"], F.col("nt"))) - F.log(share(x["r"], F.col("nr")))).alias("w"))


def score(df: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """df with the base columns, ``llr`` (mean log ratio, null without words) and ``kept``."""
    df = cleared(df, ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"), text, key)
    ratios = weights(df, trusted, text, key).first()["w"]
    w = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")  # folded to one literal
    based = _based(df, text)
    total = F.aggregate(grams(F.col(WORDS)), F.lit(0.0), lambda a, b: a + F.get(w, b))
    out = based.withColumn("llr", F.when(F.col("n_words") > 0, F.round(total / (2 * F.col("n_words") - 1), 9)))
    return out.drop(WORDS).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("llr") >= threshold, F.lit(False)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    out = score(table(spark, sf_dir, "documents").select("doc_id", "text"), trusted)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")

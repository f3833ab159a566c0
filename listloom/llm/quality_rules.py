"""Quality rules with a hashed n-gram log-likelihood ratio, DataFrame functions only.

Base rules count what a text is made of: words, code points in words, marks, repeated lines, and words in windows of
``WINDOW`` words that occur twice or more. The method's verdict is a ratio of two multinomials over hashed n-grams (runs
of 1 and 2 words in lower case, bucket by CRC-32): trusted target against raw corpus, both smoothed by one. A document's
score is the floored mean over its n-grams of ``floor(1000 ln(P_target / P_raw))``, so it does not depend on its length.

The corpus side counts every document. The target side counts every trusted document: those with a label of high quality
and none of toxicity. Half of them, by a hash of the id, are counted; the other half, whose scores owe nothing to their own
words, fixes the threshold: as far below their median as ``SPREAD`` times the distance from the median to their 5th
percentile. All figures are whole numbers, so the verdict on a document depends on the tables alone and not on the order or
place in which they are read.

Every step works inside rows or on sums over buckets: the texts are read once and never shuffled. Trusted ids are broadcast
up to ``MOST_BROADCAST``; of more, the buckets of documents that the hash lets count meet them in a shuffle. The gains are
an array of ``BUCKETS`` numbers inside the plan. Repeated windows are found by 64-bit hashes within one text.

Defined cases: null text has no words (fails the base rules, score 0); with no trusted document there is no threshold,
and the base rules decide alone; rows that repeat give a row each; documents of a null id are never trusted; a text of
any length is read whole; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stage, text_of

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
BUCKETS = 1 << 14
#: Where the SQL ends its list of trusted documents; the query has no such end.
TRUSTED = 50_000
MOST_BROADCAST = 500_000
SPREAD = 3
NO_WORD = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"


def _words(text: Column) -> Column:
    """Words of a text; none gives an empty array. Blanks at the ends go first, so that no piece is empty."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, NO_WORD))


def _with_repeated_words(rows: DataFrame, window: int) -> DataFrame:
    """``rows(words)`` with ``n_repeat_words``: words that lie in a run of ``window`` words which occurs twice or more.

    Runs are hashed; most texts repeat none, which is told without sorting. Otherwise they are sorted by hash and place; a
    run beside one of the same hash is repeated. Of the repeated ones in order of place, each adds the words up to the
    next one's begin, ``window`` at most. Each array is a column, so that it is made once.
    """
    width = F.lit(window)
    rows = rows.withColumn("runs", F.transform("words", lambda w: F.xxhash64(w)))
    now = 1
    while now < window:  # hashes of two neighbouring runs make those of twice their length, or of what is left
        onward = min(now, window - now)
        n = F.greatest(F.lit(0), F.size("runs") - onward)
        longer = F.zip_with(F.slice("runs", F.lit(1), n), F.slice("runs", F.lit(onward + 1), n), lambda a, b: F.xxhash64(a, b))
        # Texts that repeat no shorter run repeat no longer one; single words tell too little to ask.
        again = F.size(F.array_distinct("runs")) < F.size("runs")
        longer = longer if now < 4 else F.when(again, longer).otherwise(F.array().cast("array<bigint>"))
        rows, now = rows.withColumn("runs", longer), now + onward
    placed = F.array_sort(F.transform("runs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("placed", F.when(F.size(F.array_distinct("runs")) < F.size("runs"), placed)).drop("runs")
    n = F.size("placed")

    def beside(z: Column) -> Column:
        return (z["low"]["h"] == z["x"]["h"]) | (z["x"]["h"] == z["high"]["h"])

    nothing = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    zipped = F.arrays_zip(
        F.concat(nothing, F.slice("placed", F.lit(1), n - 1)).alias("low"),
        F.col("placed").alias("x"),
        F.concat(F.slice("placed", F.lit(2), n), nothing).alias("high"),
    )
    again = F.transform(F.filter(zipped, lambda z: F.coalesce(beside(z), F.lit(False))), lambda z: z["x"]["i"])
    rows = rows.withColumn("again", F.when(F.col("placed").isNotNull(), F.array_sort(again))).drop("placed")
    covered = F.aggregate(
        "again",
        F.struct(F.lit(0).cast("long").alias("words"), F.lit(-window).alias("last")),
        lambda s, i: F.struct((s["words"] + F.least(width, i - s["last"])).alias("words"), i.alias("last")),
        lambda s: s["words"],
    )
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("again")


def base_figures(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """``rows(text)`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    made = _with_repeated_words(rows.withColumn("words", _words(F.col("text"))).withColumn("lines", lines), window)
    return made.select(
        *rows.columns,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
    )


def with_grams(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``rows(text)`` with ``grams``: buckets of the runs of one and two words, in lower case; repeats count."""
    rows = rows.withColumn("low", _words(ascii_lower(F.col("text"))))
    n = F.size("low")
    code = lambda g: F.pmod(F.crc32(g), F.lit(buckets)).cast("int")
    pairs = F.zip_with(
        F.slice("low", F.lit(1), F.greatest(F.lit(0), n - 1)), F.slice("low", F.lit(2), n), lambda a, b: code(F.concat(a, F.lit(" "), b))
    )
    return rows.withColumn("grams", F.concat(F.transform("low", code), pairs)).drop("low")


def _counted(doc_id: Column) -> Column:
    """Whether a trusted document is counted; the others fix the threshold."""
    return F.crc32(doc_id.cast("string")) % 2 == 0


def trusted_ids(labels: DataFrame, most: int | None = None) -> DataFrame:
    """(trusted_id, fits) of all trusted documents: labelled good and not toxic in every row of theirs; ``fits`` parts
    those to be counted from those that fix the threshold. With ``most``, only so many, the smallest by a hash of the id."""
    good = (
        labels.filter("doc_id is not null").groupBy("doc_id")
        .agg(F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"), F.count("quality").alias("q"), F.count("toxic").alias("t"), F.count(F.lit(1)).alias("n"))
        .filter("good and q = n and t = n")
    )
    if most is not None:
        good = good.orderBy(F.crc32(F.col("doc_id").cast("string")), "doc_id").limit(most)
    return good.select(F.col("doc_id").alias("trusted_id"), _counted(F.col("doc_id")).alias("fits"))


def rows_trusted(rows: DataFrame, trusted: DataFrame, fits: bool, broadcast: bool) -> DataFrame:
    """Those of ``rows(doc_id, ...)`` whose document is trusted and counted, or trusted and not counted."""
    ids = trusted.filter(F.col("fits") == fits).select("trusted_id")
    ids = F.broadcast(ids) if broadcast else ids.hint("shuffle_hash")  # rows are wide: they are not to be sorted
    own = rows.filter(_counted(F.col("doc_id").cast(trusted.schema["trusted_id"].dataType)) == fits)
    return own.join(ids, F.col("doc_id") == F.col("trusted_id")).drop("trusted_id")


def bucket_gains(rows: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Gains by bucket, from ``grams`` of all rows and of the target's; at most ``buckets`` rows of sums are collected."""
    places = [
        frame.select(F.explode("grams").alias("bucket"), F.lit(t).alias("t")) for t, frame in enumerate((rows, target))
    ]
    counts = places[0].union(places[1]).groupBy("bucket").agg(F.count_if(F.col("t") == 0).alias("s"), F.sum("t").alias("t"))
    s, t = np.zeros(buckets), np.zeros(buckets)
    for r in counts.collect():
        s[r["bucket"]], t[r["bucket"]] = r["s"], r["t"]
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(int).tolist()


def score_of(grams: Column, gains: list[int]) -> Column:
    """The floored mean gain of a document's buckets; 0 without any."""
    # One literal, folded to an array before it runs.
    table = F.split(F.lit(",".join(map(str, gains))), ",").cast("array<bigint>")
    total = F.aggregate(grams, F.lit(0).cast("long"), lambda n, b: n + F.element_at(table, b + 1))
    return F.when(F.size(grams) > 0, F.floor(total / F.size(grams))).otherwise(0).cast("long")


def threshold_of(held: DataFrame, spread: int = SPREAD) -> int | None:
    """The least score of a document that is kept, from the scores of trusted documents that were not counted."""
    counts = sorted((r["score"], r["count"]) for r in held.groupBy("score").count().collect())  # whole numbers, bounded rows
    if not counts:
        return None
    upto = np.cumsum([n for _, n in counts])
    median, low = (counts[int(np.searchsorted(upto, -(-int(upto[-1]) * p // 100)))][0] for p in (50, 5))
    return median - spread * (median - low)


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    buckets: int = BUCKETS,
    most_trusted: int | None = None,
    spread: int = SPREAD,
    most_broadcast: int = MOST_BROADCAST,
) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    score, threshold."""
    trusted = stage(trusted_ids(labels, most_trusted), "trusted")
    few = trusted.count() <= most_broadcast
    texts = docs.select(docs["doc_id"], text_of(docs).alias("text"))
    # One pass over the texts; what is staged is a figure for each rule and a bucket for each n-gram.
    figures = stage(with_grams(base_figures(texts), buckets).drop("text"), "figures")
    gains = bucket_gains(figures, rows_trusted(figures.select("doc_id", "grams"), trusted, True, few), buckets)
    rows = stage(figures.withColumn("score", score_of(F.col("grams"), gains)).drop("grams"), "rules")
    threshold = threshold_of(rows_trusted(rows.select("doc_id", "score"), trusted, False, few), spread)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    passed = F.lit(True) if threshold is None else F.col("score") >= threshold
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & passed).alias("kept"), "score", F.lit(threshold).cast("long").alias("threshold"),
    )

"""Exact dedup by heavy-hitter split.

A Misra-Gries pass over the digests finds every digest that a large share of the rows may carry. Their exact counts and
winners are then verified on the data and broadcast (never more than ``MOST_COUNTERS`` rows), so rows of such groups are
settled on the map side and none of them is shuffled. All other digests are grouped by an ordinary partially aggregated
shuffle; what remains there has fewer than rows / counters rows a digest, and the number of counters grows with the rows.

Defined cases: null text is empty text; texts are equal when identical without the characters U+0009-U+000D and U+0020;
of equal texts the longest original (code points) stays, then the smallest ``doc_id`` of whatever type (null ids last),
then one row of any that still tie; an empty table gives an empty result; other columns are left alone, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, free_name, stage, text_of, with_row_id

SPACES = " \t\n\x0b\x0c\r"
#: Misra-Gries counters: one for every ROWS_PER_COUNTER rows, within these bounds.
COUNTERS, MOST_COUNTERS = 1024, 1 << 16
ROWS_PER_COUNTER = 1 << 20


def _trim(counts: pd.Series, counters: int) -> pd.Series:
    """Misra-Gries reduction: subtract the (counters + 1)-th largest count and drop what is not positive."""
    if len(counts) <= counters:
        return counts
    counts = counts.sort_values(ascending=False)
    counts = counts - counts.iloc[counters]
    return counts[counts > 0]


def _summaries(counters: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = pd.Series(dtype="int64")
        for pdf in batches:
            total = _trim(total.add(pdf["sha"].value_counts(), fill_value=0), counters)
        total = total.astype("int64")
        yield pd.DataFrame({"sha": total.index.astype(str), "n": total.to_numpy()})

    return run


def _merged(counters: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = _trim(pdf.groupby("sha")["n"].sum(), counters).astype("int64")
        return pd.DataFrame({"sha": total.index.astype(str), "n": total.to_numpy()})

    return run


def frequent_digests(rows: DataFrame, counters: int = COUNTERS, fan_in: int = 64) -> DataFrame:
    """At most ``counters`` digests, among them every one that more than rows / (counters + 1) rows carry.

    Each partition is summarised on its own; summaries meet ``fan_in`` at a time, level by level, so no task sees more
    than ``fan_in * counters`` entries. ``rows`` should be a staged table with the column ``sha``.
    """
    # A count of one in a partition that holds more digests than counters is dropped by the reduction itself.
    part = rows.select("sha").mapInPandas(_summaries(counters), "sha string, n long")
    parts = rows.rdd.getNumPartitions()
    merged = part.withColumn("g", F.spark_partition_id())
    while True:
        parts = -(-parts // fan_in)
        merged = merged.withColumn("g", F.floor(F.col("g") / fan_in).cast("int") if parts > 1 else F.lit(0))
        merged = merged.groupBy("g").applyInPandas(_merged(counters), "sha string, n long")
        if parts <= 1:
            return merged
        merged = stage(merged.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(parts))), "mg")


def digested(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, n, sha) per row: all that the decisions need."""
    text = text_of(docs)
    return with_row_id(
        docs.select(
            docs["doc_id"],
            F.length(text).cast("long").alias("n"),
            F.sha2(F.translate(text, SPACES, ""), 256).alias("sha"),
        ),
        "uid",
    )


def _best():
    """The row of a group that stays: longest, then smallest id (null last), then first row."""
    return F.min(F.struct((-F.col("n")).alias("less"), F.col("doc_id").isNull().alias("unknown"), "doc_id", "uid")).alias("best")


def decide(rows: DataFrame, counters: int | None = None) -> DataFrame:
    """``rows`` as of ``digested``, staged. Adds keep_id, group_size and kept."""
    if counters is None:
        counters = max(COUNTERS, min(MOST_COUNTERS, rows.count() // ROWS_PER_COUNTER))
    frequent = F.broadcast(frequent_digests(rows, counters).select("sha"))
    verified = stage(
        rows.join(frequent, "sha").groupBy("sha").agg(F.count(F.lit(1)).alias("group_size"), _best()), "heavy"
    )
    known = rows.join(F.broadcast(verified), "sha", "left")
    heavy = known.filter("group_size is not null")
    light = rows.join(F.broadcast(verified.select("sha")), "sha", "left_anti")
    groups = light.groupBy("sha").agg(F.count(F.lit(1)).alias("group_size"), _best())
    return (
        heavy.select("sha", "uid", "doc_id", "group_size", "best")
        .unionByName(light.join(groups, "sha").select("sha", "uid", "doc_id", "group_size", "best"))
        .select(
            "uid",
            "doc_id",
            F.col("best.doc_id").alias("keep_id"),
            "group_size",
            (F.col("uid") == F.col("best.uid")).alias("kept"),
            F.col("sha").alias("text_sha256"),
        )
    )


def exact_dedup(docs: DataFrame, counters: int | None = None) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256."""
    return decide(stage(digested(docs), "digests"), counters).drop("uid")


def drop_exact_copies(docs: DataFrame, counters: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are.

    Ids and digests of rows that go are joined back, by a broadcast where they are few; rows that share both id and
    digest are told apart by their length, and of those that still tie one is taken.
    """
    decided = decide(stage(digested(docs), "digests"), counters)
    lost = stage(
        decided.groupBy("doc_id", "text_sha256").agg(
            F.max("kept").alias("any_kept"), F.count(F.lit(1)).alias("same"), F.count_if("kept").alias("kept_rows")
        ).filter("not any_kept or same > kept_rows"),
        "lost",
    )
    text = text_of(docs)
    k, i, d = (free_name(docs, x) for x in ("_key", "_id", "_sha"))
    mark = docs.withColumn(k, F.struct(F.sha2(F.translate(text, SPACES, ""), 256).alias("sha"), F.length(text).alias("n")))
    on = F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(f"{k}.sha") == F.col(d))
    gone = lost.filter("not any_kept").select(F.col("doc_id").alias(i), F.col("text_sha256").alias(d))
    stay = mark.join(broadcast_if_small(gone), on, "left_anti")
    # Rows that share both id and digest: only there can one id both stay and go.
    twice = lost.filter("any_kept and same > kept_rows").select(F.col("doc_id").alias(i), F.col("text_sha256").alias(d))
    if twice.isEmpty():
        return stay.drop(k)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    tied = stay.join(twice, on, "left_semi").select(whole.alias("row"), F.col(k).alias("key"))
    one = tied.groupBy("row.doc_id", "key.sha").agg(F.max_by("row", "key.n").alias("row"))
    return stay.join(twice, on, "left_anti").drop(k).unionByName(one.select("row.*"))

"""Spells of activity on a stream: stateful event time with timers and expiry, and the same as a batch.

Events are first counted by key and minute, in a windowed aggregation with a watermark: partial sums are made before the
shuffle, so a key with a third of all events sends at most a row a minute and task. A minute reaches the stateful
operator when it is final, so late events are those that the aggregation refuses: their minute ended at or before the
watermark. Minutes less than ``gap`` apart make a spell. The operator keeps a value state (the open spell), a map state
(its counts by kind) and a list state (whether each of the last ``RECENT`` spells failed); a timer ends the spell when the
watermark is over ``gap`` past its last event, another one forgets the key, with a row that says so, when it is over
``expiry`` past it. A key's state is thus of fixed size but for the kinds, and gone after ``expiry``.

Defined cases: events without a key or a time are left out; a null kind is a kind of its own (``''``); repeated events
count each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from listloom.session import ship

MINUTE = 60_000_000
RECENT = 3
SPELL = "user_id long, first long, last long, n long, errors long, kinds string, health string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def minutes(events: DataFrame, delay: str) -> DataFrame:
    """Counts by user and minute; of a stream those that the watermark has made final."""
    known = events.filter("user_id is not null and ts is not null").withColumn("kind", F.coalesce("event_type", F.lit("")))
    if known.isStreaming:
        known = known.withWatermark("ts", delay)
    us = F.unix_micros("ts")
    n = F.count(F.lit(1))
    # Kinds are counted as rows of their own, so that a hot user is summed before the shuffle.
    return known.groupBy("user_id", F.window("ts", "1 minute").alias("w"), "kind").agg(
        F.min(us).alias("first"), F.max(us).alias("last"), n.alias("n")
    )


class Spells(StatefulProcessor):
    """Rows (user_id, kind, first, last, n) of final minutes in, closed spells out; times are microseconds."""

    def __init__(self, gap: int, expiry: int):
        self.gap, self.expiry = gap, expiry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "first long, last long, n long, errors long")
        self.kinds = handle.getMapState("kinds", "kind string", "n long")
        self.recent = handle.getListState("recent", "failed boolean")
        self.seen = handle.getValueState("seen", "last long")

    def handleInputRows(self, key, rows, timers) -> Iterator:
        import pandas as pd

        # A user's final minutes of one batch: bounded by its span of time, not by its events.
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["first", "last", "kind"], kind="stable")
        yield self._turn(key, timers, zip(batch["first"].tolist(), batch["last"].tolist(), batch["n"].tolist(), batch["kind"].tolist()))

    def handleExpiredTimer(self, key, timers, expired) -> Iterator:
        yield self._turn(key, timers, ())

    def _turn(self, key, timers, minutes):
        """Pass the minutes, then the watermark; each state is read and written once, since every call is a message."""
        import pandas as pd

        out, mark = [], timers.getCurrentWatermarkInMs()
        last = self.seen.get()[0] if self.seen.exists() else None
        spell = self.open.get() if self.open.exists() else None
        counts = {k[0]: v[0] for k, v in self.kinds.iterator()} if spell else {}
        flags = [f[0] for f in self.recent.get()] if last is not None and self.recent.exists() else []

        def end(over_gap: bool, over_expiry: bool) -> None:
            nonlocal spell, last
            if spell and over_gap:
                flags[:] = [*flags, spell[3] > 0][-RECENT:]
                text = ",".join(f"{k}={n}" for k, n in sorted(counts.items()))
                out.append((key[0], *spell, text, "blocked" if sum(flags) > 1 else "degraded" if sum(flags) else "healthy"))
                spell = None
                counts.clear()
            if over_expiry:
                out.append((key[0], last, last, 0, 0, "", "gone"))
                flags.clear()
                last = None

        for first, until, n, kind in minutes:
            if last is not None:
                end(first - last >= self.gap, first - last >= self.expiry)
            a, b, total, errors = spell or (first, until, 0, 0)
            last = max(b, until)
            spell = (min(a, first), last, total + n, errors + n * (kind == "error"))
            counts[kind] = counts.get(kind, 0) + n
        if last is not None:
            end(last + self.gap < mark * 1000, last + self.expiry < mark * 1000)
        self._write(last, spell, counts, flags)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if last is not None:
            self.handle.registerTimer(max((last + (self.gap if spell else self.expiry)) // 1000, mark + 1))
        return pd.DataFrame(out, columns=[c.split()[0] for c in SPELL.split(", ")])

    def _write(self, last, spell, counts: dict, flags: list) -> None:
        self.kinds.clear()
        for kind, n in counts.items():
            self.kinds.updateValue((kind,), (n,))
        for state, value in ((self.open, spell), (self.seen, None if last is None else (last,)), (self.recent, [(f,) for f in flags])):
            if not value:
                state.clear()
            elif state is self.recent:
                state.put(value)
            else:
                state.update(value)

    def close(self) -> None:
        pass


@contextmanager
def _rocks(spark: SparkSession):
    """The store that state with timers needs; a query takes its setting when it starts."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def spell_stream(events: DataFrame, delay: str, gap: int, expiry: int) -> DataFrame:
    """Closed spells of a stream of events (user_id, event_type, ts)."""
    ship(events.sparkSession)
    final = minutes(events, delay).select("user_id", "kind", "first", "last", "n", F.window_time("w").alias("at"))
    return final.groupBy("user_id").transformWithStateInPandas(Spells(gap, expiry), SPELL, "append", "EventTime")


def run(events: DataFrame, path: str, delay: str, gap: int, expiry: int) -> DataFrame:
    """Work off what is there now; state and rows live in ``path``, so that another run goes on where this one ended. A
    batch that is played again writes its own part again."""
    spark = events.sparkSession
    out = spell_stream(events, delay, gap, expiry)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/{number}")

    with _rocks(spark):
        q = (
            out.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", f"{path}/state")
            .trigger(availableNow=True).start()
        )
    q.awaitTermination()
    return spark.read.schema(SPELL).option("recursiveFileLookup", True).parquet(f"{path}/rows")


def spells(events: DataFrame, mark: Column, gap: int, expiry: int) -> DataFrame:
    """The batch form: closed spells of events none of which is late, at a watermark in microseconds (a column that is the
    same in every row)."""
    by = minutes(events, "").withColumn("mark", mark).filter(F.unix_micros("w.end") <= F.col("mark"))
    own = Window.partitionBy("user_id").orderBy("first", "last", "kind")
    reach = F.max("last").over(own.rowsBetween(Window.unboundedPreceding, -1))
    quiet = by.withColumn("quiet", F.col("first") - reach)
    numbered = quiet.withColumn("life", F.count_if(F.col("quiet") >= expiry).over(own)).withColumn("k", F.count_if(F.col("quiet") >= gap).over(own))
    kinds = numbered.groupBy("user_id", "life", "k", "kind", "mark").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "n"))), lambda x: F.concat_ws("=", x["kind"], x["n"].cast("string"))), ",")
    spell = kinds.groupBy("user_id", "life", "k", "mark").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("kind") == "error", F.col("n"))), F.lit(0)).alias("errors"), text.alias("kinds"),
    )
    life = Window.partitionBy("user_id", "life").orderBy("k")
    failed = F.count_if(F.col("errors") > 0).over(life.rowsBetween(1 - RECENT, 0))
    health = F.when(failed > 1, "blocked").when(failed == 1, "degraded").otherwise("healthy")
    closed = spell.withColumn("health", health).filter(F.col("last") + gap < F.col("mark"))
    names = [c.split()[0] for c in SPELL.split(", ")]
    gone = spell.groupBy("user_id", "life", "mark").agg(F.max("last").alias("last")).filter(F.col("last") + expiry < F.col("mark")).select(
        "user_id", F.col("last").alias("first"), "last", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("errors"), F.lit("").alias("kinds"), F.lit("gone").alias("health")
    )
    return closed.select(*names).unionByName(gone)

"""Stateful spells over a stream of small files against their batch form and a plain loop."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from listloom.streaming import spells

HOUR = 3_600_000_000
GAP, EXPIRY = 2 * HOUR, 12 * HOUR
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string"
START = dt.datetime(2024, 1, 1)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def plain(events, mark):
    """Events (user, microseconds, kind) in order, one user after the other."""
    out = []
    users = sorted({u for u, _, _ in events})
    for user in users:
        mine = sorted((t, k) for u, t, k in events if u == user and (t // 60_000_000 + 1) * 60_000_000 <= mark)
        flags, spell = [], None

        def close():
            counts = {}
            for _, k in spell:
                counts[k] = counts.get(k, 0) + 1
            flags.append(counts.get("error", 0) > 0)
            bad = sum(flags[-3:])
            word = "blocked" if bad > 1 else "degraded" if bad else "healthy"
            out.append((user, spell[0][0], spell[-1][0], len(spell), counts.get("error", 0), ",".join(f"{k}={n}" for k, n in sorted(counts.items())), word))

        for t, k in [*mine, (None, None)]:
            last = spell[-1][0] if spell else None
            if last is not None and (last + GAP < mark if t is None else t - last >= GAP):
                close()
                if last + EXPIRY < mark if t is None else t - last >= EXPIRY:
                    out.append((user, last, last, 0, 0, "", "gone"))
                    flags.clear()
                spell = None
            if t is not None:
                spell = [*(spell or []), (t, k)]
    return sorted(out)


def made(seed, n, first_hour, hours):
    r = random.Random(seed)
    return [(seed * 10_000 + k, START + dt.timedelta(hours=first_hour, microseconds=r.randrange(hours * HOUR)), r.choice([1, 1, 1, 2, 3, 4, 5]), r.choice(["view", "error", "click", None])) for k in range(n)]


def micros(t):
    return round((t.replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000)


def triples(rows):
    return [(u, micros(t), k or "") for _, t, u, k in rows if u is not None and t is not None]


def land(spark, folder, rows):
    utc = [(i, t and t.replace(tzinfo=dt.timezone.utc), u, k) for i, t, u, k in rows]
    spark.createDataFrame(utc, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def source(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def test_restarted_stream_equals_batch_and_drops_late_events(spark, tmp_path):
    folder, path = f"{tmp_path}/events", f"{tmp_path}/store"
    parts = [made(1, 60, 0, 20), made(2, 40, 20, 30), made(3, 30, 60, 30)]
    parts[1] += [(7, None, 1, "view"), (8, START + dt.timedelta(hours=30), None, "view")]
    parts[1].append((9, START + dt.timedelta(hours=50), 9, "view"))
    late = [(90, START + dt.timedelta(hours=3), 1, "error"), (91, START + dt.timedelta(hours=2), 77, "view")]
    land(spark, folder, parts[0])
    spells.run(source(spark, folder), path, "1 hour", GAP, EXPIRY)
    land(spark, folder, parts[1])
    got = rows_of(spells.run(source(spark, folder), path, "1 hour", GAP, EXPIRY))
    assert any(r[-1] == "gone" for r in got)
    # A third run, with events that are long past the watermark among the others.
    land(spark, folder, parts[2] + late)
    got = rows_of(spells.run(source(spark, folder), path, "1 hour", GAP, EXPIRY))
    timely = [e for p in parts for e in p]
    mark = max(micros(t) for _, t, u, _ in timely if t and u is not None) // 1000 * 1000 - HOUR
    assert got == plain(triples(timely), mark)
    batch = spark.createDataFrame([(i, t and t.replace(tzinfo=dt.timezone.utc), u, k) for i, t, u, k in timely], SCHEMA)
    assert got == rows_of(spells.spells(batch, F.lit(mark), GAP, EXPIRY))
    # Nothing new: nothing more.
    assert rows_of(spells.run(source(spark, folder), path, "1 hour", GAP, EXPIRY)) == got


@pytest.mark.parametrize("seed", [11, 12])
def test_batch_form_equals_a_plain_loop(spark, seed):
    rows = made(seed, 200, 0, 200) * 2
    df = spark.createDataFrame([(i, t.replace(tzinfo=dt.timezone.utc), u, k) for i, t, u, k in rows], SCHEMA)
    for hour in (0, 77, 400):
        mark = micros(START) + hour * HOUR
        assert rows_of(spells.spells(df, F.lit(mark), GAP, EXPIRY)) == plain(triples(rows), mark)


def test_empty_table(spark):
    assert spells.spells(spark.createDataFrame([], SCHEMA), F.lit(0), GAP, EXPIRY).count() == 0

"""Spells of activity: state with timers over the events as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from listloom.catalogue import query
from listloom.session import shared_folder
from listloom.sources.views import table
from listloom.streaming import events as streams
from listloom.streaming import spells

HOUR = 3_600_000_000
GAP, EXPIRY, DELAY = 6 * HOUR, 48 * HOUR, HOUR


def _clock(c: str):
    return F.date_format(F.timestamp_micros(c), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)


@query(
    f"""WITH e AS (SELECT user_id, coalesce(event_type, '') AS kind, epoch_us(ts) AS us FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
w AS (SELECT max(us) // 1000 * 1000 - {DELAY} AS mark FROM e),
f AS (SELECT user_id, kind, us, lag(us) OVER (PARTITION BY user_id ORDER BY us, kind) AS former FROM e, w WHERE (us // 60000000 + 1) * 60000000 <= mark),
k AS (SELECT *, count(*) FILTER (us - former >= {GAP}) OVER o AS spell, count(*) FILTER (us - former >= {EXPIRY}) OVER o AS life FROM f WINDOW o AS (PARTITION BY user_id ORDER BY us, kind)),
c AS (SELECT user_id, spell, string_agg(kind || '=' || n, ',' ORDER BY kind) AS kinds FROM (SELECT user_id, spell, kind, count(*) AS n FROM k GROUP BY ALL) GROUP BY ALL),
s AS (SELECT user_id, life, spell, min(us) AS a, max(us) AS b, count(*) AS n, count(*) FILTER (kind = 'error') AS errors FROM k GROUP BY ALL),
h AS (SELECT *, count(*) FILTER (errors > 0) OVER (PARTITION BY user_id, life ORDER BY spell ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS bad FROM s),
r AS (SELECT user_id, a, b, n, errors, kinds, CASE WHEN bad > 1 THEN 'blocked' WHEN bad = 1 THEN 'degraded' ELSE 'healthy' END AS health FROM h JOIN c USING (user_id, spell), w WHERE b + {GAP} < mark
 UNION ALL SELECT user_id, max(b), max(b), 0, 0, '', 'gone' FROM s, w GROUP BY user_id, life, mark HAVING max(b) + {EXPIRY} < mark)
SELECT user_id, strftime(make_timestamp(a), '%Y-%m-%d %H:%M:%S.%f') AS first, strftime(make_timestamp(b), '%Y-%m-%d %H:%M:%S.%f') AS last, n, errors, kinds, health FROM r"""
)
def activity_spells(spark, sf_dir):
    """SCH-11, SCH-04: spells of a user's events with their health, over a stream with timers and expiry; a user quiet for
    two days is forgotten. What the watermark has not passed is still open and not in the result."""
    events = streams.stream(spark, f"{sf_dir}/events.parquet", table(spark, sf_dir, "events").schema).select("user_id", "event_type", "ts")
    out = spells.run(events, shared_folder(spark, "spells"), f"{DELAY // HOUR} hour", GAP, EXPIRY)
    return out.select("user_id", _clock("first"), _clock("last"), "n", "errors", "kinds", "health")

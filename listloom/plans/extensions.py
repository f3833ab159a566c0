"""Extensions: set operations, grouping sets, windows over event time, as-of and range joins. None is needed by the
listing pipeline itself."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from listloom.catalogue import query
from listloom.sources.views import table
from listloom.streaming import events as streams


@query(
    """SELECT kind, count(*) AS n, sum(u)::BIGINT AS total FROM (
  SELECT 'union' AS kind, u FROM (SELECT user_id AS u FROM events WHERE event_type = 'view' UNION SELECT user_id FROM events WHERE event_type = 'error' AND user_id > 40)
  UNION ALL SELECT 'intersect', u FROM (SELECT user_id AS u FROM events WHERE event_type = 'view' AND value > 9 INTERSECT SELECT user_id FROM events WHERE event_type = 'error' AND value > 9)
  UNION ALL SELECT 'except', u FROM (SELECT user_id AS u FROM events WHERE event_type = 'view' EXCEPT SELECT user_id FROM events WHERE event_type = 'error' AND value > 20)) GROUP BY kind"""
)
def set_ops(spark, sf_dir):
    """§2.8."""
    e = table(spark, sf_dir, "events")
    ids = lambda c: e.filter(c).select("user_id")
    parts = {
        "union": ids("event_type = 'view'").union(ids("event_type = 'error' and user_id > 40")).distinct(),
        "intersect": ids("event_type = 'view' and value > 9").intersect(ids("event_type = 'error' and value > 9")),
        "except": ids("event_type = 'view'").subtract(ids("event_type = 'error' and value > 20")),
    }
    out = None
    for k, df in parts.items():
        own = df.agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("total"))
        out = own if out is None else out.unionByName(own)
    return out.filter("n > 0")


@query("SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus) + 2 * grouping(o_orderpriority) AS g, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def rollup_cube(spark, sf_dir):
    """AGG-28: all groupings in one pass."""
    df = table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority")
    g = (F.grouping("o_orderstatus") + 2 * F.grouping("o_orderpriority")).cast("long")
    return df.agg(g.alias("g"), F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_returnflag, l_linestatus), ())")
def grouping_sets(spark, sf_dir):
    """AGG-28."""
    df = table(spark, sf_dir, "lineitem")
    r, s = F.col("l_returnflag"), F.col("l_linestatus")
    return df.groupingSets([[r], [r, s], []], r, s).agg(F.count(F.lit(1)).alias("n"))


@query()
def approx_distinct(spark, sf_dir):
    """AGG-28: sketches; their error bound is tested instead."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.approx_count_distinct("l_partkey", 0.02).alias("parts"), F.percentile_approx("l_quantity", 0.5, 1000).alias("median")
    )


@query("SELECT strftime(time_bucket(INTERVAL '6' HOUR, ts), '%Y-%m-%d %H') AS w, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_windows(spark, sf_dir):
    """SCH-11."""
    df = streams.tumbling(table(spark, sf_dir, "events"), "6 hours")
    return df.select(F.date_format("start", "yyyy-MM-dd HH").alias("w"), "event_type", "n")


@query(
    """SELECT strftime(w, '%Y-%m-%d %H') AS w, count(*) AS n FROM (
  SELECT unnest([time_bucket(INTERVAL '6' HOUR, ts), time_bucket(INTERVAL '6' HOUR, ts) - INTERVAL '6' HOUR]) AS w FROM events) GROUP BY 1"""
)
def sliding_windows(spark, sf_dir):
    """SCH-11: windows of twelve hours every six."""
    df = table(spark, sf_dir, "events").groupBy(F.window("ts", "12 hours", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return df.select(F.date_format("w.start", "yyyy-MM-dd HH").alias("w"), "n")


@query(
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '8' HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, n, count(*) AS sessions FROM (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL) GROUP BY ALL"""
)
def session_windows(spark, sf_dir):
    """SCH-11: gaps of eight hours end a session."""
    df = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "8 hours")).agg(F.count(F.lit(1)).alias("n"))
    return df.groupBy("user_id", "n").agg(F.count(F.lit(1)).alias("sessions"))


@query("SELECT c.event_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') c ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON c.user_id = v.user_id AND c.ts >= v.ts")
def asof_last(spark, sf_dir):
    """JON-22: the last view before each purchase, by one sort of the union."""
    df = table(spark, sf_dir, "events").filter(F.col("event_type").isin("purchase", "view"))
    is_view = F.col("event_type") == "view"
    w = Window.partitionBy("user_id").orderBy("ts", is_view.desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(is_view, F.col("event_id")), ignorenulls=True).over(w)
    return df.withColumn("view_id", last).filter(~is_view).select("event_id", "view_id")


@query("SELECT a.event_id, count(b.event_id) AS near FROM (SELECT * FROM events WHERE event_type = 'error') a LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') b ON b.ts > a.ts AND b.ts <= a.ts + INTERVAL '30' MINUTE GROUP BY a.event_id")
def range_join(spark, sf_dir):
    """JON-22: bucketed band join: an equi join on half-hour buckets, then the exact bounds."""
    e = table(spark, sf_dir, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")))
    half = 1_800_000_000
    bucket = F.floor(F.col("s") / half)
    a = e.filter("event_type = 'error'").select("event_id", F.col("s").alias("a"), F.explode(F.array(bucket, bucket + 1)).alias("k"))
    b = e.filter("event_type = 'click'").select(F.col("event_id").alias("other"), F.col("s").alias("b"), bucket.alias("k"))
    hits = a.join(b, "k").filter(f"b > a and b <= a + {half}").groupBy("event_id").agg(F.count(F.lit(1)).alias("near"))
    errors = e.filter("event_type = 'error'").select("event_id")
    return errors.join(hits, "event_id", "left").select("event_id", F.coalesce("near", F.lit(0)).alias("near"))


@query("SELECT coalesce(a.k, b.k) AS k, a.n AS left_n, b.n AS right_n FROM (SELECT o_custkey % 300 AS k, count(*) AS n FROM orders WHERE o_custkey % 300 < 200 GROUP BY 1) a FULL JOIN (SELECT c_custkey % 300 AS k, count(*) AS n FROM customer WHERE c_custkey % 300 > 100 GROUP BY 1) b ON a.k = b.k")
def full_join(spark, sf_dir):
    """JON-22."""
    n = F.count(F.lit(1))
    a = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 300).alias("k")).agg(n.alias("left_n")).filter("k < 200")
    b = table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 300).alias("k")).agg(n.alias("right_n")).filter("k > 100")
    return a.join(b, "k", "full_outer").select("k", "left_n", "right_n")


@query("SELECT event_type, ts_day, n, rank() OVER (PARTITION BY event_type ORDER BY n DESC) AS r, ntile(4) OVER (PARTITION BY event_type ORDER BY n DESC, ts_day) AS q, n - lag(n) OVER (PARTITION BY event_type ORDER BY ts_day) AS diff FROM (SELECT event_type, strftime(ts, '%Y-%m-%d') AS ts_day, count(*) AS n FROM events GROUP BY ALL)")
def ranking_windows(spark, sf_dir):
    """§2.6: ranking and analytic functions."""
    d = table(spark, sf_dir, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("ts_day")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("event_type")
    return d.select(
        "event_type", "ts_day", "n", F.rank().over(w.orderBy(F.desc("n"))).cast("long").alias("r"),
        F.ntile(4).over(w.orderBy(F.desc("n"), "ts_day")).cast("long").alias("q"), (F.col("n") - F.lag("n").over(w.orderBy("ts_day"))).alias("diff"),
    )


@query()
def stream_dedup(spark, sf_dir):
    """SCH-09, SCH-11: a bounded micro-batch run with a watermark; the result is a table."""
    return streams.deduplicated(spark, f"{sf_dir}/events.parquet", table(spark, sf_dir, "events").schema)

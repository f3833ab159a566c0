"""Incremental queries: upsert, history, lifecycle, retention, scheduling, alerts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from listloom.catalogue import query
from listloom.operators import filters, schedule, timelines
from listloom.sources.views import table, view, with_views


def _slices(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    old = o.filter("o_orderkey % 5 <> 1").selectExpr("o_orderkey AS id", "o_totalprice AS price", "o_orderstatus AS status", "1 AS run")
    new = o.filter("o_orderkey % 7 <> 2").selectExpr(
        "o_orderkey AS id", "CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice - 10 ELSE o_totalprice END AS price",
        "CASE WHEN o_orderkey % 9 = 3 THEN NULL ELSE o_orderstatus END AS status", "2 AS run",
    )
    return old, new


SLICES = """
WITH old AS (SELECT o_orderkey AS id, o_totalprice AS price, o_orderstatus AS status, 1 AS run FROM orders WHERE o_orderkey % 5 <> 1),
new AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice - 10 ELSE o_totalprice END AS price,
  CASE WHEN o_orderkey % 9 = 3 THEN NULL ELSE o_orderstatus END AS status, 2 AS run FROM orders WHERE o_orderkey % 7 <> 2),
merged AS (SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NULL THEN o.price ELSE n.price END AS price,
  CASE WHEN n.id IS NULL THEN o.status ELSE n.status END AS status, coalesce(o.run, n.run) AS first_run, coalesce(n.run, o.run) AS last_run,
  CASE WHEN n.id IS NULL THEN 'missing' WHEN o.id IS NULL THEN 'inserted' WHEN o.price IS NOT DISTINCT FROM n.price
    AND o.status IS NOT DISTINCT FROM n.status THEN 'unchanged' ELSE 'updated' END AS change FROM old o FULL JOIN new n ON o.id = n.id)
"""


@query(SLICES + "SELECT * FROM merged")
def upsert_snapshot(spark, sf_dir):
    """SNK-01: the next snapshot."""
    old, new = _slices(spark, sf_dir)
    return timelines.upsert(old, new, "id", ["price", "status"], "run")


@query(SLICES + "SELECT change, count(*) AS n, round(sum(price), 2)::DOUBLE AS total FROM merged GROUP BY change")
def upsert_snapshot_report(spark, sf_dir):
    """SNK-01: inserted, updated, unchanged, missing."""
    old, new = _slices(spark, sf_dir)
    out = timelines.upsert(old, new, "id", ["price", "status"], "run")
    return out.groupBy("change").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 2).alias("total"))


@query(
    r"""SELECT p_partkey, substr(sha256('{"p_name":"' || p_name || '","p_size":' || CASE WHEN p_partkey % 17 = 0 THEN 'null' ELSE CAST(p_size AS VARCHAR) END
 || ',"p_brand":"' || p_brand || '"}'), 1, 32) AS hash FROM part"""
)
def content_fingerprint(spark, sf_dir):
    """SNK-02: unknown fields count."""
    df = table(spark, sf_dir, "part").withColumn("p_size", F.when(F.col("p_partkey") % 17 != 0, F.col("p_size")))
    return df.select("p_partkey", timelines.fingerprint("p_name", "p_size", "p_brand").alias("hash"))


HISTORY = """
WITH v AS (SELECT user_id, event_id, ts, CASE WHEN event_id % 11 = 0 THEN NULL ELSE round(value) END AS price,
  CASE WHEN event_id % 3 = 0 THEN 1 ELSE 2 END AS area FROM events WHERE event_type = 'view'),
p AS (SELECT *, lag(price) OVER w AS old_price, lag(area) OVER w AS old_area, row_number() OVER w AS k FROM v WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
h AS (SELECT event_id, user_id, ts, CASE WHEN k = 1 THEN 'baseline'
  WHEN old_price IS DISTINCT FROM price AND old_area IS DISTINCT FROM area THEN 'multiple'
  WHEN old_price IS DISTINCT FROM price THEN CASE WHEN price < old_price THEN 'price-drop' ELSE 'price-rise' END
  WHEN old_area IS DISTINCT FROM area THEN 'area' END AS change FROM p)
"""


def _history(spark, sf_dir):
    v = table(spark, sf_dir, "events").filter("event_type = 'view'").selectExpr(
        "user_id", "event_id", "ts", "CASE WHEN event_id % 11 = 0 THEN NULL ELSE round(value) END AS price",
        "CASE WHEN event_id % 3 = 0 THEN 1 ELSE 2 END AS area",
    )
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    none = F.lit(None).cast("date")
    kind = timelines.change_kind(F.lag("price").over(w), F.col("price"), F.lag("area").over(w), F.col("area"), none, none)
    return v.select("event_id", "user_id", "ts", F.when(F.row_number().over(w) == 1, "baseline").otherwise(kind).alias("change"))


@query(HISTORY + "SELECT event_id, user_id, change FROM h WHERE change IS NOT NULL")
def history_changes(spark, sf_dir):
    """SNK-12."""
    return _history(spark, sf_dir).filter("change is not null").select("event_id", "user_id", "change")


@query(HISTORY + "SELECT DISTINCT user_id FROM h WHERE change = 'price-drop' AND ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL '2' DAY")
def recent_price_drops(spark, sf_dir):
    """AGG-08."""
    recent = F.col("ts") >= F.expr("timestamp_ntz '2024-01-28 00:00:00'")
    return _history(spark, sf_dir).filter((F.col("change") == "price-drop") & recent).select("user_id").distinct()


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS follow_up FROM events WHERE event_type IN ('click', 'purchase')")
def follow_up_index(spark, sf_dir):
    """SNK-23."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    df = table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "purchase"))
    return df.select("event_id", (F.row_number().over(w) - 1).cast("long").alias("follow_up"))


@query(
    """WITH c AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events), q AS (
  SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS hour,
  count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS day,
  count(*) OVER (PARTITION BY user_id, event_type ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS kind, value FROM c)
SELECT event_id, hour, day, CASE WHEN value < 0.5 THEN 'score' WHEN hour > 1 THEN 'hourly' WHEN day > 3 THEN 'daily' WHEN kind > 1 THEN 'source' END AS reason FROM q"""
)
def quota_windows(spark, sf_dir):
    """FLT-19, SCH-05: guards in order, with sliding counts over epoch seconds."""
    df = table(spark, sf_dir, "events").withColumn("s", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000))
    user = Window.partitionBy("user_id").orderBy("s")
    kind = Window.partitionBy("user_id", "event_type").orderBy("s")
    n = F.count(F.lit(1))
    df = df.select("event_id", "value", n.over(user.rangeBetween(-3600, 0)).alias("hour"), n.over(user.rangeBetween(-86400, 0)).alias("day"), n.over(kind.rangeBetween(-86400, 0)).alias("kind"))
    reason = filters.first_failure(
        (F.col("value") >= 0.5, "score"), (F.col("hour") <= 1, "hourly"), (F.col("day") <= 3, "daily"), (F.col("kind") <= 1, "source")
    )
    return df.select("event_id", "hour", "day", reason.alias("reason"))


@query("SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'purchase') AS purchases, max(value) AS top FROM events GROUP BY ALL")
def daily_snapshot(spark, sf_dir):
    """SNK-13: one row per user and day."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(kind == "view").alias("views"), F.count_if(kind == "purchase").alias("purchases"), F.max("value").alias("top")
    )


@query(
    """WITH known AS (SELECT DISTINCT l_suppkey AS source, l_partkey AS ref FROM lineitem WHERE l_shipdate < TIMESTAMP '2000-06-01 00:00:00'),
seen AS (SELECT DISTINCT l_suppkey AS source, l_partkey AS ref FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-06-01 00:00:00'),
c AS (SELECT source, count(*) AS known, count(s.ref) AS seen FROM known k LEFT JOIN seen s USING (source, ref) GROUP BY source),
m AS (SELECT k.source, k.ref, k.ref % 4 + 1 AS runs FROM known k ANTI JOIN seen s USING (source, ref))
SELECT m.source, ref, runs, CASE WHEN NOT (seen > 0 AND NOT (known >= 10 AND seen * 2 < known)) THEN 'active' WHEN runs >= 3 THEN 'inactive' WHEN runs >= 2 THEN 'possiblyInactive' ELSE 'active' END AS lifecycle
FROM m JOIN c USING (source)"""
)
def mark_missing_ladder(spark, sf_dir):
    """SNK-08, SNK-09, SNK-11: unseen refs climb the ladder where the run is believable."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("ref"), "l_shipdate")
    before = F.col("l_shipdate") < F.expr("timestamp_ntz '2000-06-01 00:00:00'")
    # One aggregation tells for each ref whether it was known and whether it was seen.
    refs = rows.groupBy("source", "ref").agg(F.max(before).alias("known"), F.max(~before).alias("seen")).filter("known")
    w = Window.partitionBy("source")
    counted = refs.withColumns({"n_known": F.count(F.lit(1)).over(w), "n_seen": F.sum(F.col("seen").cast("int")).over(w)})
    runs = F.col("ref") % 4 + 1
    ok = timelines.absence_is_believable(F.col("n_known"), F.col("n_seen"))
    life = F.when(ok, timelines.missing_ladder(runs, F.lit("active"))).otherwise("active")
    return counted.filter("not seen").select("source", "ref", runs.alias("runs"), life.alias("lifecycle"))


@query(
    with_views(
        """SELECT id, CASE WHEN source_id NOT IN ('s1', 's2') THEN lifecycle WHEN age > 10 THEN 'inactive' WHEN age > 4 THEN 'possiblyInactive' ELSE lifecycle END AS lifecycle
FROM (SELECT *, (epoch_us(TIMESTAMP '2001-08-10 00:00:00') - epoch_us(last_seen)) / 86400e6 AS age FROM occurrences)""",
        "occurrences",
    )
)
def expire_by_age(spark, sf_dir):
    """SNK-10, SCA-50: one-shot sources age."""
    now = F.lit("2001-08-10 00:00:00").cast("timestamp")
    aged = timelines.expired(F.col("lifecycle"), F.col("last_seen"), now)
    df = view(spark, sf_dir, "occurrences")
    return df.select("id", F.when(F.col("source_id").isin("s1", "s2"), aged).otherwise(F.col("lifecycle")).alias("lifecycle"))


@query(
    with_views(
        """SELECT id % 97 AS survivor, user_id, bool_or(viewed) AS viewed, bool_or(favorite) AS favorite, bool_or(archived) AS archived,
max(CASE tracking WHEN 'visited' THEN 4 WHEN 'contacted' THEN 3 WHEN 'rejected' THEN 2 WHEN 'new' THEN 1 ELSE 0 END)::INT AS stage, strftime(min(acted_at), '%Y-%m-%d') AS since
FROM user_state GROUP BY ALL""",
        "user_state",
    )
)
def state_inheritance(spark, sf_dir):
    """SNK-04, SNK-05: state of merged groups never steps back."""
    df = view(spark, sf_dir, "user_state").withColumn("survivor", F.col("id") % 97)
    out = timelines.inherited_state(df, "survivor")
    stage = F.when(F.col("tracking") == "visited", 4).when(F.col("tracking") == "contacted", 3).when(F.col("tracking") == "rejected", 2).when(F.col("tracking") == "new", 1).otherwise(0)
    return out.select("survivor", "user_id", "viewed", "favorite", "archived", stage.alias("stage"), F.date_format("acted_at", "yyyy-MM-dd").alias("since"))


@query("SELECT event_id, event_type FROM events WHERE ts >= CASE WHEN event_type IN ('error', 'signup') THEN TIMESTAMP '2024-01-21 00:00:00' ELSE TIMESTAMP '2024-01-11 00:00:00' END")
def retention_prune(spark, sf_dir):
    """SNK-16: a limit for each kind of log."""
    short = F.col("event_type").isin("error", "signup") & (F.col("ts") < F.expr("timestamp_ntz '2024-01-21 00:00:00'"))
    return table(spark, sf_dir, "events").filter(~short & (F.col("ts") >= F.expr("timestamp_ntz '2024-01-11 00:00:00'"))).select("event_id", "event_type")


STATES = """
SELECT concat('s', CAST(s_suppkey AS VARCHAR(9))) AS source_id, CAST(30 + s_suppkey % 4 * 30 AS INT) AS interval, 10.0E0 AS least, 720.0E0 AS most,
  CAST(s_suppkey * 7 % 6 AS DOUBLE) AS average_new, s_suppkey % 5 <> 0 AS succeeded, CAST(s_suppkey % 3 AS INT) AS errors, s_suppkey % 13 <> 0 AS enabled,
  s_suppkey % 17 = 1 AS blocked, CASE WHEN s_suppkey % 11 = 2 THEN 5000 ELSE 0 END AS cooldown_until,
  CASE WHEN s_suppkey % 9 = 4 THEN NULL ELSE CAST(4900 - s_suppkey * 13 % 900 AS INT) END AS last_run, CAST(1 + s_suppkey % 4 AS INT) AS priority
FROM {supplier}
"""


@query(
    "WITH st AS (" + STATES.format(supplier="supplier") + """), e AS (SELECT *, greatest(least, least(most, CASE WHEN average_new >= 3 THEN interval / 2 WHEN average_new = 0 AND succeeded THEN interval * 2.0 ELSE interval END * power(2, errors))) AS effective FROM st),
d AS (SELECT *, (4950 - last_run) / effective AS overdue, CASE WHEN NOT enabled THEN 'disabled' WHEN blocked THEN 'blocked' WHEN cooldown_until > 4950 THEN 'cooldown' WHEN last_run IS NULL THEN 'never run' WHEN 4950 - last_run >= effective THEN 'due' ELSE 'too early' END AS reason FROM e),
p AS (SELECT source_id, reason, row_number() OVER (ORDER BY coalesce(overdue >= 4, false) DESC, CASE WHEN coalesce(overdue >= 4, false) THEN overdue END DESC NULLS LAST, priority, last_run ASC NULLS FIRST, source_id) AS place FROM d WHERE reason IN ('never run', 'due'))
SELECT source_id, reason, place, place <= 6 AS selected FROM p"""
)
def scheduler_plan(spark, sf_dir):
    """SCH-01..03, SRT-08."""
    states = spark.sql(STATES.format(supplier="{supplier}"), supplier=table(spark, sf_dir, "supplier"))
    done = schedule.plan(schedule.decisions(states, F.lit(4950)), 6)
    return done.select("source_id", "reason", F.col("place").cast("long").alias("place"), "selected")


@query("SELECT user_id, count(*) AS runs, max_by(CASE WHEN s IN (401, 403) THEN 'blocked' WHEN s = 429 THEN 'cooldown' WHEN event_id % 4 > 0 AND event_id % 6 = 0 THEN 'degraded' ELSE 'healthy' END, (ts, event_id)) AS health FROM (SELECT *, CASE event_id % 10 WHEN 1 THEN 401 WHEN 2 THEN 403 WHEN 3 THEN 429 ELSE 200 END AS s FROM events) GROUP BY user_id")
def source_health(spark, sf_dir):
    """SCH-04: the state after the latest run."""
    k = F.col("event_id") % 10
    status = F.when(k == 1, 401).when(k == 2, 403).when(k == 3, 429).otherwise(200)
    state = schedule.health(status, F.col("event_id") % 4, F.col("event_id") % 6)
    df = table(spark, sf_dir, "events").select("user_id", state.alias("h"), F.struct("ts", "event_id").alias("o"))
    return df.groupBy("user_id").agg(F.count(F.lit(1)).alias("runs"), F.max_by("h", "o").alias("health"))


@query(
    """WITH i AS (SELECT o_orderkey AS position, o_orderkey % 3 <> 0 AS known, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 15 END AS remembered FROM orders)
SELECT position, CASE WHEN NOT known THEN 0 WHEN remembered IS NULL THEN 1 WHEN remembered > 7 THEN 2 ELSE 3 END AS rank FROM i ORDER BY rank, position LIMIT 6000"""
)
def enrichment_budget(spark, sf_dir):
    """SRC-24, SCH-10: what a budget of visits goes to."""
    items = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS position", "o_orderkey % 3 <> 0 AS known", "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 15 END AS remembered_days")
    return schedule.crawl_budget(items, 6000).select("position", "rank")


@query(
    """WITH p AS (SELECT l_suppkey AS source_id, l_linenumber AS page, l_partkey AS ref, l_quantity > 2 AS known FROM lineitem),
f AS (SELECT source_id, page FROM p GROUP BY ALL HAVING avg(known::INT) >= 0.95), s AS (SELECT source_id, min(page) AS stop FROM f GROUP BY source_id)
SELECT source_id, count(*) AS refs, max(page) AS last_page FROM p LEFT JOIN s USING (source_id) WHERE stop IS NULL OR page <= stop GROUP BY source_id"""
)
def early_stop_pages(spark, sf_dir):
    """SRC-29..31: pages up to the first on known ground."""
    pages = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS source_id", "l_linenumber AS page", "l_partkey AS ref", "l_quantity > 2 AS known")
    kept = schedule.pages_until_known(pages, 0.95)
    return kept.groupBy("source_id").agg(F.count(F.lit(1)).alias("refs"), F.max("page").alias("last_page"))


@query(
    """WITH k AS (SELECT l_suppkey AS s, l_partkey AS ref, max(l_shipdate) AS last, bool_or(l_returnflag = 'R') AS photo FROM lineitem GROUP BY ALL),
x AS (SELECT s, ref, row_number() OVER (PARTITION BY s ORDER BY last DESC, ref) AS n FROM k WHERE NOT photo)
SELECT s, ref FROM k ANTI JOIN (SELECT s, ref FROM x WHERE n <= 5) USING (s, ref)"""
)
def known_refs(spark, sf_dir):
    """SRC-25: known refs without the five most recent ones that lack a photo."""
    k = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("ref")).agg(
        F.max("l_shipdate").alias("last"), F.max(F.col("l_returnflag") == "R").alias("photo")
    )
    w = Window.partitionBy("s", "photo").orderBy(F.col("last").desc(), "ref")
    return k.withColumn("n", F.row_number().over(w)).filter("photo or n > 5").select("s", "ref")


@query(
    """WITH l AS (SELECT user_id, max(CASE WHEN event_type = 'view' THEN ts END) AS a, max(CASE WHEN event_type = 'click' THEN ts END) AS b, max(CASE WHEN event_type = 'purchase' THEN ts END) AS c FROM events GROUP BY user_id)
SELECT user_id, CASE greatest(a, b, c) WHEN c THEN 'purchase' WHEN b THEN 'click' ELSE 'view' END AS kind FROM l ORDER BY greatest(a, b, c) DESC, user_id LIMIT 100"""
)
def alerts_latest_kind(spark, sf_dir):
    """SCA-54, SRT-06: the latest of three events, newest first."""
    at = lambda k: F.max(F.when(F.col("event_type") == k, F.col("ts")))
    df = table(spark, sf_dir, "events").groupBy("user_id").agg(*[at(k).alias(k) for k in ("view", "click", "purchase")])
    best = F.array_max(F.array(*[F.struct(F.col(k).alias("at"), F.lit(p).alias("p"), F.lit(k).alias("kind")) for p, k in enumerate(("view", "click", "purchase"))]))
    top = df.select("user_id", best.alias("x")).orderBy(F.col("x.at").desc(), "user_id").limit(100)
    return top.select("user_id", "x.kind")


@query(
    """WITH r AS (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id) AS k FROM events WHERE event_type = 'signup'),
d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1)
SELECT day, n, (SELECT count(*) FROM r WHERE k <= 50 AND strftime(ts, '%Y-%m-%d') = day) AS latest FROM (SELECT * FROM d ORDER BY day DESC LIMIT 20)"""
)
def latest_runs(spark, sf_dir):
    """SRT-07: the last fifty runs and the last twenty days."""
    df = table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    days = df.groupBy("day").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("day").desc()).limit(20)
    last = df.filter("event_type = 'signup'").orderBy(F.col("ts").desc(), "event_id").limit(50).groupBy("day").agg(F.count(F.lit(1)).alias("latest"))
    return days.join(last, "day", "left").select("day", "n", F.coalesce("latest", F.lit(0)).alias("latest")).orderBy("day")


@query("SELECT CAST(json_extract_string(props, '$.k') AS INT) % 7 AS token, count(*) AS received FROM events GROUP BY 1")
def alert_reception(spark, sf_dir):
    """SNK-22, AGG-20, SCA-49: counts by a token inside JSON."""
    token = F.get_json_object("props", "$.k").try_cast("int") % 7
    return table(spark, sf_dir, "events").groupBy(token.alias("token")).agg(F.count(F.lit(1)).alias("received"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1 AND ts >= TIMESTAMP '2024-01-03 00:00:00'")
def notify_once(spark, sf_dir):
    """SCH-09, §2.8: what was not told before, first come first served."""
    df = table(spark, sf_dir, "events")
    cut = F.expr("timestamp_ntz '2024-01-03 00:00:00'")
    told = df.filter(F.col("ts") < cut).select("user_id", "event_type").distinct()
    fresh = df.filter(F.col("ts") >= cut).join(told, ["user_id", "event_type"], "left_anti")
    first = fresh.groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    return first.select("user_id", "event_id")


@query("SELECT date_trunc('hour', ts) AS h, user_id, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1".replace("date_trunc('hour', ts) AS h", "strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS h"))
def fixed_window_limiter(spark, sf_dir):
    """SCH-06: requests in a fixed hour over the limit."""
    df = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return df.filter("n > 1").select(F.date_format("w.start", "yyyy-MM-dd HH").alias("h"), "user_id", "n")

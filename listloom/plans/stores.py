"""Store queries: listings, user states, ids, gaps, runs, contact guards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from listloom.catalogue import query
from listloom.operators import filters, stores
from listloom.sources.views import table, view, with_views

#: Stored listings, the new groups, and whom these hold: some stored ones are no group any more.
GROUPS = """
old AS (SELECT o_orderkey AS id, 'stored ' || CAST(o_orderkey % 7 AS VARCHAR(9)) AS title FROM orders WHERE o_orderkey % 2 = 0),
members AS (SELECT o_orderkey AS occurrence_id, CASE WHEN o_orderkey % 6 = 4 THEN o_orderkey - 2 ELSE o_orderkey END AS id
  FROM orders WHERE o_orderkey % 10 <> 0),
fresh AS (SELECT DISTINCT id, 'group ' || CAST(id % 5 AS VARCHAR(9)) AS title FROM members)
"""


def _groups(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    old = o.filter("o_orderkey % 2 = 0").selectExpr("o_orderkey AS id", "concat('stored ', o_orderkey % 7) AS title")
    members = o.filter("o_orderkey % 10 <> 0").selectExpr(
        "o_orderkey AS occurrence_id", "CASE WHEN o_orderkey % 6 = 4 THEN o_orderkey - 2 ELSE o_orderkey END AS id"
    )
    groups = members.select("id").distinct().selectExpr("id", "concat('group ', id % 5) AS title")
    state = view(spark, sf_dir, "user_state").withColumnRenamed("acted_at", "notified_at")
    return stores.upsert_listings(old, groups, members, state)


RANK = "list_position(['new', 'ignored', 'rejected', 'toContact', 'contacted', 'replied', 'visitOffered', 'visitScheduled', 'visited', 'rented'], coalesce(tracking, 'new'))"
UPSERT = (
    "WITH " + GROUPS.strip() + f""",
moved AS (SELECT g.id, m.id AS successor FROM (SELECT id FROM old EXCEPT SELECT id FROM fresh) g LEFT JOIN members m ON m.occurrence_id = g.id),
handed AS (SELECT coalesce(m.successor, s.id) AS id, user_id, viewed, favorite, archived, tracking, acted_at FROM user_state s LEFT JOIN moved m ON m.id = s.id),
states AS (SELECT id, user_id, bool_or(viewed) AS viewed, bool_or(favorite) AS favorite, bool_or(archived) AS archived,
  arg_max(coalesce(tracking, 'new'), {RANK}) AS tracking, min(acted_at) AS notified_at FROM handed GROUP BY id, user_id),
kept AS (SELECT old.* FROM old JOIN moved USING (id) WHERE successor IS NULL
  AND id IN (SELECT id FROM states WHERE favorite OR archived OR tracking <> 'new')),
listings_now AS (SELECT id, title FROM fresh UNION ALL SELECT id, title FROM kept)
"""
)


@query(with_views(UPSERT + "SELECT id, title FROM listings_now", "user_state"))
def listing_upsert(spark, sf_dir):
    """SNK-03, SNK-05: new groups, and stored listings without one that somebody has decided on."""
    return _groups(spark, sf_dir)[0]


@query(with_views(UPSERT + "SELECT id, user_id, viewed, favorite, archived, tracking, notified_at FROM states WHERE id IN (SELECT id FROM listings_now)", "user_state"))
def listing_upsert_states(spark, sf_dir):
    """SNK-03, SNK-04: the states that listings inherit when groups change."""
    return _groups(spark, sf_dir)[2]


@query(with_views("""SELECT coalesce(s.id, c.id) AS id, coalesce(s.user_id, c.user_id) AS user_id, coalesce(c.favorite, s.favorite) AS favorite,
 coalesce(c.tracking, s.tracking) AS tracking, coalesce(s.notified_at, c.notified_at) AS notified_at
FROM (SELECT id, user_id, favorite, tracking, CASE WHEN id % 3 = 0 THEN acted_at END AS notified_at FROM user_state WHERE id % 4 <> 1) s
FULL JOIN (SELECT id, user_id, CASE WHEN id % 5 = 0 THEN NOT favorite END AS favorite, CASE WHEN id % 2 = 0 THEN 'replied' END AS tracking,
  TIMESTAMP '2024-01-01 00:00:00' AS notified_at FROM user_state WHERE id % 7 < 5) c ON s.id = c.id AND s.user_id = c.user_id""", "user_state"))  # fmt: skip
def state_upsert(spark, sf_dir):
    """SNK-15: changes over what is stored; the first notification stays."""
    s = view(spark, sf_dir, "user_state")
    old = s.filter("id % 4 <> 1").selectExpr("id", "user_id", "favorite", "tracking", "CASE WHEN id % 3 = 0 THEN acted_at END AS notified_at")
    new = s.filter("id % 7 < 5").selectExpr(
        "id", "user_id", "CASE WHEN id % 5 = 0 THEN NOT favorite END AS favorite", "CASE WHEN id % 2 = 0 THEN 'replied' END AS tracking",
        "timestamp '2024-01-01 00:00:00' AS notified_at",
    )
    return stores.upsert_state(old, new)


@query(with_views("""WITH r AS (SELECT id AS k, CASE WHEN id % 5 = 0 THEN 'old-' || id WHEN id % 11 = 1 THEN source_id || ':' || (id - 1) ELSE source_id || ':' || source_ref END AS id,
  source_id, CASE WHEN id % 11 = 1 THEN CAST(id - 1 AS VARCHAR(12)) ELSE source_ref END AS source_ref FROM occurrences),
w AS (SELECT *, source_id || ':' || source_ref AS natural_id, row_number() OVER (PARTITION BY source_id || ':' || source_ref ORDER BY id) AS place FROM r)
SELECT k, CASE WHEN natural_id NOT IN (SELECT id FROM r) AND place = 1 THEN natural_id ELSE id END AS id FROM w""", "occurrences"))  # fmt: skip
def realigned_ids(spark, sf_dir):
    """SNK-19: ids of source and reference, unless taken."""
    rows = view(spark, sf_dir, "occurrences").selectExpr(
        "id AS k", "CASE WHEN id % 5 = 0 THEN concat('old-', id) WHEN id % 11 = 1 THEN concat(source_id, ':', id - 1) ELSE concat(source_id, ':', source_ref) END AS id",
        "source_id", "CASE WHEN id % 11 = 1 THEN cast(id - 1 AS string) ELSE source_ref END AS source_ref",
    )
    return stores.realigned(rows).select("k", "id")


@query(with_views("""SELECT id, coalesce(charges, CASE WHEN id % 2 = 0 THEN 55.0::DOUBLE END) AS charges, coalesce(address, CASE WHEN id % 3 = 0 THEN '1 rue Neuve' END) AS address,
 coalesce(rooms, CASE WHEN id % 2 = 0 THEN 2 END)::INT AS rooms FROM occurrences""", "occurrences"))  # fmt: skip
def refilled_fields(spark, sf_dir):
    """SNK-20: what was derived anew fills gaps only."""
    rows = view(spark, sf_dir, "occurrences").select("id", "charges", "address", "rooms")
    again = rows.selectExpr(
        "id", "CASE WHEN id % 2 = 0 THEN 55.0D END AS charges", "CASE WHEN id % 3 = 0 THEN '1 rue Neuve' END AS address", "CASE WHEN id % 2 = 0 THEN 2 END AS rooms"
    )
    return stores.refilled(rows, again, "id", ["charges", "address", "rooms"])


RUNS = """runs AS (SELECT 's' || CAST(user_id % 13 AS VARCHAR(9)) AS source_id, CAST(ts AS TIMESTAMP) AS ran_at, event_type <> 'error' AND user_id % 13 <> 4 AS ok, CAST(event_id % 50 AS INT) AS found
  FROM events WHERE user_id % 13 > 1),
old AS (SELECT 's' || CAST(n_nationkey % 13 AS VARCHAR(9)) AS source_id, TIMESTAMP '2023-12-01 00:00:00' AS last_run, TIMESTAMP '2023-11-30 00:00:00' AS last_success,
  CAST(n_nationkey % 3 AS INT) AS errors, CAST(n_nationkey AS INT) AS found FROM nation WHERE n_nationkey < 13 AND n_nationkey % 2 = 0)"""


@query(f"""WITH {RUNS}, n AS (SELECT source_id, max(ran_at) AS run_at, max(ran_at) FILTER (ok) AS ok_at, arg_max(found, ran_at) FILTER (ok) AS found_now FROM runs GROUP BY source_id),
f AS (SELECT source_id, count(*) AS failed FROM runs JOIN n USING (source_id) WHERE ok_at IS NULL OR ran_at > ok_at GROUP BY source_id)
SELECT source_id, greatest(last_run, run_at) AS last_run, greatest(last_success, ok_at) AS last_success,
 (CASE WHEN ok_at IS NULL THEN coalesce(errors, 0) ELSE 0 END + coalesce(failed, 0))::INT AS errors, coalesce(found_now, found) AS found
FROM old FULL JOIN (n LEFT JOIN f USING (source_id)) USING (source_id)""")  # fmt: skip
def source_runs(spark, sf_dir):
    """SNK-21: source states after the runs of a log."""
    runs = table(spark, sf_dir, "events").filter("user_id % 13 > 1").selectExpr(
        "concat('s', user_id % 13) AS source_id", "cast(ts AS timestamp) AS ran_at", "event_type <> 'error' AND user_id % 13 <> 4 AS ok", "cast(event_id % 50 AS int) AS found"
    )
    old = table(spark, sf_dir, "nation").filter("n_nationkey < 13 and n_nationkey % 2 = 0").selectExpr(
        "concat('s', n_nationkey % 13) AS source_id", "timestamp '2023-12-01 00:00:00' AS last_run", "timestamp '2023-11-30 00:00:00' AS last_success",
        "cast(n_nationkey % 3 AS int) AS errors", "cast(n_nationkey AS int) AS found",
    )
    return stores.source_states(old, runs)


#: One attempt to write to each source of a user: what each guard looks at.
ATTEMPTS = """SELECT event_id, user_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS s, event_id % 17 AS source, event_id % 400 AS listing,
 user_id % 9 <> 0 AS paid, user_id % 10 <> 1 AS enabled, CAST(event_id * 7 % 101 AS INT) AS match, CAST(event_id * 5 % 101 AS INT) AS opportunity,
 CAST(event_id * 3 % 101 AS INT) AS visit, CAST(event_id * 11 % 101 AS INT) AS risk, event_id % 6 <> 0 AS channel FROM events"""
ATTEMPTS_SPARK = ATTEMPTS.replace("epoch_us(ts) // 1000000", "unix_timestamp(cast(ts AS timestamp))").replace("FROM events", "FROM {e}")


@query(f"""WITH a AS ({ATTEMPTS}), c AS (SELECT *,
 count(*) OVER (PARTITION BY user_id, listing ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
 count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 3599 PRECEDING AND 1 PRECEDING) AS hour,
 count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86399 PRECEDING AND 1 PRECEDING) AS day,
 count(*) OVER (PARTITION BY user_id, source ORDER BY s RANGE BETWEEN 86399 PRECEDING AND 1 PRECEDING) AS own,
 count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 299 PRECEDING AND 1 PRECEDING) AS lately FROM a)
SELECT event_id, CASE WHEN NOT paid THEN 'plan' WHEN NOT enabled THEN 'switch' WHEN source = 16 THEN 'manual' WHEN before > 0 THEN 'contacted'
 WHEN match < 20 THEN 'match' WHEN opportunity < 15 THEN 'opportunity' WHEN visit < 10 THEN 'visit' WHEN risk > 80 THEN 'risk'
 WHEN hour >= 3 THEN 'hour' WHEN day >= 8 THEN 'day' WHEN own >= 2 THEN 'source' WHEN lately > 0 THEN 'cooldown' WHEN NOT channel THEN 'channel' ELSE 'allowed' END AS reason FROM c""")  # fmt: skip
def contact_guards(spark, sf_dir):
    """FLT-19: the whole chain in order; the first guard that fails gives the reason. Every event counts as an attempt."""
    a = spark.sql(ATTEMPTS_SPARK, e=table(spark, sf_dir, "events"))

    def within(seconds: int, *keys: str):
        return F.count(F.lit(1)).over(Window.partitionBy("user_id", *keys).orderBy("s").rangeBetween(1 - seconds, -1))

    earlier = Window.partitionBy("user_id", "listing").orderBy("s", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    limits = filters.ContactLimits(match=20, opportunity=15, visit=10, risk=80, per_hour=3, per_day=8, per_source=2)
    counted = a.withColumns({
        "manual": F.col("source") == 16, "before": F.count(F.lit(1)).over(earlier), "hour": within(3600), "day": within(86400),
        "own": within(86400, "source"), "lately": within(300),
    })
    return counted.select("event_id", F.coalesce(filters.contact_refusal(limits), F.lit("allowed")).alias("reason"))


@query("""SELECT coalesce(o.token, n.token) AS token, (coalesce(o.received, 0) + coalesce(n.received, 0))::BIGINT AS received
FROM (SELECT 't' || n_nationkey AS token, 10 * n_nationkey AS received FROM nation WHERE n_nationkey % 3 = 0) o
FULL JOIN (SELECT 't' || (user_id % 25) AS token, count(*) AS received FROM events WHERE event_type = 'signup' GROUP BY 1) n USING (token)""")
def alert_counters(spark, sf_dir):
    """SNK-22: receptions of a batch added to the stored counters."""
    old = table(spark, sf_dir, "nation").filter("n_nationkey % 3 = 0").selectExpr("concat('t', n_nationkey) AS token", "10 * n_nationkey AS received")
    new = table(spark, sf_dir, "events").filter("event_type = 'signup'").selectExpr("concat('t', user_id % 25) AS token", "1L AS received")
    return old.unionByName(new).groupBy("token").agg(F.sum("received").cast("long").alias("received"))


@query(with_views("""SELECT source_id, id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY CASE lifecycle WHEN 'active' THEN 1 WHEN 'possiblyInactive' THEN 2 WHEN 'inactive' THEN 3 ELSE 4 END,
 last_seen DESC, id) AS INT) AS place FROM occurrences""", "occurrences"))  # fmt: skip
def source_page_order(spark, sf_dir):
    """SRT-09: a source's page, what lives first."""
    w = Window.partitionBy("source_id").orderBy(stores.by_lifecycle(F.col("lifecycle")), F.desc("last_seen"), "id")
    return view(spark, sf_dir, "occurrences").select("source_id", "id", F.row_number().over(w).alias("place"))

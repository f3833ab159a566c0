"""Statistics: conditional counts, group counts, coverage, agencies, survival."""

from __future__ import annotations

from pyspark.sql import functions as F

from listloom.catalogue import query
from listloom.operators import timelines
from listloom.sources.views import table, view, with_views


@query(
    with_views(
        """SELECT count(*) AS total, count(*) FILTER (lifecycle = 'active') AS active,
count(*) FILTER (lifecycle = 'possiblyInactive') AS uncertain, count(*) FILTER (lifecycle = 'inactive') AS gone,
count(DISTINCT source_id) FILTER (lifecycle <> 'inactive') AS active_sources FROM occurrences""",
        "occurrences",
    )
)
def stats_conditional_counts(spark, sf_dir):
    """AGG-01, AGG-07: all in one pass."""
    life = F.col("lifecycle")
    return view(spark, sf_dir, "occurrences").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(life == "active").alias("active"),
        F.count_if(life == "possiblyInactive").alias("uncertain"),
        F.count_if(life == "inactive").alias("gone"),
        F.countDistinct(F.when(life != "inactive", F.col("source_id"))).alias("active_sources"),
    )


@query(
    with_views(
        """SELECT coalesce(tracking, 'new') AS tracking, count(*) AS n, sum(CASE WHEN viewed THEN 1 ELSE 0 END)::BIGINT AS viewed
FROM user_state JOIN (SELECT id, user_id FROM user_score WHERE matches) m USING (id, user_id) GROUP BY 1""",
        "user_state", "user_score",
    )
)
def stats_by_tracking(spark, sf_dir):
    """AGG-02, AGG-03: engagement on the user's own matches, grouped by an expression."""
    own = view(spark, sf_dir, "user_score").filter("matches").select("id", "user_id")
    return (
        view(spark, sf_dir, "user_state").join(own, ["id", "user_id"])
        .groupBy(F.coalesce("tracking", F.lit("new")).alias("tracking"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("viewed").cast("int")).alias("viewed"))
    )


@query(
    with_views(
        """SELECT agency, count(DISTINCT group_id) AS listings, max(price) AS max_price,
string_agg(DISTINCT city, ',' ORDER BY city) AS cities FROM occurrences WHERE agency IS NOT NULL AND landlord = 'agency' GROUP BY agency""",
        "occurrences",
    )
)
def agencies_summary(spark, sf_dir):
    """AGG-04: distinct count, maximum and sorted distinct concatenation."""
    df = view(spark, sf_dir, "occurrences").filter("agency is not null and landlord = 'agency'")
    return df.groupBy("agency").agg(
        F.countDistinct("group_id").alias("listings"),
        F.max("price").alias("max_price"),
        F.array_join(F.array_sort(F.collect_set("city")), ",").alias("cities"),
    ).withColumn("cities", F.nullif("cities", F.lit("")))


@query(
    """SELECT s_name, count(DISTINCT p.p_partkey) AS parts, count(*) AS sightings, max(p_retailprice) AS max_price
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY s_name"""
)
def agency_listings(spark, sf_dir):
    """JON-04: three tables; the grouping key is made before the wide side is joined."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    # Pairs first: a pair of agency and listing is joined once however often it was seen.
    pairs = lines.groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("k"))
    return pairs.join(parts, "l_partkey").join(names, "l_suppkey").groupBy("s_name").agg(
        F.countDistinct("l_partkey").alias("parts"), F.sum("k").alias("sightings"), F.max("p_retailprice").alias("max_price")
    )


@query(
    with_views(
        """SELECT property_type, count(*) AS n, sum(CASE WHEN price IS NULL THEN 1 ELSE 0 END)::BIGINT AS no_price,
sum(CASE WHEN area IS NULL THEN 1 ELSE 0 END)::BIGINT AS no_area, sum(CASE WHEN district IS NULL AND city IS NULL THEN 1 ELSE 0 END)::BIGINT AS no_place,
count(DISTINCT city) AS cities, sum(CASE WHEN flat_share IS NULL THEN 1 ELSE 0 END)::BIGINT AS share_unknown,
round(avg(CASE WHEN phone IS NOT NULL OR email IS NOT NULL THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS reachable
FROM occurrences GROUP BY property_type""",
        "occurrences",
    )
)
def data_quality_audit(spark, sf_dir):
    """AGG-27: coverage of fields."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return view(spark, sf_dir, "occurrences").groupBy("property_type").agg(
        F.count(F.lit(1)).alias("n"),
        n(F.col("price").isNull()).alias("no_price"),
        n(F.col("area").isNull()).alias("no_area"),
        n(F.col("district").isNull() & F.col("city").isNull()).alias("no_place"),
        F.countDistinct("city").alias("cities"),
        n(F.col("flat_share").isNull()).alias("share_unknown"),
        F.round(F.avg(F.when(F.col("phone").isNotNull() | F.col("email").isNotNull(), 1.0).otherwise(0.0)), 6).alias("reachable"),
    )


@query(
    with_views(
        """SELECT source_id, count(*) AS bad FROM occurrences WHERE price IS NULL OR area IS NULL GROUP BY source_id
ORDER BY bad DESC, source_id LIMIT 8""",
        "occurrences",
    )
)
def worst_sources(spark, sf_dir):
    """AGG-27: the eight sources with most gaps."""
    df = view(spark, sf_dir, "occurrences").filter("price is null or area is null")
    return df.groupBy("source_id").agg(F.count(F.lit(1)).alias("bad")).orderBy(F.col("bad").desc(), "source_id").limit(8)


@query(
    with_views(
        """SELECT user_id, round(count(*) FILTER (tracking IN ('visited', 'rejected')) / nullif(count(*) FILTER (tracking <> 'new'), 0), 6)::DOUBLE AS response_rate,
round(count(*) FILTER (tracking = 'visited') / nullif(count(*) FILTER (tracking <> 'new'), 0), 6)::DOUBLE AS visit_rate FROM user_state GROUP BY user_id""",
        "user_state",
    )
)
def contact_rates(spark, sf_dir):
    """AGG-24: null without a contact."""
    t = F.col("tracking")
    tried = F.count_if(t != "new")
    rate = lambda ok: F.round(F.try_divide(F.count_if(ok), tried), 6)
    return view(spark, sf_dir, "user_state").groupBy("user_id").agg(
        rate(t.isin("visited", "rejected")).alias("response_rate"), rate(t == "visited").alias("visit_rate")
    )


@query(
    with_views(
        """SELECT count(*) FILTER (first_seen >= TIMESTAMP '2024-03-20 00:00:00' - INTERVAL '48' HOUR) AS fresh,
count(*) FILTER (price <= 920 AND coalesce(s.tracking, 'new') = 'new') AS hot, count(*) FILTER (coalesce(s.favorite, false)) AS favorites,
count(*) FILTER (coalesce(s.favorite, false) AND coalesce(s.tracking, 'new') = 'new') AS untouched
FROM listings l LEFT JOIN (SELECT * FROM user_state WHERE user_id = 1) s ON l.id = s.id""",
        "listings", "user_state",
    )
)
def home_tiles(spark, sf_dir):
    """AGG-25, AGG-26."""
    own = view(spark, sf_dir, "user_state").filter("user_id = 1").select("id", "favorite", "tracking")
    df = view(spark, sf_dir, "listings").join(own, "id", "left")
    new = F.coalesce("tracking", F.lit("new")) == "new"
    liked = F.coalesce("favorite", F.lit(False))
    return df.agg(
        F.count_if(F.col("first_seen") >= F.lit("2024-03-18 00:00:00").cast("timestamp")).alias("fresh"),
        F.count_if((F.col("price") <= 920) & new).alias("hot"),
        F.count_if(liked).alias("favorites"),
        F.count_if(liked & new).alias("untouched"),
    )


COHORT = """
WITH rows AS (SELECT * FROM occurrences WHERE source_id NOT IN ('s3', 's9')),
starts AS (SELECT source_id, min(first_seen) AS source_start FROM rows GROUP BY source_id),
batches AS (SELECT source_id, first_seen, count(*) AS batch FROM rows GROUP BY source_id, first_seen),
stock AS (
  SELECT DISTINCT group_id, first_seen AS born FROM rows JOIN starts USING (source_id) JOIN batches USING (source_id, first_seen)
  WHERE epoch_us(first_seen) - epoch_us(source_start) <= 86400000000 OR batch > 3),
life AS (
  SELECT group_id, (epoch_us(last) - epoch_us(born)) / 86400e6 AS days, ended = 1 AS ended FROM (
    SELECT group_id, min(first_seen) AS born, max(last_seen) AS last, min(CASE WHEN lifecycle = 'inactive' THEN 1 ELSE 0 END) AS ended
    FROM rows GROUP BY group_id) g ANTI JOIN stock USING (group_id, born))
"""
CURVE = """, days AS (SELECT days, count(*) AS n, count(*) FILTER (ended) AS deaths FROM life WHERE days >= 0 GROUP BY days),
risk AS (SELECT *, sum(n) OVER (ORDER BY days DESC) AS at_risk FROM days),
curve AS (SELECT days AS day, at_risk, deaths, product(1 - deaths / at_risk) OVER (ORDER BY days) AS share FROM risk WHERE deaths > 0)
"""


def _cohort(spark, sf_dir):
    return timelines.cohort(view(spark, sf_dir, "occurrences"), ["s3", "s9"], stock_batch=3)


@query(with_views(COHORT + "SELECT group_id, days::DOUBLE AS days, ended FROM life", "occurrences"))
def survival_cohort(spark, sf_dir):
    """AGG-09, AGG-10, JON-08, SCA-50."""
    return _cohort(spark, sf_dir)


@query(with_views(COHORT + CURVE + "SELECT day::DOUBLE AS day, at_risk::BIGINT AS at_risk, deaths, round(share, 6) AS share FROM curve", "occurrences"))
def survival_curve(spark, sf_dir):
    """AGG-11."""
    curve = timelines.survival_curve(_cohort(spark, sf_dir))
    return curve.withColumn("share", F.round("share", 6))


@query(
    with_views(
        COHORT + CURVE + """
SELECT (SELECT min(day) FROM curve WHERE share <= 0.5)::DOUBLE AS median, max(days)::DOUBLE AS horizon, count(*) FILTER (ended) AS completed,
  count(*) FILTER (NOT ended) AS censored, count(*) FILTER (days >= 1) AS at_risk_1, count(*) FILTER (days >= 3) AS at_risk_3,
  count(*) FILTER (days >= 7) AS at_risk_7,
  round(CASE WHEN max(days) >= 1 THEN coalesce((SELECT max_by(share, day) FROM curve WHERE day <= 1), 1) END, 6)::DOUBLE AS alive_1,
  round(CASE WHEN max(days) >= 3 THEN coalesce((SELECT max_by(share, day) FROM curve WHERE day <= 3), 1) END, 6)::DOUBLE AS alive_3,
  round(CASE WHEN max(days) >= 7 THEN coalesce((SELECT max_by(share, day) FROM curve WHERE day <= 7), 1) END, 6)::DOUBLE AS alive_7
FROM life WHERE days >= 0""",
        "occurrences",
    )
)
def survival_alive_after(spark, sf_dir):
    """AGG-12, AGG-13."""
    life = _cohort(spark, sf_dir)
    out = timelines.survival_summary(life, timelines.survival_curve(life))
    return out.withColumns({f"alive_{m}": F.round(f"alive_{m}", 6) for m in (1, 3, 7)})


@query(
    """WITH RECURSIVE d AS (
  SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY m) AS k, n FROM (
    SELECT l_suppkey, date_trunc('month', l_shipdate) AS m, count(*) AS n FROM lineitem GROUP BY ALL)),
e AS (SELECT l_suppkey, k, n::DOUBLE AS v FROM d WHERE k = 1
  UNION ALL SELECT d.l_suppkey, d.k, floor((0.7::DOUBLE * e.v + (1 - 0.7::DOUBLE) * d.n) * 100 + 0.5::DOUBLE) / 100 FROM e JOIN d ON d.l_suppkey = e.l_suppkey AND d.k = e.k + 1)
SELECT l_suppkey, max_by(v, k) AS average FROM e GROUP BY l_suppkey"""
)
def ema_by_source(spark, sf_dir):
    """AGG-19: an ordered fold over monthly counts."""
    monthly = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.trunc("l_shipdate", "month").alias("m")).agg(
        F.count(F.lit(1)).cast("double").alias("n")
    )
    ordered = monthly.groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.struct("m", "n"))).alias("x"))
    return ordered.select("l_suppkey", timelines.moving_average(F.transform("x", lambda s: s["n"])).alias("average"))

"""Shown values and the smaller overlays: formats, lookups in turn, revival, announced prices, tiles, viewers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from listloom.catalogue import query
from listloom.functions import formats
from listloom.sources.views import table, view, with_views
from listloom.streaming.cycle import history_kind

NOW = "2000-06-01 12:00:00"


def _words(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


@query(with_views(f"""SELECT id, CASE WHEN rooms IS NULL THEN 'inconnu' WHEN rooms = 1 THEN '1 pièce' ELSE rooms || ' pièces' END AS rooms,
 CASE WHEN available_at <= TIMESTAMP '{NOW}' + INTERVAL '3' DAY THEN 'Dispo maintenant' WHEN available_at IS NOT NULL THEN concat_ws(' ', 'Dispo', day(available_at), {_words(formats.SHORT_MONTHS)}[month(available_at)],
  CASE WHEN year(available_at) <> 2000 THEN year(available_at)::VARCHAR END) END AS free,
 CASE WHEN first_seen::DATE = DATE '2000-06-01' THEN 'Aujourd''hui' WHEN first_seen::DATE = DATE '2000-05-31' THEN 'Hier'
  ELSE concat_ws(' ', {_words(formats.WEEKDAYS)}[dayofweek(first_seen) + 1], day(first_seen), {_words(formats.MONTHS)}[month(first_seen)]) END AS day,
 strftime(first_seen, '%H:%M') AS time, CASE source_id WHEN 's1' THEN 'First Source' ELSE upper(source_id) END AS source,
 CASE WHEN address IS NULL THEN 'inconnu' ELSE regexp_replace(replace(address, 'rue haute', 'Rue Haute'), ' +', ' ', 'g') END AS address, coalesce(district, 'inconnu') AS district, 'tel:' || phone AS tel FROM occurrences""", "occurrences"))  # fmt: skip
def shown_values(spark, sf_dir):
    """SCA-43: rooms, availability, day, time, source, address, district and phone link of every ad."""
    now, c = F.lit(NOW).cast("timestamp"), F.col
    return view(spark, sf_dir, "occurrences").select(
        "id", formats.format_rooms(c("rooms")).alias("rooms"), formats.format_availability(c("available_at"), now).alias("free"), formats.format_day(c("first_seen"), now).alias("day"),
        formats.format_time(c("first_seen")).alias("time"), formats.format_source_name(c("source_id"), {"s1": "First Source"}).alias("source"),
        formats.format_address(c("address")).alias("address"), formats.format_district(c("district")).alias("district"), formats.tel_link(c("phone")).alias("tel"),
    )


@query(with_views("""WITH o AS (SELECT s_suppkey AS office, 'REF-' || (s_suppkey * 7 % 900) AS reference, 'agency ' || (s_suppkey % 60) AS agency, 'u' || (s_suppkey * 3 % 900) || '@mail.test' AS email FROM supplier),
r AS (SELECT reference, min(office) AS office FROM o GROUP BY 1), a AS (SELECT agency, min(office) AS office FROM o GROUP BY 1), e AS (SELECT email, min(office) AS office FROM o GROUP BY 1)
SELECT id, coalesce(r.office, a.office, e.office) AS office, CASE WHEN r.office IS NOT NULL THEN 'reference' WHEN a.office IS NOT NULL THEN 'agency' WHEN e.office IS NOT NULL THEN 'contact' END AS found_by
FROM occurrences LEFT JOIN r USING (reference) LEFT JOIN a USING (agency) LEFT JOIN e USING (email)""", "occurrences"))  # fmt: skip
def office_lookup(spark, sf_dir):
    """SRC-33: the office of an ad by its reference, else its agency, else its contact; each key names one office, so no ad
    is doubled."""
    o = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS office", "concat('REF-', s_suppkey * 7 % 900) AS reference", "concat('agency ', s_suppkey % 60) AS agency", "concat('u', s_suppkey * 3 % 900, '@mail.test') AS email"
    )
    found = view(spark, sf_dir, "occurrences").select("id", "reference", "agency", "email")
    keys = {"reference": "reference", "agency": "agency", "email": "contact"}
    for key in keys:
        found = found.join(o.groupBy(key).agg(F.min("office").alias(f"by_{key}")), key, "left")
    by = {key: F.col(f"by_{key}") for key in keys}
    return found.select("id", F.coalesce(*by.values()).alias("office"), F.coalesce(*[F.when(c.isNotNull(), keys[k]) for k, c in by.items()]).alias("found_by"))


@query(with_views("""WITH seen AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-06-01 00:00:00')
SELECT id, lifecycle AS was, CASE WHEN s.id IS NOT NULL THEN 'active' ELSE lifecycle END AS lifecycle, CASE WHEN s.id IS NOT NULL THEN 0 ELSE missing END AS missing
FROM (SELECT *, CASE lifecycle WHEN 'active' THEN 0 WHEN 'possiblyInactive' THEN 2 ELSE 3 END AS missing FROM occurrences) o LEFT JOIN seen s USING (id)""", "occurrences"))  # fmt: skip
def confirmed_refs(spark, sf_dir):
    """SNK-11: what a run has confirmed is active again and misses no run, whatever it was; the rest stays as it was."""
    seen = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") >= F.expr("timestamp_ntz '2000-06-01 00:00:00'")).select(F.col("l_orderkey").alias("id")).distinct()
    was = F.col("lifecycle")
    missed = F.when(was == "active", 0).when(was == "possiblyInactive", 2).otherwise(3)
    both = view(spark, sf_dir, "occurrences").select("id", "lifecycle").join(seen.withColumn("seen", F.lit(True)), "id", "left")
    return both.select("id", was.alias("was"), F.when(F.col("seen"), "active").otherwise(was).alias("lifecycle"), F.when(F.col("seen"), 0).otherwise(missed).alias("missing"))


@query(
    """WITH v AS (SELECT user_id, event_id, ts, CASE WHEN event_id % 11 = 0 THEN NULL ELSE round(value) END AS price, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 2 END AS area,
 CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 2 END AS free, CASE WHEN event_id % 4 = 0 THEN round(value) + event_id % 3 - 1 END AS announced FROM events WHERE event_type = 'view'),
p AS (SELECT *, lag(price) OVER w AS p0, lag(area) OVER w AS a0, lag(free) OVER w AS f0, row_number() OVER w AS k FROM v WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
d AS (SELECT *, (p0 IS DISTINCT FROM price)::INT AS dp, (a0 IS DISTINCT FROM area)::INT AS da, (f0 IS DISTINCT FROM free)::INT AS df FROM p),
h AS (SELECT event_id, CASE WHEN k = 1 THEN CASE WHEN announced > price THEN 'price-drop' ELSE 'baseline' END WHEN dp + da + df > 1 THEN 'multiple'
 WHEN dp = 1 THEN CASE WHEN price < p0 THEN 'price-drop' ELSE 'price-rise' END WHEN da = 1 THEN 'area' WHEN df = 1 THEN 'availability' END AS change FROM d)
SELECT * FROM h WHERE change IS NOT NULL"""
)
def announced_history(spark, sf_dir):
    """SNK-12: changes of price, area and availability; a first sight that announces a former, higher price is a drop."""
    v = table(spark, sf_dir, "events").filter("event_type = 'view'").selectExpr(
        "user_id", "event_id", "ts", "CASE WHEN event_id % 11 = 0 THEN NULL ELSE round(value) END AS price", "CASE WHEN event_id % 3 = 0 THEN 1 ELSE 2 END AS area",
        "CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 2 END AS available_at", "CASE WHEN event_id % 4 = 0 THEN round(value) + event_id % 3 - 1 END AS announced",
    )
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    facts = ("price", "area", "available_at")
    kind = history_kind(F.row_number().over(w) > 1, {c: F.lag(c).over(w) for c in facts}, {c: F.col(c) for c in facts}, F.col("announced"))
    return v.select("event_id", kind.alias("change")).filter("change is not null")


@query(with_views("""SELECT user_id, count(*) FILTER (first_seen >= TIMESTAMP '2024-03-18 00:00:00') AS fresh, count(*) FILTER (match >= 85 AND coalesce(tracking, 'new') = 'new') AS hot,
 count(*) FILTER (coalesce(favorite, false)) AS favorites, count(*) FILTER (coalesce(favorite, false) AND coalesce(tracking, 'new') = 'new') AS untouched,
 count(*) FILTER (lifecycle = 'active' AND price <= 900 + user_id * 2) AS saved_matches,
 (SELECT count(*) FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS latest FROM events GROUP BY 1) WHERE latest = 'error') AS ailing
FROM user_score JOIN listings USING (id) LEFT JOIN user_state USING (id, user_id) GROUP BY user_id""", "user_score", "listings", "user_state"))  # fmt: skip
def user_tiles(spark, sf_dir):
    """AGG-25, AGG-26: every user's tiles, with the matches of the saved search and the ailing sources, those whose latest
    run failed; one pass over the user's rows."""
    scores = view(spark, sf_dir, "user_score").select("id", "user_id", "match")
    listings = view(spark, sf_dir, "listings").select("id", "price", "first_seen", "lifecycle")
    states = view(spark, sf_dir, "user_state").select("id", "user_id", "favorite", "tracking")
    df = scores.join(listings, "id").join(states, ["id", "user_id"], "left")
    runs = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("latest"))
    ailing = runs.agg(F.count_if(F.col("latest") == "error").alias("ailing"))
    new = F.coalesce("tracking", F.lit("new")) == "new"
    liked = F.coalesce("favorite", F.lit(False))
    tiles = df.groupBy("user_id").agg(
        F.count_if(F.col("first_seen") >= F.lit("2024-03-18 00:00:00").cast("timestamp")).alias("fresh"), F.count_if((F.col("match") >= 85) & new).alias("hot"),
        F.count_if(liked).alias("favorites"), F.count_if(liked & new).alias("untouched"),
        F.count_if((F.col("lifecycle") == "active") & (F.col("price") <= 900 + F.col("user_id") * 2)).alias("saved_matches"),
    )
    return tiles.withColumn("ailing", ailing.scalar())


@query(with_views("""SELECT s.id, s.user_id AS viewer, CASE WHEN s.user_id = l.id % 50 THEN commute END AS shown FROM user_score s JOIN listings l ON l.id = s.id
WHERE lifecycle IN ('active', 'possiblyInactive')""", "user_score", "listings"))  # fmt: skip
def viewer_projection(spark, sf_dir):
    """FLT-16: each viewer's rows; distances belong to one account and are null for every other viewer."""
    df = view(spark, sf_dir, "listings").filter(F.col("lifecycle").isin("active", "possiblyInactive")).select("id", "commute")
    seen = view(spark, sf_dir, "user_score").select("id", F.col("user_id").alias("viewer")).join(df, "id")
    return seen.select("id", "viewer", F.when(F.col("viewer") == F.col("id") % 50, F.col("commute")).alias("shown"))

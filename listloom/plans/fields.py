"""Further queries over fields, overlays and sinks: places, formats, tokens, alerts, planning inputs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from listloom.catalogue import query
from listloom.functions import geo, listing, parse, text
from listloom.operators import filters, lists
from listloom.sources import registry
from listloom.sources.views import table, view, with_views


@query(
    """WITH t AS (SELECT p_partkey, p_partkey % 6 AS k, 20 + p_partkey % 80 AS charges FROM part)
SELECT p_partkey, CASE WHEN k < 3 THEN charges::DOUBLE END AS charges, CASE WHEN k = 1 THEN true WHEN k = 2 THEN false END AS flat_share,
 k = 4 AS student, CASE k WHEN 0 THEN 'lift,parking' WHEN 1 THEN 'balcony' WHEN 2 THEN 'cellar' WHEN 3 THEN 'terrace' ELSE '' END AS features,
 CASE WHEN k = 5 THEN (1 + p_partkey % 4)::INT END AS occupants FROM t"""
)
def listing_traits(spark, sf_dir):
    """SCA-15, SCA-20, SCA-21, SCA-23..25."""
    said = F.expr(
        "CASE p_partkey % 6 WHEN 0 THEN concat('Ascenseur et parking, charges ', 20 + p_partkey % 80, ' €, sans balcon') "
        "WHEN 1 THEN concat('Grand balcon, colocation possible, charges de ', 20 + p_partkey % 80, ' euros') "
        "WHEN 2 THEN concat('Cave, pas de colocation, charges : ', 20 + p_partkey % 80, ' €') WHEN 3 THEN 'Terrasse, proche jardin' "
        "WHEN 4 THEN 'Résidence étudiante' ELSE concat('maximum ', 1 + p_partkey % 4, ' personnes') END"
    )
    df = table(spark, sf_dir, "part").select("p_partkey", said.alias("t"))
    t = F.col("t")
    return df.select(
        "p_partkey", parse.parse_charges(t).alias("charges"), parse.parse_flat_share(t).alias("flat_share"), parse.is_student_only(t).alias("student"),
        F.array_join(F.array_sort(parse.extract_features(t)), ",").alias("features"), parse.parse_max_occupants(t).alias("occupants"),
    )


@query(
    """WITH t AS (SELECT o_orderkey, o_orderkey % 4 AS k, o_orderkey % 28 + 1 AS d, o_orderkey % 12 + 1 AS m FROM orders),
x AS (SELECT *, make_date(2024, m::INT, d::INT) AS this FROM t)
SELECT o_orderkey, strftime(CASE k WHEN 0 THEN make_date(2025, m::INT, d::INT) WHEN 1 THEN CASE WHEN date_diff('day', this, DATE '2024-05-01') > 45 THEN make_date(2025, m::INT, d::INT) ELSE this END
 WHEN 2 THEN DATE '2024-05-01' END, '%Y-%m-%d') AS free FROM x"""
)
def availability_dates(spark, sf_dir):
    """SCA-28: given years, years to guess, and words for now."""
    x = F.expr(
        "CASE o_orderkey % 4 WHEN 0 THEN concat('dispo le ', o_orderkey % 28 + 1, '/', o_orderkey % 12 + 1, '/2025') "
        "WHEN 1 THEN concat('libre le ', o_orderkey % 28 + 1, ' ', element_at(array('janvier','février','mars','avril','mai','juin','juillet','août','septembre','octobre','novembre','décembre'), cast(o_orderkey % 12 + 1 as int))) "
        "WHEN 2 THEN 'disponible immédiatement' ELSE 'à voir' END"
    )
    free = parse.parse_available_at(x, F.lit("2024-05-01").cast("date"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(free, "yyyy-MM-dd").alias("free"))


@query(
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '12 rue des Lilas' WHEN 1 THEN 'place Haute' END AS street, CASE c_custkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS grade,
 CASE c_custkey % 4 WHEN 2 THEN 'port' WHEN 3 THEN NULL END AS district, CASE c_custkey % 4 WHEN 0 THEN '12 rue des Lilas, 06000 Nation ' || c_nationkey WHEN 1 THEN 'place Haute, 06000 Nation ' || c_nationkey
  WHEN 2 THEN 'Port, 06000 Nation ' || c_nationkey ELSE '06000 Nation ' || c_nationkey END AS place FROM customer"""
)
def places(spark, sf_dir):
    """SCA-29, SCA-34, SCA-35: streets, districts (not nearby ones) and location lines."""
    said = F.expr("CASE c_custkey % 4 WHEN 0 THEN '12 rue des Lilas, calme' WHEN 1 THEN 'place Haute' WHEN 2 THEN 'au vieux port' ELSE 'proche gare' END")
    df = table(spark, sf_dir, "customer").select("c_custkey", said.alias("t"), F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")).alias("city"))
    street, district = parse.extract_street_address(F.col("t")), listing.canonical_district(F.col("t"))
    return df.select(
        "c_custkey", street.alias("street"), parse.address_grade(F.coalesce(street, F.lit(""))).alias("grade"), district.alias("district"),
        listing.format_location(street, district, F.lit("06000"), F.col("city")).alias("place"),
    )


@query(
    """SELECT p_partkey, replace(format('{:,}', CAST(floor(p_retailprice + 0.5) AS BIGINT)), ',', ' ') || ' €' || CASE p_partkey % 3 WHEN 0 THEN ' CC' WHEN 1 THEN ' HC' ELSE '' END AS price,
 CAST(p_size AS VARCHAR) || ' m²' AS area, CASE WHEN p_partkey * 30 < 60 THEN 'now' WHEN p_partkey * 30 < 3600 THEN (p_partkey * 30 // 60)::VARCHAR || ' min' WHEN p_partkey * 30 < 86400 THEN (p_partkey * 30 // 3600)::VARCHAR || ' h'
 ELSE (p_partkey * 30 // 86400)::VARCHAR || ' d' END AS age FROM part"""
)
def display_formats(spark, sf_dir):
    """SCA-43."""
    included = F.expr("CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END")
    return table(spark, sf_dir, "part").select(
        "p_partkey", listing.format_price(F.col("p_retailprice"), included).alias("price"), listing.format_area(F.col("p_size").cast("double")).alias("area"),
        listing.format_age(F.col("p_partkey") * 30).alias("age"),
    )


@query("""SELECT o_custkey % 100 AS bucket, replace(replace(rtrim(to_base64(encode('{"max_price":' || o_custkey % 100 || ',"city":"arles"}')), '='), '+', '-'), '/', '_') AS token FROM orders GROUP BY o_custkey % 100""")
def search_tokens(spark, sf_dir):
    """SCA-44: saved searches as tokens."""
    df = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("bucket")).distinct()
    return df.select("bucket", listing.search_token(F.struct(F.col("bucket").alias("max_price"), F.lit("arles").alias("city"))).alias("token"))


@query("SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) || regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS image, CASE WHEN regexp_extract(url, '^https?://([^/?#:]+)', 1) LIKE '%.example.com' OR regexp_extract(url, '^https?://([^/?#:]+)', 1) = 'example.com' THEN 'com' END AS portal FROM pages")
def url_identities(spark, sf_dir):
    """SCA-40, SCA-41."""
    return table(spark, sf_dir, "pages").select("page_id", listing.image_identity(F.col("url")).alias("image"), listing.portal_label(F.col("url"), {"example.com": "com"}).alias("portal"))


@query(
    """WITH c AS (SELECT c_custkey, c_custkey % 5 AS k, 43.0E0 + c_custkey % 11 * 0.01E0 AS lat, 5.0E0 + c_custkey % 13 * 0.01E0 AS lon FROM customer),
d AS (SELECT c_custkey, k, 2 * 6371.0E0 * asin(least(1.0E0, sqrt(pow(sin(radians(43.05E0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(43.05E0)) * pow(sin(radians(5.05E0 - lon) / 2), 2)))) AS km FROM c)
SELECT c_custkey, round(km, 3) AS km, CASE WHEN k = 0 THEN 33 ELSE CAST(floor(km * 1.3 / 18.0 * 60 + 0.5) AS INT) END AS minutes, CASE WHEN k = 0 THEN 33 ELSE CAST(floor(km * 1.3 / 18.0 * 60 + 0.5) AS INT) END > 30 AS too_far FROM d"""
)
def commute_distances(spark, sf_dir):
    """SCA-33, FLT-12: a known transit time replaces the estimate."""
    df = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_custkey % 5 AS k", "43.0E0 + c_custkey % 11 * 0.01E0 AS lat", "5.0E0 + c_custkey % 13 * 0.01E0 AS lon")
    point = F.array(F.struct(F.lit("work").alias("label"), F.lit("transit").alias("mode"), F.lit(43.05).alias("lat"), F.lit(5.05).alias("lon")))
    known = F.create_map(F.lit("work"), F.when(F.col("k") == 0, 33))
    d = df.withColumn("d", geo.distances(F.col("lat"), F.col("lon"), point, known))
    return d.select("c_custkey", F.col("d")[0]["km"].alias("km"), F.col("d")[0]["minutes"].alias("minutes"), filters.commute_exceeds(F.col("d"), 30).alias("too_far"))


@query(
    with_views(
        """SELECT id, user_id, acted_at > TIMESTAMP '2001-01-01 00:00:00' AS unread, CASE WHEN acted_at IS NULL OR date_diff('second', acted_at, TIMESTAMP '2001-08-02 00:00:00') >= CASE id % 3 WHEN 1 THEN 3600 WHEN 2 THEN 86400 ELSE 0 END THEN true ELSE false END AS due,
coalesce(id % 4 IN (0, 1) AND TIMESTAMP '2001-08-02 00:00:00' < TIMESTAMP '2001-08-01 00:00:00' + (id % 5) * INTERVAL '1' DAY, false) AS paid FROM user_state WHERE favorite""",
        "user_state",
    )
)
def alert_gates(spark, sf_dir):
    """FLT-20, FLT-21, FLT-23."""
    now = F.lit("2001-08-02 00:00:00").cast("timestamp")
    status = F.expr("CASE id % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'trialing' WHEN 2 THEN 'ended' ELSE NULL END")
    until = F.expr("timestamp '2001-08-01 00:00:00' + make_dt_interval(cast(id % 5 as int))")
    kind = F.expr("CASE id % 3 WHEN 1 THEN 'hourly' WHEN 2 THEN 'daily' ELSE 'each' END")
    return view(spark, sf_dir, "user_state").filter("favorite").select(
        "id", "user_id", (F.col("acted_at") > F.lit("2001-01-01 00:00:00").cast("timestamp")).alias("unread"),
        filters.due(kind, F.col("acted_at"), now).alias("due"), filters.plan_is_valid(status, until, now).alias("paid"),
    )


@query(
    """WITH s AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '{"maxPrice":' || c_custkey || ',"minArea":20}' WHEN 1 THEN '{"maxPrice":"x","minArea":20}' WHEN 2 THEN 'no json' ELSE '{"minArea":9}' END AS j FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_custkey::DOUBLE END AS max_price, CASE WHEN c_custkey % 4 = 0 THEN 20::DOUBLE END AS min_area FROM s"""
)
def stored_filters(spark, sf_dir):
    """FLT-14, SRC-27: stored criteria need both numbers; else none hold."""
    j = F.expr("CASE c_custkey % 4 WHEN 0 THEN concat('{\"maxPrice\":', c_custkey, ',\"minArea\":20}') WHEN 1 THEN '{\"maxPrice\":\"x\",\"minArea\":20}' WHEN 2 THEN 'no json' ELSE '{\"minArea\":9}' END")
    df = table(spark, sf_dir, "customer").select("c_custkey", j.alias("j"))
    top, area = (F.get_json_object("j", p).try_cast("double") for p in ("$.maxPrice", "$.minArea"))
    both = top.isNotNull() & area.isNotNull()
    return df.select("c_custkey", F.when(both, top).alias("max_price"), F.when(both, area).alias("min_area"))


@query(
    with_views(
        """SELECT id, concat_ws('|', title, coalesce(agency, '')) AS head FROM listings WHERE price IS NOT NULL AND area IS NOT NULL""", "listings"
    )
)
def trimmed_payload(spark, sf_dir):
    """FLT-15, FLT-17, FLT-24: the list's payload without its long parts; located rows only."""
    df = view(spark, sf_dir, "listings").withColumn("doc", F.struct("title", F.coalesce("agency", F.lit("")).alias("agency"), F.repeat("title", 20).alias("description")))
    slim = df.filter("price is not null and area is not null").withColumn("doc", F.col("doc").dropFields("description"))
    return slim.select("id", F.concat_ws("|", "doc.title", "doc.agency").alias("head"))


@query(
    """SELECT l_partkey, max_by(s_name, (hit, -s_suppkey)) AS chosen FROM (SELECT l_partkey, s_suppkey, s_name, CASE WHEN s_suppkey % 7 = l_partkey % 7 THEN 1 ELSE 0 END AS hit FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey) GROUP BY l_partkey"""
)
def occurrence_of_contact(spark, sf_dir):
    """SCA-45, JON-21: prefer the occurrence that fits, else the first."""
    pairs = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_suppkey").alias("s_suppkey")).distinct()
    named = pairs.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey")
    packed = named.groupBy("l_partkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("o"))
    fits = F.filter("o", lambda o: o["s_suppkey"] % 7 == F.col("l_partkey") % 7)
    return packed.select("l_partkey", F.coalesce(F.try_element_at(fits, F.lit(1)), F.try_element_at("o", F.lit(1)))["s_name"].alias("chosen"))


@query(
    """WITH c AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE 40.0 + n_nationkey END::DOUBLE AS lat FROM nation WHERE n_nationkey % 4 <> 1)
SELECT s_suppkey, lat FROM supplier LEFT JOIN c ON s_nationkey = k"""
)
def cached_lookup(spark, sf_dir):
    """SRC-28, SRC-33: a lookup with negative answers in its cache."""
    cache = table(spark, sf_dir, "nation").filter("n_nationkey % 4 <> 1").select(F.col("n_nationkey").alias("s_nationkey"), F.expr("CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE 40.0E0 + n_nationkey END").alias("lat"))
    found, _ = registry.with_lookup(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), cache, "s_nationkey", "lat")
    return found.select("s_suppkey", "lat")


@query("SELECT n_nationkey FROM nation WHERE n_nationkey % 4 = 1 AND n_nationkey IN (SELECT s_nationkey FROM supplier)")
def lookup_misses(spark, sf_dir):
    """SRC-28, SCH-10: what the next run has to fetch."""
    cache = table(spark, sf_dir, "nation").filter("n_nationkey % 4 <> 1").select(F.col("n_nationkey").alias("s_nationkey"), F.lit(1.0).alias("lat"))
    _, missing = registry.with_lookup(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), cache, "s_nationkey", "lat")
    return missing.select(F.col("s_nationkey").alias("n_nationkey"))


@query("SELECT l_suppkey, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS k FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01 00:00:00') ANTI JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01 00:00:00') USING (l_suppkey, l_partkey)) WHERE k <= 5")
def vanished_refs(spark, sf_dir):
    """SRC-32: known minus seen, five of each source."""
    cut = F.expr("timestamp_ntz '1997-01-01 00:00:00'")
    refs = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.max("l_shipdate").alias("last"))
    gone = refs.filter(F.col("last") < cut)
    return lists.top_by(gone, ["l_suppkey"], [F.col("l_partkey")], 5).select("l_suppkey", "l_partkey")


@query(
    "SELECT doc_id, trim(regexp_replace(translate(lower(translate(text, '-''’', '   ')), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), ' +', ' ', 'g')) AS commune FROM documents",
)
def commune_folds(spark, sf_dir):
    """SCA-08."""
    return table(spark, sf_dir, "documents").select("doc_id", text.commune_fold(F.col("text")).alias("commune"))


@query(
    """WITH t AS (SELECT c_custkey AS k, c_custkey % 7 AS m, 1 + c_custkey % 25 AS n FROM customer)
SELECT k, CASE WHEN m < 6 AND v BETWEEN 1 AND 20 THEN v::INT END AS occupants
FROM (SELECT *, CASE m WHEN 1 THEN n + 1 ELSE n END AS v FROM t)"""
)
def occupant_counts(spark, sf_dir):
    """SCA-25: plain counts, the top of a range, beds, and what flat-mates are said to be."""
    n = "1 + c_custkey % 25"
    said = F.expr(
        f"CASE c_custkey % 7 WHEN 0 THEN concat({n}, ' personnes') WHEN 1 THEN concat('pour ', {n}, '/', {n} + 1, ' personnes') WHEN 2 THEN concat({n}, ' couchages') "
        f"WHEN 3 THEN concat('idéal pour ', {n}, ' colocataires') WHEN 4 THEN concat('il y a ', {n}, ' locataires au total') WHEN 5 THEN concat({n}, ' voyageurs maximum') "
        f"ELSE concat({n}, ' locataires par chambre') END"
    )
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), parse.parse_max_occupants(said).alias("occupants"))


@query("SELECT user_id, event_id, sum(CASE WHEN value >= 20 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)::BIGINT AS hits, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS mean FROM events")
def moving_frames(spark, sf_dir):
    """§2.6: counts and means over the last five rows."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    return table(spark, sf_dir, "events").select(
        "user_id", "event_id", F.sum(F.when(F.col("value") >= 20, 1).otherwise(0)).over(w).alias("hits"), F.avg("value").over(w).alias("mean")
    )

"""Score queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from listloom.catalogue import query
from listloom.functions import geo
from listloom.operators import filters, scoring, stores
from listloom.session import spread
from listloom.sources.views import table, view, with_views

#: Parts of a place, so that no place is one task's work.
PARTS = 16

CRITERIA = filters.Criteria(max_price=950.0, min_price=902.0, min_area=15.0, city="arles", types=("small", "economy"), furnished=True)

MATCH = """
WITH m AS (SELECT id, lifecycle, coalesce(contains(lower(city), 'arles'), true) AS city_ok,
  price <= 950 AND price >= 902 AS price_ok, area >= 15 AS area_ok, property_type NOT IN ('parking', 'office') AS home,
  CASE WHEN contains(lower(city), 'arles') THEN 30 ELSE 0 END
   + CASE WHEN price <= 950 AND price >= 902 THEN floor(30 + least(10.0, 33 * (950.0 - price) / 950.0) + 0.5) ELSE 0 END
   + CASE WHEN area >= 15 THEN floor(20 + least(10.0, (area - 15.0) / 2) + 0.5) ELSE 0 END
   + CASE WHEN property_type IN ('small', 'economy') THEN 10 ELSE 0 END + CASE WHEN furnished THEN 10 ELSE 0 END AS total,
  120 - 10 * ((price IS NULL)::INT + (area IS NULL)::INT + (city IS NULL)::INT + (furnished IS NULL)::INT) AS evaluated FROM listings),
x AS (SELECT *, NOT city_ok OR NOT coalesce(price_ok, true) OR NOT coalesce(area_ok, true) OR NOT home AS excluded FROM m)
"""


@query(with_views(MATCH + """SELECT id, CAST(floor(CASE WHEN excluded THEN least(total / evaluated * 100, 40.0) ELSE total / evaluated * 100 END + 0.5) AS INT) AS value,
round(evaluated / 120, 6)::DOUBLE AS confidence, NOT excluded AS matches FROM x""", "listings"))  # fmt: skip
def score_match(spark, sf_dir):
    """SCO-01, FLT-11: match, confidence and in or out."""
    df = view(spark, sf_dir, "listings").select("id", scoring.match_score(CRITERIA).alias("s"))
    return df.select("id", "s.value", F.round("s.confidence", 6).alias("confidence"), "s.matches")


SEEN = """
WITH s AS (SELECT *, id % 3 = 0 AS form, id % 5 = 2 AS price_dropped, CAST(1 + id % 4 AS INT) AS sources,
  epoch_us(TIMESTAMP '2001-08-02 00:00:00') / 1000000 - epoch_us(first_seen) / 1000000 AS age,
  CASE WHEN id % 2 = 0 THEN (id % 10) / 10.0 END AS visit_rate FROM occurrences)
"""


def _seen(spark, sf_dir):
    return view(spark, sf_dir, "occurrences").withColumns({
        "form": F.expr("id % 3 = 0"), "price_dropped": F.expr("id % 5 = 2"), "sources": F.expr("cast(1 + id % 4 as int)"),
        "published_at": F.expr("CASE WHEN id % 4 <> 1 THEN first_seen END"), "visit_rate": F.expr("CASE WHEN id % 2 = 0 THEN cast(id % 10 as double) / 10 END"),
    })


TIER = "CASE WHEN age <= 900 THEN 50 WHEN age <= 3600 THEN 45 WHEN age <= 21600 THEN 35 WHEN age <= 86400 THEN 25 WHEN age <= 259200 THEN 12 WHEN age <= 604800 THEN 5 ELSE 0 END"


@query(with_views(SEEN + f"""SELECT id, CAST(greatest(0, least(100, CASE WHEN id % 4 <> 1 THEN {TIER} ELSE floor({TIER} * 0.7 + 0.5) END
 + CASE WHEN phone IS NOT NULL THEN 20 WHEN email IS NOT NULL THEN 10 WHEN form THEN 4 ELSE 0 END + CASE WHEN price_dropped THEN 12 ELSE 0 END
 + CASE WHEN sources > 1 THEN least(10, 3 * sources) ELSE 0 END + CASE WHEN views / greatest(1.0, age / 3600) > 20 THEN 10 ELSE 0 END
 + CASE WHEN favorites > 5 THEN 5 ELSE 0 END)) AS INT) AS value,
 round(((id % 4 <> 1)::INT + (coalesce(phone, email) IS NOT NULL)::INT + 1) / 3, 6)::DOUBLE AS confidence FROM s""", "occurrences"))  # fmt: skip
def score_opportunity(spark, sf_dir):
    """SCO-02."""
    now = F.lit("2001-08-02 00:00:00").cast("timestamp")
    df = _seen(spark, sf_dir).select("id", scoring.opportunity_score(now).alias("s"))
    return df.select("id", "s.value", F.round("s.confidence", 6).alias("confidence"))


@query(with_views(SEEN + """SELECT id, CAST(greatest(0, least(100, 40 + CASE WHEN age / 3600 <= 1 THEN 25 WHEN age / 3600 <= 6 THEN 15 WHEN age / 3600 <= 24 THEN 5 WHEN age / 3600 > 72 THEN -20 ELSE 0 END
 + CASE WHEN phone IS NOT NULL THEN 20 WHEN email IS NOT NULL THEN 10 WHEN form THEN 3 ELSE -15 END + CASE WHEN landlord = 'agency' THEN 5 ELSE 0 END
 + CASE WHEN sources >= 3 THEN -10 ELSE 0 END + CASE WHEN id % 2 = 0 THEN floor((CAST(id % 10 AS DOUBLE) / 10 - 0.3::DOUBLE) * 30 + 0.5::DOUBLE) ELSE 0 END)) AS INT) AS value,
 round(((id % 4 <> 1)::INT + (coalesce(phone, email) IS NOT NULL)::INT + (landlord <> 'unknown')::INT + (id % 2 = 0)::INT) / 4, 6)::DOUBLE AS confidence FROM s""", "occurrences"))  # fmt: skip
def score_visit(spark, sf_dir):
    """SCO-03."""
    now = F.lit("2001-08-02 00:00:00").cast("timestamp")
    df = _seen(spark, sf_dir).select("id", scoring.visit_score(now).alias("s"))
    return df.select("id", "s.value", F.round("s.confidence", 6).alias("confidence"))


@query(with_views("""WITH s AS (SELECT *, CASE id % 40 WHEN 3 THEN 'Paiement par Western Union' WHEN 5 THEN 'acompte avant la visite' WHEN 7 THEN NULL ELSE 'joli' END AS text FROM occurrences),
r AS (SELECT *, NOT coalesce(flat_share, false) AND property_type <> 'room' AS whole, CASE WHEN rooms IS NULL THEN 20.43 WHEN rooms <= 2 THEN 22.74 ELSE 19.73 END::DOUBLE AS ref FROM s)
SELECT id, CAST(least(100, CASE WHEN whole AND price / area / ref < 0.4 THEN 40 WHEN whole AND price / area / ref < 0.6 THEN 20 ELSE 0 END
 + CASE WHEN area / rooms < 9 THEN 15 ELSE 0 END + 10 * (id % 3)
 + CASE WHEN agency IS NULL AND phone IS NULL AND email IS NULL THEN 15 WHEN agency IS NULL OR coalesce(phone, email) IS NULL THEN 5 ELSE 0 END
 + CASE id % 40 WHEN 3 THEN 35 WHEN 5 THEN 30 ELSE 0 END) AS INT) AS value,
 round(((price IS NOT NULL)::INT + (area IS NOT NULL)::INT + (rooms IS NOT NULL)::INT + (text IS NOT NULL)::INT) / 4, 6)::DOUBLE AS confidence FROM r""", "occurrences"))  # fmt: skip
def score_risk(spark, sf_dir):
    """SCO-04, SCA-38."""
    text = F.expr("CASE id % 40 WHEN 3 THEN 'Paiement par Western Union' WHEN 5 THEN 'acompte avant la visite' WHEN 7 THEN NULL ELSE 'joli' END")
    df = view(spark, sf_dir, "occurrences").withColumns({"text": text, "conflicts": F.expr("cast(id % 3 as int)")})
    scored = df.select("id", scoring.risk_score(F.col("text")).alias("s"))
    return scored.select("id", "s.value", F.round("s.confidence", 6).alias("confidence"))


#: One user for each nation, with criteria of their own.
USERS = """SELECT n_nationkey AS user_id, 905.0E0 + n_nationkey * 4 AS max_price, 890.0E0 + n_nationkey % 3 * 10 AS min_price,
 5.0E0 + n_nationkey % 6 * 5 AS min_area, CASE WHEN n_nationkey % 4 = 0 THEN 'evian' ELSE 'arles' END AS wanted, n_nationkey % 2 = 0 AS furnished_wanted,
 CAST(20 + n_nationkey % 5 * 10 AS INT) AS longest FROM nation"""
USER_MATCH = f"""
WITH u AS ({USERS}), c AS (SELECT user_id, l.id, coalesce(contains(lower(city), wanted), true) AS city_ok,
  price <= max_price AND price >= min_price AS price_ok, area >= min_area AS area_ok, property_type NOT IN ('parking', 'office') AS home,
  CASE WHEN contains(lower(city), wanted) THEN 30 ELSE 0 END
   + CASE WHEN price <= max_price AND price >= min_price THEN floor(30 + least(10.0, 33 * (max_price - price) / max_price) + 0.5) ELSE 0 END
   + CASE WHEN area >= min_area THEN floor(20 + least(10.0, (area - min_area) / 2) + 0.5) ELSE 0 END
   + CASE WHEN furnished = furnished_wanted THEN 10 ELSE 0 END AS total,
  110 - 10 * ((price IS NULL)::INT + (area IS NULL)::INT + (city IS NULL)::INT + (furnished IS NULL)::INT) AS evaluated,
  coalesce(commute > longest, false) AS far FROM listings l, u WHERE lifecycle <> 'inactive'),
x AS (SELECT *, NOT city_ok OR NOT coalesce(price_ok, true) OR NOT coalesce(area_ok, true) OR NOT home AS excluded FROM c),
m AS (SELECT user_id, id, CAST(floor(CASE WHEN excluded THEN least(total / evaluated * 100, 40.0) ELSE total / evaluated * 100 END + 0.5) AS INT) AS value,
 NOT excluded AND NOT far AS matches FROM x)
"""


def _user_scores(spark, sf_dir):
    """Every user's match with every living listing. The users' side is the nations: 25 rows, whatever the scale."""
    users = spark.sql(USERS.replace("FROM nation", "FROM {nation}"), nation=table(spark, sf_dir, "nation"))
    df = view(spark, sf_dir, "listings").filter("lifecycle <> 'inactive'").crossJoin(F.broadcast(users))
    own = filters.Criteria(
        max_price=F.col("max_price"), min_price=F.col("min_price"), min_area=F.col("min_area"), city=F.col("wanted"), furnished=F.col("furnished_wanted")
    )
    return df.select("user_id", "id", scoring.composed(own, F.col("commute"), F.col("longest")).alias("s"))


@query(with_views(USER_MATCH + "SELECT user_id, id, value, matches FROM m", "listings"))
def per_user_scores(spark, sf_dir):
    """SCO-06, SCO-07: every user's own criteria and commute on living listings, by the match score."""
    return _user_scores(spark, sf_dir).select("user_id", "id", "s.value", "s.matches")


@query(with_views(USER_MATCH + """, old AS (SELECT user_id, id, CASE WHEN id % 5 = 0 THEN value + 1 ELSE value END AS value, matches FROM m WHERE (id + user_id) % 4 <> 0)
SELECT user_id, id, m.value, m.matches, CASE WHEN old.value IS NULL THEN 'inserted' ELSE 'updated' END AS action
FROM m LEFT JOIN old USING (user_id, id) WHERE old.value IS NULL OR old.value <> m.value OR old.matches <> m.matches""", "listings"))  # fmt: skip
def user_score_upsert(spark, sf_dir):
    """SNK-14: only scores whose hash has changed are written."""
    new = _user_scores(spark, sf_dir).select("user_id", "id", "s.value", "s.matches")
    old = new.filter("(id + user_id) % 4 <> 0").withColumn("value", F.expr("CASE WHEN id % 5 = 0 THEN value + 1 ELSE value END"))
    return stores.changed_rows(old, new, ["user_id", "id"]).select("user_id", "id", "value", "matches", "action")


@query(with_views("""WITH m AS (SELECT group_id, id, price, area, CAST(id % 3 AS INT) AS k, lower(address) AS a FROM occurrences)
SELECT id, CAST((coalesce(abs(price * (1 + 0.1 * k) - price) / price > 0.15, false))::INT + (coalesce(abs(area * (1 + 0.08 * k) - area) / area > 0.1, false))::INT
 + (k = 1 AND a IS NOT NULL)::INT AS INT) AS conflicts FROM m""", "occurrences"))  # fmt: skip
def conflict_counts(spark, sf_dir):
    """SCO-04: conflicting fields that add to the risk."""
    df = view(spark, sf_dir, "occurrences").withColumn("k", F.expr("cast(id % 3 as int)"))

    def field(value, other):
        return F.struct(value.alias("value"), F.array(F.struct(other.alias("value"))).alias("conflicts"))

    price, area, address = F.col("price"), F.col("area"), F.col("address")
    elsewhere = F.when(F.col("k") == 1, F.concat(address, F.lit(" bis"))).otherwise(F.upper(address))
    found = scoring.conflicts_of(
        field(price, price * (1 + F.lit(0.1) * F.col("k"))), field(area, area * (1 + F.lit(0.08) * F.col("k"))), field(address, elsewhere)
    )
    return df.select("id", found.cast("int").alias("conflicts"))


@query(with_views("""SELECT id, concat_ws(', ', CASE WHEN price > 950 THEN 'price +' || CAST(CAST(floor(price - 950.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS VARCHAR) END,
 CASE WHEN area < 15 THEN 'area -' || CAST(CAST(floor(15.0 - area + 0.5) AS BIGINT) AS VARCHAR) END) AS why
FROM listings WHERE price <= 997.5 AND coalesce(area >= 14.25, true) AND (price > 950 OR coalesce(area < 15, false)) AND city = 'arles'""", "listings"))  # fmt: skip
def near_matches(spark, sf_dir):
    """SCO-08."""
    df = view(spark, sf_dir, "listings").filter(scoring.near_miss(CRITERIA))
    return df.select("id", scoring.overshoot(CRITERIA).alias("why"))


@query(with_views("""SELECT s.id, user_id, CASE WHEN l.lifecycle = 'inactive' THEN 'gone' ELSE 'stale' END AS kind FROM user_state s JOIN listings l ON l.id = s.id
WHERE favorite AND (l.lifecycle = 'inactive' OR (coalesce(tracking, 'new') = 'new' AND (epoch_us(TIMESTAMP '2001-08-02 00:00:00') - epoch_us(acted_at)) / 86400e6 >= 1))""", "user_state", "listings"))  # fmt: skip
def stale_favourites(spark, sf_dir):
    """SCO-09, JON-02, JON-03."""
    from listloom.operators.timelines import days_between

    liked = view(spark, sf_dir, "user_state").filter("favorite")
    df = liked.join(view(spark, sf_dir, "listings").select("id", "lifecycle"), "id")
    gone = F.col("lifecycle") == "inactive"
    age = days_between(F.lit("2001-08-02 00:00:00").cast("timestamp"), F.col("acted_at"))
    stale = (F.coalesce("tracking", F.lit("new")) == "new") & (age >= 1)
    return df.filter(gone | stale).select("id", "user_id", F.when(gone, "gone").otherwise("stale").alias("kind"))


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 1000.0E0 + c_custkey % 20 * 100 END AS need, c_acctbal AS income, c_custkey % 2 = 0 AS gross,
 CASE WHEN c_custkey % 3 = 0 THEN 'student' WHEN c_custkey % 7 = 0 THEN NULL ELSE 'permanent' END AS situation, c_custkey % 4 = 1 AS strict FROM customer),
n AS (SELECT *, CASE WHEN gross THEN income / 1.23 ELSE income END AS net FROM c)
SELECT c_custkey, CASE WHEN coalesce(net < 0.95 * need, false) THEN 'income' WHEN strict AND coalesce(situation <> 'permanent', false) THEN 'situation'
 WHEN need IS NULL AND (NOT strict OR situation IS NULL) THEN 'unknown' ELSE 'eligible' END AS verdict FROM n""")  # fmt: skip
def eligibility_verdicts(spark, sf_dir):
    """FLT-18."""
    df = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 1000.0E0 + c_custkey % 20 * 100 END AS need", "c_acctbal AS income", "c_custkey % 2 = 0 AS gross",
        "CASE WHEN c_custkey % 3 = 0 THEN 'student' WHEN c_custkey % 7 = 0 THEN NULL ELSE 'permanent' END AS situation",
        "CASE WHEN c_custkey % 4 = 1 THEN array('permanent') ELSE cast(array() AS array<string>) END AS wanted",
    )
    verdict = filters.eligibility(F.col("need"), F.col("wanted"), F.col("income"), F.col("gross"), F.col("situation"))
    return df.select("c_custkey", verdict.alias("verdict"))


@query("""WITH p AS (SELECT s_suppkey, 43.0E0 + s_suppkey % 10 * 0.07 AS lat, 5.0E0 + s_suppkey % 7 * 0.11 AS lon, s_suppkey % 4 AS zone FROM supplier),
d AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b, 2 * 6371.0E0 * asin(least(1.0E0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) AS km
 FROM p a JOIN p b ON a.zone = b.zone AND a.s_suppkey < b.s_suppkey)
SELECT a, b, round(km, 4) AS km, CAST(floor(km * 1.3 / 4.5 * 60 + 0.5) AS INT) AS walk, CAST(floor(km * 1.3 / 18.0 * 60 + 0.5) AS INT) AS transit FROM d WHERE km <= 20""")  # fmt: skip
def haversine_pairs(spark, sf_dir):
    """SCA-30..32, JON-20: distances inside blocks only."""
    p = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "43.0E0 + s_suppkey % 10 * 0.07E0 AS lat", "5.0E0 + s_suppkey % 7 * 0.11E0 AS lon", "s_suppkey % 4 AS zone")
    # Distances are of places, far fewer than rows; ids meet by the pairs of places that are near, dealt to parts of a place.
    salt = F.pmod(F.xxhash64("s_suppkey"), F.lit(PARTS)).cast("int")
    at = p.groupBy("zone", "lat", "lon").agg(F.count(F.lit(1)).alias("n"))
    left = at.select("zone", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    right = at.select("zone", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    km = geo.haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    places = left.join(right, "zone").withColumn("far", km).filter("far <= 20").select(
        "zone", "lat1", "lon1", "lat2", "lon2", F.round("far", 4).alias("km"),
        geo.estimated_minutes(F.col("far"), "walk").alias("walk"), geo.estimated_minutes(F.col("far"), "transit").alias("transit"),
    )
    one = p.select("zone", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), F.col("s_suppkey").alias("a"), salt.alias("part"))
    every = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part")
    other = p.select("zone", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.col("s_suppkey").alias("b"), every)
    meets = ["zone", "lat2", "lon2", "part"]
    near = spread(one.join(places, ["zone", "lat1", "lon1"]), *meets).join(other, meets).filter("a < b")
    return near.select("a", "b", "km", "walk", "transit")

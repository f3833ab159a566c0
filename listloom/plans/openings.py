"""Queries over what is still open for a user: near matches not told of, drafts to write, favourites with and without scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from listloom.catalogue import query
from listloom.functions.text import comparable
from listloom.operators import scoring
from listloom.plans.scores import CRITERIA
from listloom.sources.views import view, with_views

#: What the tables do not tell, by key: who was told already, what was drafted or let, and whom to write to.
TOLD = "(s.id + s.user_id) % 4 = 0"
DRAFTED, RENTED = "(id * 3 + user_id) % 5 = 0", "id % 23 = 0"
EMAIL = "CASE WHEN id % 3 = 1 THEN NULL WHEN id % 7 = 2 THEN '' ELSE concat('u', CAST(id AS VARCHAR(12)), '@mail.test') END"


@query(with_views(f"""SELECT s.id, s.user_id, concat_ws(', ', CASE WHEN price > 950 THEN 'price +' || CAST(CAST(floor(price - 950.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS VARCHAR) END,
 CASE WHEN area < 15 THEN 'area -' || CAST(CAST(floor(15.0 - area + 0.5) AS BIGINT) AS VARCHAR) END) AS why
FROM user_score s JOIN listings l ON l.id = s.id LEFT JOIN user_state u ON u.id = s.id AND u.user_id = s.user_id
WHERE NOT matches AND NOT ({TOLD}) AND lifecycle = 'active' AND NOT coalesce(archived, false) AND l.id % 23 <> 0
 AND price <= 997.5 AND coalesce(area >= 14.25, true) AND (price > 950 OR coalesce(area < 15, false)) AND city = 'arles'""", "user_score", "listings", "user_state"))  # fmt: skip
def open_near_matches(spark, sf_dir):
    """SCO-08: near misses of every user that are alive, not let, not archived and not told of yet; a listing without state
    is open."""
    listings = view(spark, sf_dir, "listings").filter(scoring.near_miss(CRITERIA)).filter(f"lifecycle = 'active' and not {RENTED}")
    scores = view(spark, sf_dir, "user_score").alias("s").filter(f"not matches and not ({TOLD})").select("id", "user_id")
    states = view(spark, sf_dir, "user_state").select("id", "user_id", "archived")
    near = scores.join(listings.select("id", "price", "area", "rooms"), "id").join(states, ["id", "user_id"], "left")
    return near.filter(~F.coalesce("archived", F.lit(False))).select("id", "user_id", scoring.overshoot(CRITERIA).alias("why"))


@query(with_views(f"""WITH o AS (SELECT coalesce(s.id, u.id) AS id, coalesce(s.user_id, u.user_id) AS user_id, coalesce(matches, false) AS matches, coalesce(favorite, false) AS favorite, coalesce(archived, false) AS archived
 FROM user_score s FULL JOIN user_state u ON u.id = s.id AND u.user_id = s.user_id)
SELECT id, user_id, favorite, {EMAIL} AS email, property_type, area, price FROM o JOIN listings USING (id)
WHERE (matches OR favorite) AND NOT archived AND NOT ({DRAFTED}) AND NOT ({RENTED}) AND lifecycle <> 'inactive' AND nullif({EMAIL}, '') IS NOT NULL AND area IS NOT NULL AND city IS NOT NULL AND price IS NOT NULL""", "user_score", "user_state", "listings"))  # fmt: skip
def pending_drafts(spark, sf_dir):
    """SCO-09: messages to be drafted: what matches or is a favourite, alive and open, with all that a message needs."""
    scores = view(spark, sf_dir, "user_score").select("id", "user_id", "matches")
    states = view(spark, sf_dir, "user_state").select("id", "user_id", "favorite", "archived")
    no = lambda c: F.coalesce(c, F.lit(False))
    own = scores.join(states, ["id", "user_id"], "full_outer").withColumn("favorite", no("favorite")).filter(no("matches") | F.col("favorite"))
    wanted = own.filter(~no("archived")).filter(f"not ({DRAFTED})")
    whole = view(spark, sf_dir, "listings").filter(f"not ({RENTED}) and lifecycle <> 'inactive' and area is not null and city is not null and price is not null")
    found = wanted.join(whole.select("id", "property_type", "area", "price"), "id").withColumn("email", F.expr(EMAIL))
    return found.filter(F.nullif("email", F.lit("")).isNotNull()).select("id", "user_id", "favorite", "email", "property_type", "area", "price")


@query(with_views("""SELECT u.id, u.user_id, l.price, s.match, coalesce(s.matches, false) AS matches FROM user_state u JOIN listings l ON l.id = u.id LEFT JOIN user_score s ON s.id = u.id AND s.user_id = u.user_id AND (s.id + s.user_id) % 3 <> 1
WHERE favorite""", "user_state", "listings", "user_score"))  # fmt: skip
def scored_favourites(spark, sf_dir):
    """JON-03: favourites with their scores; those that have none stay, unscored."""
    liked = view(spark, sf_dir, "user_state").filter("favorite").select("id", "user_id")
    scores = view(spark, sf_dir, "user_score").filter("(id + user_id) % 3 <> 1").select("id", "user_id", "match", "matches")
    found = liked.join(view(spark, sf_dir, "listings").select("id", "price"), "id").join(scores, ["id", "user_id"], "left")
    return found.select("id", "user_id", "price", "match", F.coalesce("matches", F.lit(False)).alias("matches"))


_C = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query(with_views(f"""WITH v AS (SELECT 'district' AS kind, 0 AS k, trim(district) AS value, id FROM occurrences
 UNION ALL SELECT 'street', 1, trim(regexp_replace(address, '^[0-9]+( ?(bis|ter|quater))?[ ,]*', '')), id FROM occurrences UNION ALL SELECT 'agency', 2, trim(agency), id FROM occurrences UNION ALL SELECT 'city', 3, trim(city), id FROM occurrences),
g AS (SELECT kind, k, {_C.format('value')} AS folded, arg_min(value, id) AS value, count(*) AS n FROM v WHERE value <> '' GROUP BY kind, k, folded)
SELECT kind, value, n FROM g WHERE contains(folded, 'a') AND folded <> 'a' ORDER BY k, n DESC, value LIMIT 6""", "occurrences"))  # fmt: skip
def search_suggest_streets(spark, sf_dir):
    """AGG-22: suggestions of districts, streets, agencies and cities; spellings that fold alike are one, shown as it came
    first. Six are shown."""
    df = view(spark, sf_dir, "occurrences")
    street = F.regexp_replace("address", "^[0-9]+( ?(bis|ter|quater))?[ ,]*", "")
    kinds = (("district", F.col("district")), ("street", street), ("agency", F.col("agency")), ("city", F.col("city")))
    each = F.array(*[F.struct(F.lit(n).alias("kind"), F.lit(k).alias("k"), F.trim(c).alias("value")) for k, (n, c) in enumerate(kinds)])
    held = df.select("id", F.explode(each).alias("x")).select("id", "x.*").filter("value <> ''").withColumn("folded", comparable(F.col("value")))
    counted = held.groupBy("kind", "k", "folded").agg(F.min_by("value", "id").alias("value"), F.count(F.lit(1)).alias("n"))
    hits = counted.filter(F.contains("folded", F.lit("a")) & (F.col("folded") != "a"))
    return hits.orderBy("k", F.col("n").desc(), "value").limit(6).select("kind", "value", "n")

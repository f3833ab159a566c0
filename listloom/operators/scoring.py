"""Explainable scores: match, opportunity, visit probability, risk and the action priority."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from listloom.functions.geo import reference_rent
from listloom.functions.text import clamp_score, comparable, js_round

from .filters import Criteria, residential


def _points(*terms: tuple[Column, Column | int]) -> Column:
    return sum((F.when(F.coalesce(ok, F.lit(False)), p).otherwise(0) for ok, p in terms), F.lit(0))


def match_score(c: Criteria) -> Column:
    """struct(value, confidence, matches). Unknown values keep a listing and lower the confidence by 10 each."""
    price, area = F.col("price"), F.col("area")
    top = c.max_price
    wrong_city = F.lit(False)
    city_points, weight = F.lit(0), 70
    if c.city is not None:
        weight += 30
        place = F.col("postal_code").isin(*c.postal_codes) if c.postal_codes else F.contains(F.lower("city"), F.lit(c.city))
        wrong_city = ~F.coalesce(place, F.lit(True))
        city_points = F.when(place, 30).otherwise(0)
    price_ok = (price <= top) & (price >= (0 if c.min_price is None else c.min_price))
    price_points = F.when(price_ok, js_round(30 + F.least(F.lit(10.0), 33 * (top - price) / top))).otherwise(0)
    area_points = F.when(area >= c.min_area, js_round(20 + F.least(F.lit(10.0), (area - c.min_area) / 2))).otherwise(0)
    total = city_points + price_points + area_points
    unknown = F.when(price.isNull(), 1).otherwise(0) + F.when(area.isNull(), 1).otherwise(0)
    if c.city is not None:
        unknown = unknown + F.when((F.col("postal_code") if c.postal_codes else F.col("city")).isNull(), 1).otherwise(0)
    if c.types:
        weight += 10
        total = total + F.when(F.col("property_type").isin(*c.types), 10).otherwise(0)
    if c.furnished is not None:
        weight += 10
        total = total + F.when(F.col("furnished") == c.furnished, 10).otherwise(0)
        unknown = unknown + F.when(F.col("furnished").isNull(), 1).otherwise(0)
    excluded = (
        wrong_city | F.coalesce(~price_ok, F.lit(False)) | F.coalesce(area < c.min_area, F.lit(False))
        | ~F.coalesce(residential(), F.lit(True))
    )
    evaluated = weight - 10 * unknown
    raw = F.when(evaluated > 0, total / evaluated * 100).otherwise(0)
    value = clamp_score(F.when(excluded, F.least(raw, F.lit(40.0))).otherwise(raw))
    return F.struct(value.alias("value"), (evaluated / weight).alias("confidence"), (~excluded).alias("matches"))


def opportunity_score(now: Column) -> Column:
    """struct(value, confidence): freshness, contact, price drop, sources, demand."""
    since = F.coalesce("published_at", "first_seen")
    age = F.unix_timestamp(now) - F.unix_timestamp(since)
    tier = (
        F.when(age <= 900, 50).when(age <= 3600, 45).when(age <= 21600, 35).when(age <= 86400, 25)
        .when(age <= 259200, 12).when(age <= 604800, 5).otherwise(0)
    )
    fresh = F.when(F.col("published_at").isNotNull(), tier).otherwise(js_round(tier * 0.7))
    contact = F.when(F.col("phone").isNotNull(), 20).when(F.col("email").isNotNull(), 10).when(F.col("form"), 4).otherwise(0)
    hours = F.greatest(F.lit(1.0), age / 3600)
    extra = _points(
        (F.col("price_dropped"), 12),
        (F.col("sources") > 1, F.least(F.lit(10), 3 * F.col("sources"))),
        (F.col("views") / hours > 20, 10),
        (F.col("favorites") > 5, 5),
    )
    known = _points((F.col("published_at").isNotNull(), 1), (F.coalesce("phone", "email").isNotNull(), 1), (F.col("views").isNotNull(), 1))
    return F.struct(clamp_score(fresh + contact + extra).alias("value"), (known / 3).alias("confidence"))


def visit_score(now: Column) -> Column:
    """struct(value, confidence): how likely a visit is, from age, contact, landlord, spread and the observed rate."""
    hours = (F.unix_timestamp(now) - F.unix_timestamp(F.coalesce("published_at", "first_seen"))) / 3600
    age = F.when(hours <= 1, 25).when(hours <= 6, 15).when(hours <= 24, 5).when(hours > 72, -20).otherwise(0)
    contact = F.when(F.col("phone").isNotNull(), 20).when(F.col("email").isNotNull(), 10).when(F.col("form"), 3).otherwise(-15)
    observed = F.when(F.col("visit_rate").isNotNull(), js_round((F.col("visit_rate") - 0.3) * 30)).otherwise(0)
    total = 40 + age + contact + _points((F.col("landlord") == "agency", 5), (F.col("sources") >= 3, -10)) + observed
    known = _points(
        (F.col("published_at").isNotNull(), 1), (F.coalesce("phone", "email").isNotNull(), 1),
        (F.col("landlord") != "unknown", 1), (F.col("visit_rate").isNotNull(), 1),
    )
    return F.struct(clamp_score(total).alias("value"), (known / 4).alias("confidence"))


#: Families of suspicious wording: words and points. Own list.
SUSPICIOUS = [
    (("western union", "mandat cash", "transfert d argent"), 35),
    (("a l etranger", "je suis en deplacement"), 25),
    (("avant la visite", "acompte avant"), 30),
    (("whatsapp uniquement", "par mail uniquement"), 20),
]


def risk_score(text: Column) -> Column:
    """struct(value, confidence): rents far under the reference, cramped rooms, conflicting sources, missing identity and
    suspicious wording. Rents are judged for whole dwellings only."""
    whole = ~F.coalesce("flat_share", F.lit(False)) & (F.col("property_type") != "room")
    ratio = F.when(whole & (F.col("area") > 0), F.col("price") / F.col("area") / reference_rent(F.col("rooms")))
    cramped = (F.col("rooms") > 0) & (F.col("area") / F.col("rooms") < 9)
    folded = F.concat(F.lit(" "), comparable(F.coalesce(text, F.lit(""))), F.lit(" "))
    wording = F.lit(0)
    for words, points in SUSPICIOUS:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(folded, F.lit(f" {w} "))
        wording = wording + F.when(hit, points).otherwise(0)
    identity = (
        F.when(F.col("agency").isNull() & F.col("phone").isNull() & F.col("email").isNull(), 15)
        .when(F.col("agency").isNull() | F.coalesce("phone", "email").isNull(), 5).otherwise(0)
    )
    low = F.when(ratio < 0.4, 40).when(ratio < 0.6, 20).otherwise(0)
    total = low + F.when(F.coalesce(cramped, F.lit(False)), 15).otherwise(0) + 10 * F.coalesce("conflicts", F.lit(0)) + identity + wording
    known = _points((F.col("price").isNotNull(), 1), (F.col("area").isNotNull(), 1), (F.col("rooms").isNotNull(), 1), (text.isNotNull(), 1))
    return F.struct(clamp_score(total).alias("value"), (known / 4).alias("confidence"))


def conflicts_of(price: Column, area: Column, address: Column) -> Column:
    """How many merged fields conflict: a price by over 15 %, an area by over 10 %, an address by its words."""

    def apart(field: Column, share: float) -> Column:
        value = field["value"]
        return (value != 0) & F.exists(field["conflicts"], lambda x: F.abs(x["value"] - value) / F.abs(value) > share)

    worded = F.exists(address["conflicts"], lambda x: comparable(x["value"]) != comparable(address["value"]))
    return _points((apart(price, 0.15), 1), (apart(area, 0.10), 1), (address["value"].isNotNull() & worded, 1))


def composed(c: Criteria, commute: Column, longest: Column | int | None) -> Column:
    """struct(value, confidence, matches): the match, which a commute that is too long turns down; an unknown one passes."""
    score = match_score(c)
    near = F.lit(True) if longest is None else ~F.coalesce(commute > longest, F.lit(False))
    return F.struct(score["value"].alias("value"), score["confidence"].alias("confidence"), (score["matches"] & near).alias("matches"))


def near_miss(c: Criteria, margin: float = 0.05) -> Column:
    """Within the margin of the bounds and outside at least one: an unknown price fails, an unknown area passes."""
    inside = (F.col("price") <= c.max_price * (1 + margin)) & F.coalesce(F.col("area") >= c.min_area * (1 - margin), F.lit(True))
    outside = (F.col("price") > c.max_price) | F.coalesce(F.col("area") < c.min_area, F.lit(False))
    return F.coalesce(inside & outside & (F.col("city") == c.city), F.lit(False))


def overshoot(c: Criteria) -> Column:
    """What is over or under, as text."""
    over = F.col("price") - c.max_price
    under = c.min_area - F.col("area")
    return F.concat_ws(
        ", ",
        F.when(over > 0, F.concat(F.lit("price +"), js_round(over).cast("string"))),
        F.when(under > 0, F.concat(F.lit("area -"), js_round(under).cast("string"))),
    )

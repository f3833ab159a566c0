"""What a user's actions say about features, and redundancy of relayed ads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listloom.functions.text import js_round

#: What a user's last word on a listing weighs: the first that applies. Fixed values.
DISLIKED, FAVOURITE, VIEWED = -2, 5, 1
TRACKED = {"toContact": 2, "contacted": 3, "replied": 3, "visitOffered": 4, "visitScheduled": 4, "visited": 5, "rented": 5}
BONUS = 15


def action_weight() -> Column:
    """Archived or turned down, else favourite, else by the state of the contact, else merely seen."""
    tracked = F.create_map(*[F.lit(x) for pair in TRACKED.items() for x in pair])[F.col("tracking")]
    return (
        F.when(F.coalesce("archived", F.lit(False)) | F.coalesce(F.col("tracking").isin("rejected", "ignored"), F.lit(False)), DISLIKED)
        .when(F.coalesce("favorite", F.lit(False)), FAVOURITE)
        .when(tracked.isNotNull(), tracked)
        .when(F.coalesce("viewed", F.lit(False)), VIEWED)
        .otherwise(0)
    )


def listing_features() -> Column:
    """Type, price to the hundred, rooms, energy label and every extra of a listing, where known."""
    kind = F.when(F.col("property_type") != "unknown", F.concat(F.lit("type:"), "property_type"))
    price = F.concat(F.lit("price:"), (js_round(F.col("price") / 100) * 100).cast("string"))
    rooms, label = F.concat(F.lit("rooms:"), F.col("rooms").cast("string")), F.concat(F.lit("dpe:"), F.col("dpe"))
    extras = F.filter(F.split(F.coalesce("features", F.lit("")), ","), lambda x: x != "")
    return F.concat(F.array_compact(F.array(kind, price, rooms, label)), F.transform(extras, lambda x: F.concat(F.lit("extra:"), x)))


def affinities(listings: DataFrame, state: DataFrame, features: Column, least_positive: int = 2) -> DataFrame:
    """(id, affinity within 0..1): the positive weights of a listing's features, over the greatest; 0 for all when fewer
    than ``least_positive`` listings were liked."""
    held = listings.select("id", F.explode_outer(features).alias("feature"))
    acted = state.select("id", F.coalesce(action_weight(), F.lit(0)).alias("weight"))
    weights = held.join(acted, "id").groupBy("feature").agg(F.sum("weight").alias("weight"))
    liked = acted.agg(F.count_if(F.col("weight") > 0).alias("liked"))
    scores = held.join(weights, "feature", "left").groupBy("id").agg(
        F.sum(F.greatest(F.lit(0), F.coalesce("weight", F.lit(0)))).alias("raw")
    )
    top = scores.agg(F.max("raw").alias("top"))
    value = F.when((F.col("liked") >= least_positive) & (F.col("top") > 0), F.col("raw") / F.col("top")).otherwise(0.0)
    return scores.crossJoin(F.broadcast(liked)).crossJoin(F.broadcast(top)).select("id", value.alias("affinity"))


def spec_keys() -> Column:
    """The strict key (place, price, area, rooms) and the loose one (place, rounded price and area)."""
    strict = F.concat_ws("|", F.lit("s"), "city", F.round("price").cast("long").cast("string"), F.col("area").cast("string"), F.col("rooms").cast("string"))
    loose = F.concat_ws("|", F.lit("l"), "city", F.floor(F.col("price") / 10).cast("string"), F.floor("area").cast("string"))
    known = F.col("city").isNotNull() & F.col("price").isNotNull() & F.col("area").isNotNull()
    return F.when(known, F.array(F.when(F.col("rooms").isNotNull(), strict).otherwise(loose), loose))


def without_redundant(rows: DataFrame, relays: list[str]) -> DataFrame:
    """Drops relayed ads that share a key with a direct one."""
    keyed = rows.select("id", F.col("source_id").isin(*relays).alias("relayed"), F.explode(spec_keys()).alias("key"))
    direct = keyed.filter("not relayed").select("key").distinct()
    redundant = keyed.filter("relayed").join(direct, "key", "left_semi").select("id").distinct()
    return rows.join(redundant, "id", "left_anti")

"""The list query: overlay of one user, predicates, order and page, as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_LIMIT, MAX_LIMIT = 30, 500


def overlay(listings: DataFrame, state: DataFrame, score: DataFrame, user_id: int) -> DataFrame:
    """Listings with one user's state and scores; the overlays are cut to the user before they are joined."""
    own_state = state.filter(F.col("user_id") == user_id).drop("user_id", "acted_at")
    own_score = score.filter(F.col("user_id") == user_id).drop("user_id")
    joined = listings.join(own_state, "id", "left").join(own_score, "id", "left")
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("viewed", "favorite", "archived")}
    return joined.withColumns(flags | {"tracking": F.coalesce("tracking", F.lit("new"))})


def priority(match: Column, opportunity: Column, visit: Column, risk: Column) -> Column:
    from listloom.functions.text import clamp_score

    return clamp_score(0.3 * match + 0.35 * opportunity + 0.25 * visit + 0.1 * (100 - risk))


def order(mode: str, anonymous: bool = False) -> list[Column]:
    """Sort columns; unknown values are last in both directions and the id breaks ties. An unknown mode is priority,
    and anonymous viewers have neither priority nor commute."""
    if anonymous and mode not in ("recent", "price", "area"):
        mode = "recent"
    newest = F.col("first_seen").desc()
    modes = {
        "recent": [newest],
        "price": [F.col("price").asc_nulls_last()],
        "area": [F.col("area").desc_nulls_last()],
        "closest": [F.col("commute").asc_nulls_last(), F.col("priority").desc_nulls_last()],
    }
    return [*modes.get(mode, [F.col("priority").desc_nulls_last(), newest]), F.col("id").asc()]


def page(df: DataFrame, sort: list[Column], limit: int | None = None, offset: int = 0) -> DataFrame:
    limit = min(MAX_LIMIT, max(1, limit)) if limit is not None else DEFAULT_LIMIT
    return df.orderBy(*sort).offset(max(0, offset)).limit(limit)


def signature(df: DataFrame, *stamps: str) -> DataFrame:
    """Count and greatest stamps: enough to tell that a list has changed."""
    return df.agg(F.count(F.lit(1)).alias("n"), *[F.max(c).alias(f"max_{c}") for c in stamps])


def top_by(df: DataFrame, keys: list[str], sort: list[Column], k: int) -> DataFrame:
    """The first k rows of each key, with ``place`` from 1 and ``overflow``, the number of rows beyond."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys)
    ranked = df.withColumn("place", F.row_number().over(w.orderBy(*sort))).withColumn(
        "overflow", F.greatest(F.lit(0), F.count(F.lit(1)).over(w) - k)
    )
    return ranked.filter(F.col("place") <= k)

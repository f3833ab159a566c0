"""The read and write routes of the listing service as functions over DataFrames: each returns a plan, none collects.

Tables: ``listings``, ``occurrences``, and per user ``state`` (viewed, favorite, archived, tracking, ...) and ``score``
(match, opportunity, visit, risk, matches).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listloom.operators import filters, lists, stores


def list_listings(
    listings: DataFrame,
    state: DataFrame | None = None,
    score: DataFrame | None = None,
    user: int | None = None,
    criteria: filters.Criteria | None = None,
    traits: filters.Traits | None = None,
    city: str | None = None,
    mode: str = "priority",
    limit: int = 30,
    offset: int = 0,
) -> DataFrame:
    """A page of listings: of the default city for strangers, of what matches for a user who is signed in."""
    if user is None:
        kept = listings.filter(filters.anonymous_catalogue(city or ""))
    else:
        kept = lists.overlay(listings, state, score, user).filter(filters.signed_in() & ~F.col("archived"))
        kept = kept.withColumn("priority", lists.priority(F.col("match"), F.col("opportunity"), F.col("visit"), F.col("risk")))
    if criteria is not None:
        kept = kept.filter(filters.live_numbers(criteria))
    if traits is not None:
        kept = kept.filter(filters.trait_conditions(traits))
    return lists.page(kept, lists.order(mode, anonymous=user is None), limit, offset)


def listing_detail(listings: DataFrame, occurrences: DataFrame, listing_id: int) -> DataFrame:
    """One listing with the ads that it holds."""
    ads = occurrences.filter(F.col("listing_id") == listing_id).groupBy("listing_id").agg(
        F.array_sort(F.collect_list(F.struct(*[c for c in occurrences.columns if c != "listing_id"]))).alias("occurrences")
    )
    return listings.filter(F.col("id") == listing_id).join(ads.withColumnRenamed("listing_id", "id"), "id", "left")


def patch_state(state: DataFrame, changes: DataFrame) -> DataFrame:
    """The next states after a user's marks; unknown values leave what was."""
    return stores.upsert_state(state, changes)


def add_contact(contacts: DataFrame, new: DataFrame) -> DataFrame:
    """The next contacts: ``new(user_id, listing_id, at)`` numbered after those that the user had with the listing."""
    before = contacts.groupBy("user_id", "listing_id").agg(F.count(F.lit(1)).cast("int").alias("follow_up"))
    numbered = new.join(before, ["user_id", "listing_id"], "left").withColumn("follow_up", F.coalesce("follow_up", F.lit(0)))
    return contacts.unionByName(numbered)


def list_agencies(occurrences: DataFrame) -> DataFrame:
    """Agencies with the number of their living listings, their sources and last sighting, largest first."""
    living = occurrences.filter(F.col("agency").isNotNull() & (F.col("lifecycle") != "inactive"))
    return living.groupBy("agency").agg(
        F.countDistinct("listing_id").alias("listings"),
        F.array_join(F.array_sort(F.collect_set("source_id")), ",").alias("sources"),
        F.max("last_seen").alias("last_seen"),
    ).orderBy(F.desc("listings"), "agency")


def agency_listings(listings: DataFrame, occurrences: DataFrame, agency: str) -> DataFrame:
    own = occurrences.filter(F.col("agency") == agency).select(F.col("listing_id").alias("id"))
    return listings.join(own, "id", "left_semi")


def list_alerts(state: DataFrame, seen_at, user: int, limit: int = 200) -> DataFrame:
    """What a user was told of, newest first, and whether it is new since they last looked."""
    own = state.filter((F.col("user_id") == user) & F.col("notified_at").isNotNull())
    return own.withColumn("unread", F.col("notified_at") > seen_at).orderBy(F.desc("notified_at"), "id").limit(limit)


def list_districts(listings: DataFrame) -> DataFrame:
    living = listings.filter((F.col("lifecycle") != "inactive") & F.col("district").isNotNull())
    return living.groupBy("district").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "district")


def list_sources(states: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Descriptors with what their runs came to."""
    return descriptors.join(states, "source_id", "left").orderBy("priority", "source_id")


def stats(listings: DataFrame, state: DataFrame, score: DataFrame, user: int) -> DataFrame:
    """One row: listings that match, are uncertain, active; and what the user did with those that match."""
    rows = lists.overlay(listings, state, score, user)
    ok = F.coalesce("matches", F.lit(False))
    return rows.agg(
        F.count(F.lit(1)).alias("listings"), F.count_if(ok).alias("matching"),
        F.count_if(F.col("lifecycle") == "possiblyInactive").alias("uncertain"), F.count_if(F.col("lifecycle") == "active").alias("active"),
        *[F.count_if(ok & F.col(c)).alias(c) for c in ("viewed", "favorite", "archived")],
    )

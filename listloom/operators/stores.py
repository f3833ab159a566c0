"""Incremental stores: snapshots rewritten by joins, each as (old, new) to the next one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fingerprint(names: list[str]) -> Column:
    """A digest of the named columns, unknown values included."""
    return F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256)


def changed_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` that ``old`` lacks or has otherwise, with action inserted or updated. Only keys and digests of
    the old rows take part."""
    values = [c for c in new.columns if c not in keys]
    known = old.select(*keys, fingerprint(values).alias("_was"))
    marked = new.withColumn("_is", fingerprint(values)).join(known, keys, "left")
    changed = marked.filter(~F.col("_is").eqNullSafe(F.col("_was")))
    return changed.withColumn("action", F.when(F.col("_was").isNull(), "inserted").otherwise("updated")).drop("_is", "_was")


def upsert_listings(old: DataFrame, groups: DataFrame, members: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The next (listings, memberships, user states).

    ``groups(id, ...)`` are the new listings, ``members(occurrence_id, id)`` whom they hold, ``old(id, ...)`` the stored
    ones and ``state(id, user_id, ...)`` what users did. A stored listing that is no group any more hands its states to
    the group that now holds the occurrence it was named after, and goes; where no group does, it goes only if no user
    has decided on it. States that meet are merged: flags by their greatest, the first notification, and the state of
    contact that went furthest.
    """
    gone = old.join(groups.select("id"), "id", "left_anti").select("id")
    moved = gone.join(members.select(F.col("occurrence_id").alias("id"), F.col("id").alias("successor")), "id", "left")
    handed = state.join(moved, "id", "left").withColumn("id", F.coalesce("successor", "id")).drop("successor")
    states = merged_states(handed)
    orphans = moved.filter("successor is null").select("id")
    decided = states.filter(F.col("favorite") | F.col("archived") | (F.coalesce("tracking", F.lit("new")) != "new"))
    kept = old.join(orphans.join(decided, "id", "left_semi"), "id", "left_semi")
    listings = groups.unionByName(kept, allowMissingColumns=True)
    return listings, members, states.join(listings.select("id"), "id", "left_semi")


#: How far a contact has gone; the furthest wins where states meet. Fixed values.
STAGES = ("new", "ignored", "rejected", "toContact", "contacted", "replied", "visitOffered", "visitScheduled", "visited", "rented")


def stage_rank(tracking: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.coalesce(tracking, F.lit("new")))


def merged_states(state: DataFrame) -> DataFrame:
    """One row for each (id, user_id)."""
    furthest = F.max(F.struct(stage_rank(F.col("tracking")).alias("r"), F.coalesce("tracking", F.lit("new")).alias("t")))
    return state.groupBy("id", "user_id").agg(
        *[F.max(F.coalesce(c, F.lit(False))).alias(c) for c in ("viewed", "favorite", "archived")],
        furthest["t"].alias("tracking"),
        F.min("notified_at").alias("notified_at"),
    )


def upsert_state(old: DataFrame, changes: DataFrame) -> DataFrame:
    """User states after ``changes``, where a null leaves what was; the first notification stays."""
    keys = ["id", "user_id"]
    named = changes.select(*keys, *[F.col(c).alias(f"new_{c}") for c in changes.columns if c not in keys])
    both = old.join(named, keys, "full")

    def value(c: str) -> Column:
        new = F.col(f"new_{c}") if f"new_{c}" in both.columns else F.lit(None)
        return F.coalesce(c, new) if c == "notified_at" else F.coalesce(new, F.col(c))

    return both.select(*keys, *[value(c).alias(c) for c in old.columns if c not in keys])


def realigned(rows: DataFrame) -> DataFrame:
    """``rows(id, source_id, source_ref, ...)`` with ids made of source and reference, unless that id is taken."""
    natural = F.concat_ws(":", "source_id", "source_ref")
    taken = rows.select(F.col("id").alias("_natural")).distinct().withColumn("_taken", F.lit(True))
    one = Window.partitionBy("_natural").orderBy("id")
    wanted = rows.withColumn("_natural", natural).withColumn("_place", F.row_number().over(one))
    marked = wanted.join(taken, "_natural", "left")
    free = F.col("_taken").isNull() & (F.col("_place") == 1)
    return marked.withColumn("id", F.when(free, F.col("_natural")).otherwise(F.col("id"))).drop("_natural", "_taken", "_place")


def refilled(stored: DataFrame, derived: DataFrame, key: str, names: list[str]) -> DataFrame:
    """``stored`` with its gaps filled from what was derived anew; known values stay."""
    again = derived.select(key, *[F.col(c).alias(f"_{c}") for c in names])
    joined = stored.join(again, key, "left")
    return joined.withColumns({c: F.coalesce(c, f"_{c}") for c in names}).drop(*[f"_{c}" for c in names])


def source_states(old: DataFrame, runs: DataFrame) -> DataFrame:
    """Source states after ``runs(source_id, ran_at, ok, found)``: the last run and success, failures in a row at the end,
    and what the last success found."""
    new = runs.groupBy("source_id").agg(
        F.max("ran_at").alias("run_at"),
        F.max(F.when(F.col("ok"), F.col("ran_at"))).alias("ok_at"),
        F.max_by(F.when(F.col("ok"), F.col("found")), F.when(F.col("ok"), F.col("ran_at"))).alias("found_now"),
    )
    late = runs.join(new.select("source_id", "ok_at"), "source_id").filter("ok_at is null or ran_at > ok_at")
    failed = late.groupBy("source_id").agg(F.count(F.lit(1)).alias("failed"))
    both = old.join(new.join(failed, "source_id", "left"), "source_id", "full")
    before = F.when(F.col("ok_at").isNull(), F.coalesce("errors", F.lit(0))).otherwise(F.lit(0))
    return both.select(
        "source_id", F.greatest("last_run", "run_at").alias("last_run"), F.greatest("last_success", "ok_at").alias("last_success"),
        (before + F.coalesce("failed", F.lit(0))).cast("int").alias("errors"), F.coalesce("found_now", "found").alias("found"),
    )


def closed(text: Column, phrases: tuple[str, ...]) -> Column:
    """The page itself says that the offer is over."""
    return reduce(lambda a, p: a | F.contains(F.lower(text), F.lit(p)), phrases, F.lit(False))


#: Order of a source's page: what lives first. Fixed values.
LIFECYCLES = ("active", "possiblyInactive", "inactive")


def by_lifecycle(lifecycle: Column) -> Column:
    """Sort key of a source's page; unknown states come last."""
    place = F.array_position(F.array(*[F.lit(s) for s in LIFECYCLES]), lifecycle)
    return F.when(place > 0, place).otherwise(len(LIFECYCLES) + 1)

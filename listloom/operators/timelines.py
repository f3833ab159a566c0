"""Snapshots, history, lifecycle and survival over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNCERTAIN_AFTER, GONE_AFTER = 2, 3


def fingerprint(*columns: str) -> Column:
    """32 hex characters over an ordered list of fields; nulls count."""
    return F.substring(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256), 1, 32)


def upsert(old: DataFrame, new: DataFrame, key: str, compared: list[str], seen: str) -> DataFrame:
    """The next snapshot with ``change``: inserted, updated, unchanged (only touched) or missing. First sightings last."""
    o = old.select(*[F.col(c).alias(f"o_{c}") for c in old.columns])
    n = new.select(*[F.col(c).alias(f"n_{c}") for c in new.columns])
    both = o.join(n, F.col(f"o_{key}") == F.col(f"n_{key}"), "full_outer")
    same = F.lit(True)
    for c in compared:
        same = same & F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}"))
    change = (
        F.when(F.col(f"n_{key}").isNull(), "missing").when(F.col(f"o_{key}").isNull(), "inserted")
        .when(same, "unchanged").otherwise("updated")
    )
    gone = F.col(f"n_{key}").isNull()
    kept = [F.when(gone, F.col(f"o_{c}")).otherwise(F.col(f"n_{c}")).alias(c) for c in compared]
    return both.select(
        F.coalesce(f"n_{key}", f"o_{key}").alias(key),
        *kept,
        F.coalesce(f"o_{seen}", f"n_{seen}").alias(f"first_{seen}"),
        F.coalesce(f"n_{seen}", f"o_{seen}").alias(f"last_{seen}"),
        change.alias("change"),
    )


def change_kind(old_price: Column, price: Column, old_area: Column, area: Column, old_free: Column, free: Column) -> Column:
    """price-drop, price-rise (also from unknown), area, availability or multiple; null without a change."""
    moved = [~a.eqNullSafe(b) for a, b in ((old_price, price), (old_area, area), (old_free, free))]
    count = sum((F.when(m, 1).otherwise(0) for m in moved), F.lit(0))
    return (
        F.when(count == 0, None).when(count > 1, "multiple")
        .when(moved[0], F.when(price < old_price, "price-drop").otherwise("price-rise"))
        .when(moved[1], "area").otherwise("availability")
    )


def missing_ladder(runs: Column, lifecycle: Column) -> Column:
    return F.when(runs >= GONE_AFTER, "inactive").when(runs >= UNCERTAIN_AFTER, "possiblyInactive").otherwise(lifecycle)


def absence_is_believable(known: Column, seen: Column) -> Column:
    """A run that found less than half of ten or more known ads, or nothing, says nothing about the rest."""
    return (seen > 0) & ~((known >= 10) & (seen * 2 < known))


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86400e6)


def expired(lifecycle: Column, last: Column, now: Column, uncertain: float = 4, gone: float = 10) -> Column:
    age = days_between(now, last)
    return F.when(age > gone, "inactive").when(age > uncertain, "possiblyInactive").otherwise(lifecycle)


def inherited_state(states: DataFrame, survivor: str) -> DataFrame:
    """User state of merged groups: flags by maximum, earliest notice, the furthest tracking; never a step back."""
    rank = F.when(F.col("tracking") == "visited", 4).when(F.col("tracking") == "contacted", 3).when(
        F.col("tracking") == "rejected", 2
    ).when(F.col("tracking") == "new", 1).otherwise(0)
    return states.groupBy(survivor, "user_id").agg(
        *[F.max(c).alias(c) for c in ("viewed", "favorite", "archived")],
        F.max_by("tracking", rank).alias("tracking"),
        F.min("acted_at").alias("acted_at"),
    )


# --------------------------------------------------------------------------------------------------------------------
# survival


def cohort(occurrences: DataFrame, one_shot: list[str], stock_batch: int = 15) -> DataFrame:
    """(group_id, days, ended): lifetimes of groups that did not begin as stock.

    Stock is a sighting within a day of its source's first one, or in a batch of more than ``stock_batch`` of one source
    and moment, when it is the group's own first sighting; one-shot sources tell nothing about lifetimes.
    """
    rows = occurrences.filter(~F.col("source_id").isin(*one_shot))
    starts = rows.groupBy("source_id").agg(F.min("first_seen").alias("source_start"))
    batches = rows.groupBy("source_id", "first_seen").agg(F.count(F.lit(1)).alias("batch"))
    groups = rows.groupBy("group_id").agg(
        F.min("first_seen").alias("born"), F.max("last_seen").alias("last"), F.min(F.when(F.col("lifecycle") == "inactive", 1).otherwise(0)).alias("ended")
    )
    stock = (
        rows.join(starts, "source_id").join(batches, ["source_id", "first_seen"])
        .filter((days_between(F.col("first_seen"), F.col("source_start")) <= 1) | (F.col("batch") > stock_batch))
        .select("group_id", F.col("first_seen").alias("born")).distinct()
    )
    return groups.join(stock, ["group_id", "born"], "left_anti").select(
        "group_id", days_between(F.col("last"), F.col("born")).alias("days"), (F.col("ended") == 1).alias("ended")
    )


def survival_curve(lifetimes: DataFrame) -> DataFrame:
    """Kaplan-Meier: (day, at_risk, deaths, share) at each day with deaths; days that are null, NaN, infinite or negative
    do not count. The share stays 0 once it is 0."""
    valid = lifetimes.filter("days is not null and not isnan(days) and days >= 0 and days < double('infinity')")
    days = valid.groupBy("days").agg(F.count(F.lit(1)).alias("n"), F.count_if("ended").alias("deaths"))
    days = days.withColumn("whole", F.floor("days"))
    # Running sums in two steps: inside a whole day, and over the whole days, of which there are few.
    inside = Window.partitionBy("whole").orderBy(F.desc("days")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = Window.orderBy(F.desc("whole")).rowsBetween(Window.unboundedPreceding, -1)
    totals = days.groupBy("whole").agg(F.sum("n").alias("total"))
    beyond = totals.select("whole", F.coalesce(F.sum("total").over(later), F.lit(0)).alias("beyond"))
    at_risk = days.withColumn("own", F.sum("n").over(inside)).join(beyond, "whole")
    at_risk = at_risk.withColumn("at_risk", F.col("own") + F.col("beyond")).filter("deaths > 0")
    alive = 1 - F.col("deaths") / F.col("at_risk")
    steps = at_risk.select(
        "whole", "days", "at_risk", "deaths",
        F.when(alive <= 0, 1).otherwise(0).alias("over"), F.log(F.when(alive > 0, alive).otherwise(1.0)).alias("log"),
    )
    before = Window.orderBy("whole").rowsBetween(Window.unboundedPreceding, -1)
    sums = steps.groupBy("whole").agg(F.sum("log").alias("log"), F.max("over").alias("over"))
    past = sums.select(
        "whole", F.coalesce(F.sum("log").over(before), F.lit(0.0)).alias("past"), F.coalesce(F.max("over").over(before), F.lit(0)).alias("ended")
    )
    upto = Window.partitionBy("whole").orderBy("days").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = steps.withColumns({"log": F.sum("log").over(upto), "over": F.max("over").over(upto)}).join(past, "whole")
    zero = (F.col("over") == 1) | (F.col("ended") == 1)
    return run.select(
        F.col("days").alias("day"), "at_risk", "deaths", F.when(zero, 0.0).otherwise(F.exp(F.col("past") + F.col("log"))).alias("share")
    )


def survival_summary(lifetimes: DataFrame, curve: DataFrame, marks: tuple[int, ...] = (1, 3, 7)) -> DataFrame:
    """One row: median (first day with a share of at most one half), horizon, completed, censored, at risk and share
    alive at the marks (null beyond the horizon)."""
    valid = lifetimes.filter("days is not null and not isnan(days) and days >= 0")
    ends = valid.agg(
        F.max("days").alias("horizon"),
        F.count_if("ended").alias("completed"),
        F.count_if(~F.col("ended")).alias("censored"),
        *[F.count_if(F.col("days") >= m).alias(f"at_risk_{m}") for m in marks],
    )
    steps = curve.agg(
        F.min(F.when(F.col("share") <= 0.5, F.col("day"))).alias("median"),
        *[F.coalesce(F.max_by("share", F.when(F.col("day") <= m, F.col("day"))), F.lit(1.0)).alias(f"s{m}") for m in marks],
    )
    alive = [F.when(F.col("horizon") >= m, F.col(f"s{m}")).alias(f"alive_{m}") for m in marks]
    return ends.crossJoin(steps).select(
        "median", "horizon", "completed", "censored", *[f"at_risk_{m}" for m in marks], *alive
    )


def moving_average(values: Column, keep: float = 0.7) -> Column:
    """Over an ordered array: keep * old + (1 - keep) * new, rounded to 2 decimals at each step."""
    start = F.try_element_at(values, F.lit(1))
    rest = F.slice(values, 2, F.greatest(F.lit(0), F.size(values) - 1))
    return F.aggregate(rest, start, lambda a, v: F.floor((keep * a + (1 - keep) * v) * 100 + 0.5) / 100)

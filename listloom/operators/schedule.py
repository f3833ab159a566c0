"""Scheduling of sources: interval, decision, plan and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STARVING = 4.0


def effective_interval() -> Column:
    """Minutes: half when three or more new ads are usual, double when none are but runs have succeeded, double again for
    each error, within the source's bounds."""
    base = F.col("interval").cast("double")
    paced = F.when(F.col("average_new") >= 3, base / 2).when((F.col("average_new") == 0) & F.col("succeeded"), base * 2).otherwise(base)
    return F.greatest(F.col("least"), F.least(F.col("most"), paced * F.pow(F.lit(2.0), F.col("errors"))))


def decisions(states: DataFrame, now_minute: Column) -> DataFrame:
    """Adds effective, overdue (elapsed over effective), due and reason."""
    df = states.withColumn("effective", effective_interval())
    elapsed = now_minute - F.col("last_run")
    reason = (
        F.when(~F.col("enabled"), "disabled").when(F.col("blocked"), "blocked")
        .when(F.col("cooldown_until") > now_minute, "cooldown").when(F.col("last_run").isNull(), "never run")
        .when(elapsed >= F.col("effective"), "due").otherwise("too early")
    )
    return df.withColumns({"overdue": elapsed / F.col("effective"), "reason": reason}).withColumn(
        "due", F.col("reason").isin("never run", "due")
    )


def plan(decided: DataFrame, slots: int) -> DataFrame:
    """The first ``slots`` due sources: starving ones by overdue ratio, then by priority, then the oldest run (never run
    first), then by id; the others are skipped."""
    starving = F.coalesce(F.col("overdue") >= STARVING, F.lit(False))
    w = Window.orderBy(
        starving.desc(), F.when(starving, F.col("overdue")).desc_nulls_last(), F.col("priority").asc(),
        F.col("last_run").asc_nulls_first(), F.col("source_id"),
    )
    place = F.row_number().over(w)
    return decided.filter("due").withColumn("place", place).withColumn("selected", F.col("place") <= slots)


def health(status: Column, pages: Column, found: Column) -> Column:
    """blocked (401, 403), cooldown (429), degraded (pages but nothing found), healthy."""
    return (
        F.when(status.isin(401, 403), "blocked").when(status == 429, "cooldown")
        .when((pages > 0) & (found == 0), "degraded").otherwise("healthy")
    )


def crawl_budget(items: DataFrame, budget: int, stale_days: float = 7) -> DataFrame:
    """Detail pages worth a visit: unseen, then known without memory, then stale, then the rest; in page order."""
    rank = (
        F.when(~F.col("known"), 0).when(F.col("remembered_days").isNull(), 1)
        .when(F.col("remembered_days") > stale_days, 2).otherwise(3)
    )
    return items.withColumn("rank", rank).orderBy("rank", "position").limit(budget)


def pages_until_known(pages: DataFrame, ratio: float | None = None) -> DataFrame:
    """Pages up to the first whose refs are all known (or known to the ratio); ``pages``: source_id, page, ref, known."""
    share = F.avg(F.col("known").cast("int"))
    full = pages.groupBy("source_id", "page").agg(share.alias("share")).filter(F.col("share") >= (ratio or 1.0))
    stop = full.groupBy("source_id").agg(F.min("page").alias("stop"))
    return pages.join(stop, "source_id", "left").filter(F.col("stop").isNull() | (F.col("page") <= F.col("stop"))).drop("stop")

"""Source adapters: what a run of a source reads, confirms and leaves, as DataFrame plans.

The network is not part of them: pages are landed beforehand (``pages(url, html)``), and a run plans over those.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import pages as extract


@dataclass
class ScrapeResult:
    """A run's raw listings, the refs it confirms as alive, and what it has not read (refs over the budget)."""

    listings: DataFrame
    confirmed: DataFrame
    left: DataFrame

    def counts(self) -> DataFrame:
        """(kind, n) of the three, with the stop reason: budget where refs are left, else exhausted."""
        parts = [
            df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
            for kind, df in (("listings", self.listings), ("confirmed", self.confirmed), ("left", self.left))
        ]
        out = parts[0].unionByName(parts[1]).unionByName(parts[2])
        over = F.max(F.when((F.col("kind") == "left") & (F.col("n") > 0), 1)).over(Window.partitionBy())
        return out.withColumn("stop", F.when(over == 1, "budget").otherwise("exhausted"))


@dataclass(frozen=True)
class SitemapAdapter:
    """A site that lists its offers in sitemaps: entries of the wanted places younger than ``newest`` count; known refs
    are confirmed without a visit; of the others the ``budget`` latest are read; closed pages give no listing."""

    source_id: str
    places: tuple[str, ...]
    newest: str
    budget: int
    closed: tuple[str, ...] = ()

    def run(self, entries: DataFrame, landed: DataFrame, known: DataFrame) -> ScrapeResult:
        """``entries(loc, lastmod)``, ``landed(url, html)``, ``known(loc)``."""
        confirmed, visit = extract.crawl_candidates(entries, known, self.newest, self.budget, list(self.places))
        fresh = extract.wanted_entries(entries, self.newest, list(self.places)).join(known, "loc", "left_anti")
        left = fresh.join(visit.select("loc"), "loc", "left_anti").select("loc")
        read = visit.select(F.col("loc").alias("url")).join(landed.select("url", "html"), "url")
        text = extract.lined_text(F.col("html"))
        open_page = F.lit(True)
        for phrase in self.closed:
            open_page = open_page & ~F.contains(F.lower(text), F.lit(phrase))
        listings = read.filter(open_page).select(
            F.lit(self.source_id).alias("source_id"),
            F.regexp_extract("url", "([^/?#]+)/?(?:[?#].*)?$", 1).alias("source_ref"),
            F.col("url").alias("source_url"),
            F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
            text.alias("description"),
        )
        return ScrapeResult(listings, confirmed.select("loc"), left)


def paged_scan(pages: DataFrame, size: int) -> DataFrame:
    """``pages(source_id, page, rows, total, status, remembered)`` from 1: (source_id, last_page, reason, outcome).

    A source is read up to its first page that is short, that reaches the reported total, or that is unchanged (304) and
    remembered as short; else to the end of what there is. An unchanged page that nothing is remembered of makes the
    run count as not modified.
    """
    got = F.when(F.col("status") == 304, F.col("remembered")).otherwise(F.col("rows"))
    reason = (
        F.when((F.col("status") == 304) & (F.col("remembered") < size), "remembered")
        .when(got < size, "short")
        .when(F.col("page") * size >= F.col("total"), "total")
    )
    marked = pages.withColumn("reason", reason)
    stops = marked.groupBy("source_id").agg(
        F.min(F.when(F.col("reason").isNotNull(), F.struct("page", "reason"))).alias("stop"), F.max("page").alias("end")
    )
    last = stops.select(
        "source_id", F.coalesce("stop.page", "end").alias("last_page"), F.coalesce("stop.reason", F.lit("end")).alias("reason")
    )
    unknown = (F.col("status") == 304) & F.col("remembered").isNull()
    blind = pages.filter(unknown).groupBy("source_id").agg(F.min("page").alias("blind"))
    outcome = F.when(F.coalesce(F.col("blind") <= F.col("last_page"), F.lit(False)), "notModified").otherwise("ok")
    return last.join(blind, "source_id", "left").select("source_id", "last_page", "reason", outcome.alias("outcome"))


def full_pass(last_full: Column, now: Column, backfill: Column, hours: int = 6) -> Column:
    """Whether a run has to read everything: none was full, the last full one is long past, or a backfill is on."""
    return backfill | last_full.isNull() | (F.unix_timestamp(now) - F.unix_timestamp(last_full) >= hours * 3600)


def pages_of_run(pages: DataFrame, due: DataFrame) -> DataFrame:
    """``pages(source_id, page, known)`` with all refs of a page known or not, ``due(source_id, full)``: (source_id, page,
    full) of the pages read. A run that is not full stops at the first page of known refs only; one that reaches the end
    counts as full."""
    first = pages.filter("known").groupBy("source_id").agg(F.min("page").alias("stop"))
    ends = pages.groupBy("source_id").agg(F.max("page").alias("end"))
    plan = due.join(first, "source_id", "left").join(ends, "source_id").select(
        "source_id",
        F.when(F.col("full"), F.col("end")).otherwise(F.coalesce("stop", "end")).alias("upto"),
        (F.col("full") | F.col("stop").isNull()).alias("full"),
    )
    return pages.join(plan, "source_id").filter("page <= upto").select("source_id", "page", "full")

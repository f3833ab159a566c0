"""Predicates of the list query; one set of builders serves lists and alerts alike. Unknown passes unless said."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Criteria:
    """What a user looks for; bounds may be columns, where every row has its own. ``checked`` refuses bounds that
    contradict each other."""

    max_price: float | None = None
    min_price: float | None = None
    min_area: float | None = None
    city: str | None = None
    postal_codes: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    furnished: bool | None = None

    def checked(self, fallback: Criteria) -> Criteria:
        numbers = (self.max_price, self.min_price, self.min_area)
        bad = any(n is not None and (not isinstance(n, int | float) or n < 0) for n in numbers)
        crossed = None not in (self.min_price, self.max_price) and self.min_price > self.max_price
        return fallback if bad or crossed else self


@dataclass(frozen=True)
class Traits:
    flat_share: str = "any"  # any | only | none
    student: str = "any"  # any | none
    landlord: str = "any"  # any | agency | private
    furnished: str = "any"  # any | yes | no
    max_commute: int | None = None
    available_by: str | None = None  # a day; availability up to its end passes
    districts: tuple[str, ...] = ()
    unknown_district: bool = True


def everything(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def at_most(column: str, bound: float | None) -> Column:
    return F.lit(True) if bound is None else F.col(column).isNull() | (F.col(column) <= bound)


def at_least(column: str, bound: float | None) -> Column:
    return F.lit(True) if bound is None else F.col(column).isNull() | (F.col(column) >= bound)


def live_numbers(c: Criteria) -> Column:
    return everything([at_most("price", c.max_price), at_least("price", c.min_price), at_least("area", c.min_area)])


def trait_conditions(t: Traits) -> Column:
    parts = []
    if t.flat_share != "any":
        parts.append(F.coalesce(F.col("flat_share"), F.lit(t.flat_share == "only")) == F.lit(t.flat_share == "only"))
    if t.student == "none":
        parts.append(~F.coalesce("student_only", F.lit(False)))
    if t.landlord == "agency":  # the one filter that wants a known value
        parts.append(F.coalesce(F.col("landlord") == "agency", F.lit(False)))
    elif t.landlord == "private":
        parts.append(F.coalesce(F.col("landlord") != "agency", F.lit(True)))
    if t.furnished != "any":
        parts.append(F.coalesce(F.col("furnished"), F.lit(t.furnished == "yes")) == F.lit(t.furnished == "yes"))
    if t.max_commute is not None:
        parts.append(at_most("commute", t.max_commute))
    if t.available_by is not None:
        end = F.date_add(F.to_date(F.lit(t.available_by)), 1).cast("timestamp")
        parts.append(F.col("available_at").isNull() | (F.col("available_at") < end))
    if t.districts:
        known = F.col("district").isin(*t.districts)
        parts.append(F.coalesce(known, F.lit(t.unknown_district)))
    return everything(parts)


def residential(column: str = "property_type") -> Column:
    return ~F.col(column).isin("parking", "office")


def anonymous_catalogue(default_city: str) -> Column:
    return (F.col("lifecycle") != "inactive") & residential() & (F.col("city") == default_city)


def signed_in() -> Column:
    return F.coalesce("matches", F.lit(False)) & (F.col("lifecycle") != "inactive")


def quick_filters(
    max_price=None, min_area=None, rooms=None, occupants=None, types: tuple[str, ...] = ()
) -> Column:
    """The strict ones: an unknown price, area or number of rooms fails, and so does an unknown type when types are
    chosen; unknown occupants pass."""
    parts = []
    if max_price is not None:
        parts.append(F.coalesce(F.col("price") <= max_price, F.lit(False)))
    if min_area is not None:
        parts.append(F.coalesce(F.col("area") >= min_area, F.lit(False)))
    if rooms is not None:
        parts.append(F.coalesce(F.col("rooms") >= rooms, F.lit(False)))
    if occupants is not None:
        parts.append(F.coalesce(F.col("max_occupants") >= occupants, F.lit(True)))
    if types:
        parts.append(F.coalesce(F.col("property_type").isin(*types), F.lit(False)))
    return everything(parts)


def from_sources(occurrences: Column, chosen: list[str]) -> Column:
    """Any nested occurrence is of a chosen source."""
    return F.arrays_overlap(F.transform(occurrences, lambda o: o["source_id"]), F.array(*[F.lit(s) for s in chosen]))


def commute_exceeds(distances: Column, limit: int) -> Column:
    return F.coalesce(F.exists(distances, lambda d: (d["mode"] == "transit") & (d["minutes"] > limit)), F.lit(False))


def eligibility(min_income: Column, situations: Column, income: Column, gross: Column, situation: Column) -> Column:
    """unknown | eligible | income | situation. Gross income is made net; 5 % short is still enough."""
    net = F.when(gross, income / 1.23).otherwise(income)
    short = min_income.isNotNull() & net.isNotNull() & (net < 0.95 * min_income)
    wrong = (F.size(situations) > 0) & situation.isNotNull() & ~F.array_contains(situations, situation)
    nothing = (min_income.isNull() | net.isNull()) & ((F.size(situations) <= 0) | situation.isNull())
    return F.when(short, "income").when(wrong, "situation").when(nothing, "unknown").otherwise("eligible")


def first_failure(*guards: tuple[Column, str]) -> Column:
    """The reason of the first guard that fails, else null."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason)) for ok, reason in guards])


def plan_is_valid(status: Column, until: Column, now: Column) -> Column:
    return F.coalesce(status.isin("active", "trialing") & (until > now), F.lit(False))


def due(frequency: Column, last: Column, now: Column) -> Column:
    """Notification frequency: each run, hourly or daily."""
    seconds = F.when(frequency == "hourly", 3600).when(frequency == "daily", 86400).otherwise(0)
    return last.isNull() | (F.unix_timestamp(now) - F.unix_timestamp(last) >= seconds)




@dataclass(frozen=True)
class ContactLimits:
    """Least scores, the greatest risk, and quotas of automatic contact."""

    match: int
    opportunity: int
    visit: int
    risk: int
    per_hour: int
    per_day: int
    per_source: int


def contact_refusal(limits: ContactLimits) -> Column:
    """Why no message may be sent, else null: plan, switch, sources that want a person, listings already written to,
    scores, quotas, pause, channel. Reads paid, enabled, manual, before, the four scores, the counts hour, day, own (of
    the source) and lately, and channel."""
    return first_failure(
        (F.col("paid"), "plan"),
        (F.col("enabled"), "switch"),
        (~F.col("manual"), "manual"),
        (F.col("before") == 0, "contacted"),
        (F.col("match") >= limits.match, "match"),
        (F.col("opportunity") >= limits.opportunity, "opportunity"),
        (F.col("visit") >= limits.visit, "visit"),
        (F.col("risk") <= limits.risk, "risk"),
        (F.col("hour") < limits.per_hour, "hour"),
        (F.col("day") < limits.per_day, "day"),
        (F.col("own") < limits.per_source, "source"),
        (F.col("lately") == 0, "cooldown"),
        (F.col("channel"), "channel"),
    )

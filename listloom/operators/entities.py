"""Entity resolution: blocking, pair comparison, verdicts, constrained clustering and merge with provenance.

Occurrences come as a DataFrame with id, source_id and whatever is known of place, figures, contact, position, photos and
texts; ``prepared`` folds what is compared and fills in the columns that are missing. Pairs are made inside blocks of at
most ``MAX_BLOCK`` rows, which is counted before any pairing, so no block can grow into a quadratic one; ``skipped_blocks``
tells which were larger. Vetoes are applied inside the block join, on columns that the blocks' rows carry: only pairs
that pass them are made distinct and meet their texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listloom.functions.geo import haversine_km
from listloom.functions.listing import image_identity
from listloom.functions.parse import parse_requirements
from listloom.functions.text import comparable, jaccard, js_round, tokenize
from listloom.operators import clustering
from listloom.session import Scratch

MAX_BLOCK = 200
DUPLICATE, AMBIGUOUS = 70, 45
#: Columns that vetoes read, and those that only the score reads.
FACTS = ("source_id", "city", "price", "area", "rooms", "latitude", "longitude", "agency_key", "relays")
SIDES = (
    *FACTS, "postal_code", "phone", "email", "reference", "reference_key", "address_key", "district_key", "photos",
    "title_tokens", "description_tokens", "operator",
)
_RAW = {
    "city": "string", "postal_code": "string", "price": "double", "area": "double", "rooms": "int", "latitude": "double",
    "longitude": "double", "phone": "string", "email": "string", "reference": "string", "address": "string",
    "agency": "string", "district": "string", "title": "string", "description": "string", "images": "string",
    "charges": "double", "furnished": "boolean", "flat_share": "boolean", "max_occupants": "int", "views": "int",
    "favorites": "int", "published_at": "timestamp", "available_at": "timestamp",
}
_COMPARED = (
    "city", "postal_code", "price", "area", "rooms", "latitude", "longitude", "phone", "email", "reference", "address",
    "agency", "district", "title", "description", "images",
)
#: Points for what both sides share. Fixed values.
POINTS = {
    "photos": 45, "photo": 8, "phone": 40, "email": 35, "reference": 35, "address": 30, "position": 30, "price": 18,
    "area": 18, "exact_area": 30, "rooms": 6, "agency": 12, "postal_code": 4, "district": 12, "district_named": 8,
    "operator": 30, "title": 15, "description": 12,
}


def prepared(rows: DataFrame, relays: tuple[str, ...] = (), operators: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with the folded columns that pairs compare. ``relays``: sources that pass on the ads of others;
    ``operators``: who runs a source. ``images`` are addresses parted by commas."""
    have = set(rows.columns)
    full = rows.withColumns({c: F.lit(None).cast(_RAW[c]) for c in _COMPARED if c not in have})
    operator = F.lit(None).cast("string")
    for source, name in (operators or {}).items():
        operator = F.when(F.col("source_id") == source, name).otherwise(operator)
    made = {
        "relays": F.col("source_id").isin(*relays) if relays else F.lit(False),
        "operator": operator,
        "photos": F.array_distinct(F.array_compact(F.transform(F.split("images", ","), image_identity))),
        **{f"{c}_key": comparable(F.col(c)) for c in ("reference", "address", "agency", "district")},
        **{f"{c}_tokens": tokenize(F.col(c)) for c in ("title", "description")},
    }
    return full.withColumns({c: v for c, v in made.items() if c not in have})


def blocking_keys() -> Column:
    """Contact keys; references of four letters and more; 5 m2 and 50-unit buckets (rounded, each with its lower
    neighbour) per place; and both buckets together without a place, four ways. The place is the city, else the postal
    code, else a constant."""
    place = F.coalesce("city", "postal_code", F.lit("anywhere"))
    a, p = js_round(F.col("area") / 5), js_round(F.col("price") / 50)

    def key(kind: str, *parts: Column) -> Column:
        # Unknown parts make the key unknown.
        return F.concat(F.lit(kind), *[x for part in parts for x in (F.lit(":"), part.cast("string"))])

    keys = [
        key("tel", F.col("phone")),
        key("mail", F.col("email")),
        F.when(F.length("reference") >= 4, key("ref", F.col("reference_key"))),
        *[key("area", place, a - k) for k in (0, 1)],
        *[key("price", place, p - k) for k in (0, 1)],
        *[key("both", a - i, p - j) for i in (0, 1) for j in (0, 1)],
    ]
    return F.array_compact(F.array(*keys))


def _keyed(rows: DataFrame, *carried: str) -> DataFrame:
    return rows.select("id", *carried, F.explode(blocking_keys()).alias("key"))


def blocks(rows: DataFrame, *carried: str) -> DataFrame:
    """(key, id, carried columns) of blocks with 2..MAX_BLOCK rows."""
    keyed = _keyed(rows, *carried)
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(2, MAX_BLOCK))
    return keyed.join(sizes.drop("n"), "key")


def skipped_blocks(rows: DataFrame) -> DataFrame:
    """(key, n) of the blocks that are too large to be paired."""
    return _keyed(rows).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MAX_BLOCK)


def candidate_pairs(rows: DataFrame) -> DataFrame:
    """Each unordered pair of ids that shares a block, once."""
    held = blocks(rows)
    left = held.select("key", F.col("id").alias("left_id"))
    right = held.select("key", F.col("id").alias("right_id"))
    return left.join(right, "key").filter("left_id < right_id").select("left_id", "right_id").distinct()


def possible_pairs(rows: DataFrame) -> DataFrame:
    """As ``candidate_pairs``, without those that a veto tells apart."""
    held = blocks(rows, *FACTS)
    left, right = (
        held.select("key", F.col("id").alias(f"{side}_id"), *[F.col(c).alias(f"{side[0]}_{c}") for c in FACTS])
        for side in ("left", "right")
    )
    free = left.join(right, "key").filter(F.col("left_id") < F.col("right_id")).filter(~blocked())
    return free.select("left_id", "right_id").distinct()


def with_sides(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    left = rows.select(F.col("id").alias("left_id"), *[F.col(c).alias(f"l_{c}") for c in SIDES])
    right = rows.select(F.col("id").alias("right_id"), *[F.col(c).alias(f"r_{c}") for c in SIDES])
    return pairs.join(left, "left_id").join(right, "right_id")


def _sides(c: str) -> tuple[Column, Column]:
    return F.col(f"l_{c}"), F.col(f"r_{c}")


def _known(*columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        a, b = _sides(c)
        out = out & a.isNotNull() & b.isNotNull()
    return out


def _same(c: str) -> Column:
    a, b = _sides(c)
    return F.coalesce(a == b, F.lit(False))


def _near(c: str, absolute: float, relative: float) -> Column:
    a, b = _sides(c)
    return F.abs(a - b) <= F.greatest(F.lit(absolute), relative * F.greatest(a, b))


def _apart(c: str, absolute: float, relative: float) -> Column:
    return _known(c) & ~_near(c, absolute, relative)


def _has_decimals(x: Column) -> Column:
    return F.abs(x - js_round(x)) > 0.004


def _km() -> Column:
    return haversine_km(F.col("l_latitude"), F.col("l_longitude"), F.col("r_latitude"), F.col("r_longitude"))


def same_source_conflict() -> Column:
    """Two ads of one source are two dwellings when their price differs, or their area is not the same up to rounding.
    A source that relays is excused where the ads name two agencies."""
    price = _known("price") & (F.abs(F.col("l_price") - F.col("r_price")) > clustering.PRICE_STEP)
    area = _known("area") & ~clustering.same_area(*_sides("area"))
    two_agencies = F.coalesce(F.col("l_agency_key") != F.col("r_agency_key"), F.lit(False))
    one_source = (F.col("l_source_id") == F.col("r_source_id")) & ~(F.col("l_relays") & two_agencies)
    return F.coalesce(one_source & (price | area), F.lit(False))


def blocked() -> Column:
    """Hard vetoes; unknown values cannot veto."""
    differs = lambda c: _known(c) & (F.col(f"l_{c}") != F.col(f"r_{c}"))
    far = _known("latitude", "longitude") & (_km() > 0.5)
    parts = differs("city") | _apart("area", 2.0, 0.05) | _apart("price", 30.0, 0.06) | differs("rooms") | far
    return F.coalesce(parts, F.lit(False)) | same_source_conflict()


def _photo_points(cross: Column) -> Column:
    """All photos alike, or some; within one source that does not relay only a set of two or more counts."""
    a, b = _sides("photos")
    common = F.coalesce(F.size(F.array_intersect(a, b)), F.lit(0))
    own = ~cross & ~F.col("l_relays")
    whole = (common == F.size(a)) & (common == F.size(b))
    return (
        F.when(common <= 0, 0)
        .when(whole, F.when(~own | (common >= 2), POINTS["photos"]).otherwise(0))
        .otherwise(F.when(own, 0).otherwise(POINTS["photo"]))
    )


def pair_score() -> Column:
    """Points for what both sides know and share, 100 at most."""
    cross = F.col("l_source_id") != F.col("r_source_id")
    area, other_area = _sides("area")
    same_figure = F.abs(area - other_area) < 0.005
    here, there = _sides("district_key")
    flags = {
        "phone": cross & _same("phone"),
        "email": cross & _same("email"),
        "reference": _same("reference_key") & (F.length("l_reference") >= 4),
        "address": _same("address_key"),
        "position": _km() <= 0.08,
        "price": _near("price", 30.0, 0.06),
        "area": _near("area", 2.0, 0.05),
        "exact_area": cross & _has_decimals(area) & same_figure,
        "rooms": _same("rooms"),
        "agency": _same("agency_key"),
        "postal_code": _same("postal_code"),
        "district": here == there,
        "operator": cross & _same("operator") & _same("price") & same_figure,
    }
    total = _photo_points(cross)
    for name, holds in flags.items():
        total = total + F.when(F.coalesce(holds, F.lit(False)), POINTS[name]).otherwise(0)
    one = F.coalesce(F.array_contains("r_title_tokens", here), F.lit(False))
    other = F.coalesce(F.array_contains("l_title_tokens", there), F.lit(False))
    total = total + F.when(~F.coalesce(here == there, F.lit(False)) & (one | other), POINTS["district_named"]).otherwise(0)
    for name, least in (("title", 0.4), ("description", 0.5)):
        alike = jaccard(*_sides(f"{name}_tokens"))
        total = total + F.when(alike > least, js_round(POINTS[name] * alike)).otherwise(0)
    return F.least(F.lit(100), total).cast("int")


def _with_verdict(scored: DataFrame) -> DataFrame:
    verdict = F.when(F.col("score") >= DUPLICATE, "duplicate").when(F.col("score") >= AMBIGUOUS, "ambiguous")
    return scored.withColumn("verdict", verdict.otherwise("distinct"))


def verdicts(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(left_id, right_id, score, verdict) of given pairs; a vetoed pair is distinct with score 0."""
    score = F.when(blocked(), 0).otherwise(pair_score()).cast("int").alias("score")
    return _with_verdict(with_sides(pairs, rows).select("left_id", "right_id", score))


def scored(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(left_id, right_id, score, verdict) of those pairs, free of vetoes, that are duplicate or ambiguous."""
    points = with_sides(pairs, rows).select("left_id", "right_id", pair_score().alias("score"))
    return _with_verdict(points).filter(F.col("score") >= AMBIGUOUS)


def matches(rows: DataFrame) -> DataFrame:
    """(left_id, right_id, score, verdict) of all pairs of ``rows`` that are duplicate or ambiguous."""
    return scored(possible_pairs(rows), rows)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) by contraction: each round maps nodes to their smallest neighbour, follows these pointers to their
    end, rewrites the edges between the ends and drops loops.

    A node that neither points nor is pointed to has neighbours that point below it, so it points in the next round: two
    rounds halve the nodes at least, and a round follows a path of n pointers in log2(n) joins.
    """
    scratch = Scratch(edges.sparkSession, "components")
    now = scratch.keep(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    levels = []
    for _ in range(max_rounds):
        both = now.select("a", "b").union(now.select("b", "a"))
        up = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        up = ends(scratch.keep(up.select("node", F.least("node", "m").alias("root"))), scratch)
        levels.append(up)
        to = lambda c: up.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))  # noqa: E731, B023
        now = scratch.replace(
            now,
            now.join(to("a"), "a").join(to("b"), "b").filter("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
        )
        if now.isEmpty():
            break
    else:
        raise RuntimeError("components did not contract")
    out = levels[-1]
    for up in reversed(levels[:-1]):
        higher = out.select(F.col("node").alias("root"), F.col("root").alias("top"))
        out = up.join(higher, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return out


def ends(up: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Pointers (node, root) led to their ends; each step doubles how far they reach. Every root is a node. With the
    ``scratch`` that holds ``up``, what a step replaces is deleted."""
    kept = scratch or Scratch(up.sparkSession, "ends")
    first = scratch is None
    while True:
        onward = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
        further = kept.keep(up.join(onward, "root").select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")))
        if not first:
            kept.drop(up)
        up, first = further, False
        if up.filter("moved").isEmpty():
            return up.select("node", "root")


def constrained_clusters(rows: DataFrame, scored: DataFrame, merge_ambiguous: bool = False) -> DataFrame:
    """(id, cluster): links by falling score, two clusters joined unless a cross pair conflicts within one source. The
    order is (score desc, left, right), and a cluster's name is its smallest id."""
    wanted = ["duplicate", "ambiguous"] if merge_ambiguous else ["duplicate"]
    links = scored.filter(F.col("verdict").isin(*wanted)).select("left_id", "right_id", "score")
    found = clustering.clusters(rows, links, components, ends)
    return rows.select("id").join(found, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))


def ambiguous_by_cluster(clusters: DataFrame, scored: DataFrame) -> DataFrame:
    """(cluster, pairs): what is left to decide, by the cluster of the left id; pairs are ordered by their ids."""
    open_pairs = scored.filter("verdict = 'ambiguous'").select("left_id", "right_id", "score")
    found = open_pairs.join(clusters.select(F.col("id").alias("left_id"), "cluster"), "left_id")
    return found.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("left_id", "right_id", "score"))).alias("pairs"))


# --------------------------------------------------------------------------------------------------------------------
# merge

#: Merged fields; numbers within their tolerance are equal. Fixed values.
FIELDS = (
    "title", "description", "price", "charges", "area", "rooms", "property_type", "furnished", "flat_share", "dpe",
    "max_occupants", "address", "district", "city", "postal_code", "latitude", "longitude", "published_at", "available_at",
    "views", "favorites",
)
TOLERANCE = {"price": 0.01, "charges": 0.01, "area": 0.01, "latitude": 0.001, "longitude": 0.001}
#: Fields that make an occurrence complete, a point each; phone and e-mail give two.
COMPLETE = (
    "title", "description", "price", "charges", "area", "rooms", "address", "city", "postal_code", "latitude",
    "longitude", "published_at",
)


def completeness() -> Column:
    one = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in COMPLETE), F.lit(0))
    return one + sum((F.when(F.col(c).isNotNull(), 2).otherwise(0) for c in ("phone", "email")), F.lit(0))


def ranked_members(rows: DataFrame, group: str = "group_id") -> DataFrame:
    """Members with ``place`` from 1 for the primary one: fullest, then seen first, then smallest id."""
    w = Window.partitionBy(group).orderBy(completeness().desc(), F.col("first_seen"), F.col("id"))
    return rows.withColumn("place", F.row_number().over(w))


def _rank() -> Column:
    """The order in which members are primary: fullest, then seen first, then smallest id."""
    return F.struct((-completeness()).alias("gaps"), "first_seen", "id")


def _first_known(name: str) -> Column:
    """The known value of the smallest id, as an aggregate."""
    return F.min_by(name, F.when(F.col(name).isNotNull(), F.col("id")))


def _chosen(rows: DataFrame, group: str) -> DataFrame:
    """One row for each group: every merged field as struct(value, source_id), the primary's value, else the first known
    one by id; and what needs no comparison. One aggregation, of which each member is merged away as it comes."""
    wants = parse_requirements(F.col("description"))
    stated = (
        wants["min_income"].isNotNull() | wants["insured_rent"].isNotNull() | (F.size(wants["guarantees"]) > 0) | (F.size(wants["situations"]) > 0)
    )
    alive = F.when(F.col("lifecycle") == "active", 0).when(F.col("lifecycle") == "possiblyInactive", 1).otherwise(2)
    reached = F.col("phone").isNotNull() | F.col("email").isNotNull()
    known_kind = F.col("landlord").isNotNull() & (F.col("landlord") != "unknown")
    first = {c: F.min_by(F.struct(F.col(c).alias("value"), "source_id"), F.when(F.col(c).isNotNull(), F.col("id"))) for c in FIELDS}
    merged = rows.withColumn("wants", wants).withColumn("stated", stated).groupBy(group).agg(
        F.min_by(F.struct("source_id", *FIELDS), _rank()).alias("primary"),
        *[f.alias(f"first_{c}") for c, f in first.items()],
        F.min_by("id", F.struct("first_seen", "id")).alias("id"),
        *[_first_known(c).alias(c) for c in ("agency", "phone", "email", "reference")],
        F.coalesce(F.min_by("landlord", F.when(known_kind, F.col("id"))), F.lit("unknown")).alias("landlord"),
        F.array_sort(F.collect_set(F.when(reached, F.col("source_id")))).alias("provided_by"),
        F.min_by("wants", F.when(F.col("description").isNotNull() & F.col("stated"), F.col("id"))).alias("requirements"),
        F.min(alive).alias("alive"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.count(F.lit(1)).cast("int").alias("occurrences"),
    )

    def choice(c: str) -> Column:
        own = F.struct(F.col(f"primary.{c}").alias("value"), F.col("primary.source_id").alias("source_id"))
        return F.when(F.col(f"primary.{c}").isNotNull(), own).otherwise(F.coalesce(F.col(f"first_{c}"), own))

    lifecycle = F.when(F.col("alive") == 0, "active").when(F.col("alive") == 1, "possiblyInactive").otherwise("inactive")
    return merged.withColumns({c: choice(c) for c in FIELDS}).withColumn("lifecycle", lifecycle).drop(
        "primary", "alive", *[f"first_{c}" for c in FIELDS]
    )


def _against(rows: DataFrame, chosen: DataFrame, group: str) -> DataFrame:
    """One row for each group: per field the values of other sources that differ from the chosen one, in order of id."""
    picked = chosen.select(F.col(group).alias("of"), *[F.col(c).alias(f"chosen_{c}") for c in FIELDS])
    met = rows.join(picked, rows[group] == picked["of"])

    def differing(c: str) -> Column:
        a, b = F.col(c), F.col(f"chosen_{c}.value")
        apart = F.abs(a - b) > TOLERANCE[c] if c in TOLERANCE else a != b
        other = a.isNotNull() & (F.col("source_id") != F.col(f"chosen_{c}.source_id")) & apart
        return F.collect_list(F.when(other, F.struct("id", a.alias("value"), "source_id")))

    found = met.groupBy("of").agg(*[differing(c).alias(c) for c in FIELDS])
    plain = lambda c: F.transform(F.array_sort(c), lambda m: F.struct(m["value"].alias("value"), m["source_id"].alias("source_id")))
    return found.select("of", *[plain(c).alias(f"against_{c}") for c in FIELDS])


def _sets(rows: DataFrame, group: str) -> DataFrame:
    """(of, features, images) of each group: distinct, by the smallest id that has them and their place there; images of
    plain http come last. Repeats go before a group meets."""
    each = [
        rows.select(F.col(group).alias("of"), "id", F.lit(c).alias("kind"), F.posexplode(F.split(c, ",")).alias("k", "x")).filter("x <> ''")
        for c in ("features", "images")
    ]
    once = each[0].unionByName(each[1]).groupBy("of", "kind", "x").agg(F.min(F.struct("id", "k")).alias("o"))
    late = (F.col("kind") == "images") & F.startswith("x", F.lit("http://"))
    kept = lambda kind: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct(late.alias("late"), "o", "x")))), lambda e: e["x"]
    )
    return once.groupBy("of").agg(kept("features").alias("features"), kept("images").alias("images"))


def merge_groups(rows: DataFrame, group: str = "group_id") -> DataFrame:
    """One listing for each group: merged fields with provenance, contact, features, images, requirements, best
    lifecycle, first and last sighting and the id of the oldest occurrence. Columns that ``rows`` lacks are unknown.

    Members are never gathered: values are chosen by one aggregation, conflicts by a second one over the members joined
    with the choice, and lists by distinct entries.
    """
    have = set(rows.columns)
    wanted = (*FIELDS, "agency", "landlord", "reference", "phone", "email", "features", "images")
    rows = rows.withColumns({c: F.lit(None).cast(_RAW.get(c, "string")) for c in wanted if c not in have})
    chosen = _chosen(rows, group)
    against, sets = _against(rows, chosen, group), _sets(rows, group)
    whole = chosen.join(against, chosen[group] == against["of"]).drop("of").join(sets, chosen[group] == sets["of"], "left").drop("of")

    def field(c: str) -> Column:
        return F.struct(F.col(f"{c}.value").alias("value"), F.col(f"{c}.source_id").alias("source_id"), F.col(f"against_{c}").alias("conflicts"))

    none = F.array().cast("array<string>")
    return whole.select(
        group, "id", *[field(c).alias(c) for c in FIELDS], "agency", "phone", "email", "reference", "landlord", "provided_by",
        F.coalesce("features", none).alias("features"), F.coalesce("images", none).alias("images"), "requirements", "lifecycle",
        "first_seen", "last_seen", "occurrences",
    )


def merged_fields(listings: DataFrame, group: str = "group_id") -> DataFrame:
    """The merged fields of ``merge_groups`` as rows: group, field, value, source_id and conflicts, all as text."""

    def one(c: str) -> Column:
        said = F.transform(F.col(c)["conflicts"], lambda x: F.concat(x["source_id"], F.lit("="), x["value"].cast("string")))
        return F.struct(
            F.lit(c).alias("field"), F.col(c)["value"].cast("string").alias("value"), F.col(c)["source_id"].alias("source_id"),
            F.array_join(F.array_sort(said), ";").alias("conflicts"),
        )

    return listings.select(group, F.explode(F.array(*[one(c) for c in FIELDS])).alias("f")).select(group, "f.*")

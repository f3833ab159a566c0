"""List queries: overlay, filters, order, pages, facets, search and suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from listloom.catalogue import query
from listloom.functions.text import ACCENTED, PLAIN, all_terms, search_fold
from listloom.operators import filters, lists
from listloom.operators.affinity import BONUS, affinities, listing_features
from listloom.sources.views import table, view, with_views

#: Priority from which a listing is hot. Fixed value.
HOT = 85
CRITERIA = filters.Criteria(max_price=960.0, min_price=905.0, min_area=12.0, city="arles")
FOLD = f"translate(lower({{}}), '{ACCENTED}', '{PLAIN}')"

OVERLAY = """
WITH own AS (
  SELECT l.*, coalesce(s.viewed, false) AS viewed, coalesce(s.favorite, false) AS favorite,
         coalesce(s.archived, false) AS archived, coalesce(s.tracking, 'new') AS tracking, c.match, c.opportunity,
         c.visit, c.risk, c.matches,
         CAST(greatest(0, least(100, floor(coalesce(0.3E0 * c.match + 0.35E0 * c.opportunity + 0.25E0 * c.visit
           + 0.1E0 * (100 - c.risk), 0) + 0.5E0))) AS INT) AS priority
  FROM listings l LEFT JOIN (SELECT * FROM user_state WHERE user_id = 1) s ON l.id = s.id
  LEFT JOIN (SELECT * FROM user_score WHERE user_id = 1) c ON l.id = c.id
)
"""


def _overlay(spark, sf_dir):
    df = lists.overlay(
        view(spark, sf_dir, "listings"), view(spark, sf_dir, "user_state"), view(spark, sf_dir, "user_score"), 1
    )
    return df.withColumn("priority", lists.priority(F.col("match"), F.col("opportunity"), F.col("visit"), F.col("risk")))


@query(
    with_views(
        OVERLAY
        + """
SELECT id, price, area, priority, tracking, favorite FROM own
WHERE coalesce(matches, false) AND lifecycle <> 'inactive' AND (price IS NULL OR price <= 960) AND (price IS NULL OR price >= 905)
  AND (area IS NULL OR area >= 12) AND NOT archived
  AND coalesce(flat_share, false) = false AND NOT coalesce(student_only, false) AND coalesce(landlord = 'agency', false)
  AND coalesce(furnished, true) = true AND (commute IS NULL OR commute <= 50)
  AND (available_at IS NULL OR available_at < TIMESTAMP '2024-03-11 00:00:00')
  AND coalesce(district IN ('q1', 'q2', 'q4', 'q7'), true)
ORDER BY priority DESC NULLS LAST, first_seen DESC, id LIMIT 40 OFFSET 5
""",
        "listings", "user_state", "user_score",
    )
)
def list_priority_overlay(spark, sf_dir):
    """JON-01, FLT-03..06, SCO-05, SRT-01, SRT-02: one user's ranked page."""
    traits = filters.Traits(
        flat_share="none", student="none", landlord="agency", furnished="yes", max_commute=50,
        available_by="2024-03-10", districts=("q1", "q2", "q4", "q7"),
    )
    df = _overlay(spark, sf_dir).filter(
        filters.signed_in() & filters.live_numbers(CRITERIA) & filters.trait_conditions(traits) & ~F.col("archived")
    )
    page = lists.page(df, lists.order("priority"), 40, 5)
    return page.select("id", "price", "area", "priority", "tracking", "favorite")


def _sorted(mode: str, by: str):
    sql = with_views(
        OVERLAY + f"SELECT id, row_number() OVER (ORDER BY {by}) AS place FROM own ORDER BY {by} LIMIT 200",
        "listings", "user_state", "user_score",
    )

    def run(spark, sf_dir):
        from pyspark.sql import Window

        df = _overlay(spark, sf_dir)
        top = lists.page(df, lists.order(mode), 200).select("id", "price", "area", "commute", "priority", "first_seen")
        return top.withColumn("place", F.row_number().over(Window.orderBy(*lists.order(mode)))).select(
            "id", F.col("place").cast("long").alias("place")
        )

    run.__name__ = f"list_sort_{mode}"
    return query(sql)(run)


list_sort_price = _sorted("price", "price ASC NULLS LAST, id")
list_sort_area = _sorted("area", "area DESC NULLS LAST, id")
list_sort_closest = _sorted("closest", "commute ASC NULLS LAST, priority DESC NULLS LAST, id")
list_sort_recent = _sorted("recent", "first_seen DESC, id")


@query(
    with_views(
        """SELECT id, city, property_type FROM listings WHERE lifecycle <> 'inactive'
AND property_type NOT IN ('parking', 'office') AND city = 'arles' ORDER BY first_seen DESC, id LIMIT 30""",
        "listings",
    )
)
def list_anonymous(spark, sf_dir):
    """FLT-02, SRT-01: the public catalogue; priority falls back to recency."""
    df = view(spark, sf_dir, "listings").filter(filters.anonymous_catalogue("arles"))
    return lists.page(df, lists.order("priority", anonymous=True)).select("id", "city", "property_type")


@query(
    with_views(
        """SELECT id, price, rooms FROM listings WHERE coalesce(price <= 940, false) AND coalesce(area >= 20, false)
AND coalesce(rooms >= 2, false) AND coalesce(max_occupants >= 2, true) AND coalesce(property_type IN ('small', 'economy'), false)""",
        "listings",
    )
)
def list_quick_filters(spark, sf_dir):
    """FLT-07: the strict filters."""
    keep = filters.quick_filters(940, 20, 2, 2, ("small", "economy"))
    return view(spark, sf_dir, "listings").filter(keep).select("id", "price", "rooms")


@query(
    with_views(
        """SELECT group_id, count(*) AS occurrences FROM occurrences GROUP BY group_id
HAVING bool_or(source_id IN ('s1', 's4'))""",
        "occurrences",
    )
)
def list_source_filter(spark, sf_dir):
    """FLT-08: listings with an occurrence of a chosen source."""
    nested = view(spark, sf_dir, "occurrences").groupBy("group_id").agg(
        F.collect_list(F.struct("id", "source_id")).alias("occurrences")
    )
    return nested.filter(filters.from_sources(F.col("occurrences"), ["s1", "s4"])).select(
        "group_id", F.size("occurrences").cast("long").alias("occurrences")
    )


@query(
    with_views(
        "SELECT count(*) AS n, max(price) AS max_price, max(CAST(epoch(first_seen) AS BIGINT)) AS max_seen FROM listings", "listings"
    )
)
def list_signature(spark, sf_dir):
    """AGG-06: a weak tag of the list."""
    df = view(spark, sf_dir, "listings").withColumn("seen", F.unix_timestamp("first_seen"))
    return lists.signature(df, "price", "seen")


@query(
    with_views(
        """SELECT district, count(*) AS n FROM listings WHERE lifecycle <> 'inactive' AND district IS NOT NULL
GROUP BY district""",
        "listings",
    )
)
def district_facets(spark, sf_dir):
    """AGG-05."""
    df = view(spark, sf_dir, "listings").filter("lifecycle <> 'inactive' and district is not null")
    return df.groupBy("district").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "district")


@query(
    with_views(
        """SELECT 'source' AS kind, source_id AS value FROM occurrences GROUP BY ALL
UNION ALL SELECT 'type', property_type FROM occurrences GROUP BY ALL""",
        "occurrences",
    )
)
def facet_values(spark, sf_dir):
    """AGG-23: distinct sources and types, in one scan."""
    df = view(spark, sf_dir, "occurrences")
    pairs = F.array(
        F.struct(F.lit("source").alias("kind"), F.col("source_id").alias("value")),
        F.struct(F.lit("type").alias("kind"), F.col("property_type").alias("value")),
    )
    return df.select(F.explode(pairs).alias("x")).select("x.kind", "x.value").distinct().orderBy("kind", "value")


@query(
    f"""SELECT doc_id FROM documents WHERE contains({FOLD.format("concat_ws(' ', text, lang, source)")}, 'the')
AND contains({FOLD.format("concat_ws(' ', text, lang, source)")}, 'ether')"""
)
def search_terms(spark, sf_dir):
    """FLT-10: every folded term stands in the joined fields."""
    hay = search_fold(F.concat_ws(" ", "text", "lang", "source"))
    return table(spark, sf_dir, "documents").filter(all_terms(hay, "THE éthèr")).select("doc_id")


@query(
    with_views(
        """WITH v AS (
  SELECT 'district' AS kind, 1 AS k, district AS value FROM listings UNION ALL SELECT 'agency', 2, agency FROM listings
  UNION ALL SELECT 'city', 3, city FROM listings)
SELECT kind, value, count(*) AS n FROM v WHERE value IS NOT NULL AND contains(lower(value), 'a') AND lower(value) <> 'a'
GROUP BY kind, k, value ORDER BY k, n DESC, value LIMIT 6""",
        "listings",
    )
)
def search_suggest(spark, sf_dir):
    """AGG-22: facet values that contain the needle, the first six."""
    df = view(spark, sf_dir, "listings")
    facets = F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.lit(k).alias("k"), F.col(kind).alias("value"))
        for k, kind in enumerate(("district", "agency", "city"))
    ])
    held = df.select(F.explode(facets).alias("x")).select("x.*")
    folded = search_fold(F.col("value"))
    hits = held.filter(F.contains(folded, F.lit("a")) & (folded != "a")).groupBy("kind", "k", "value").count()
    return hits.orderBy("k", F.col("count").desc(), "value").limit(6).select("kind", "value", F.col("count").alias("n"))


AFFINITY = """
WITH held AS (
  SELECT id, unnest(CASE WHEN len(f) = 0 THEN [NULL] ELSE f END) AS feature FROM (SELECT id, list_filter([
    CASE WHEN property_type <> 'unknown' THEN 'type:' || property_type END, 'price:' || (floor(price / 100 + 0.5) * 100)::BIGINT,
    'rooms:' || rooms, 'dpe:' || dpe], lambda x: x IS NOT NULL)
    || list_transform(list_filter(string_split(features, ','), lambda x: x <> ''), lambda x: 'extra:' || x) AS f FROM listings)
), acted AS (
  SELECT id, CASE WHEN archived OR coalesce(tracking IN ('rejected', 'ignored'), false) THEN -2 WHEN favorite THEN 5
    WHEN tracking = 'toContact' THEN 2 WHEN tracking = 'contacted' THEN 3 WHEN tracking = 'visited' THEN 5 WHEN viewed THEN 1 ELSE 0 END AS weight
  FROM user_state WHERE user_id = 1
), weights AS (SELECT feature, sum(weight) AS weight FROM held JOIN acted USING (id) GROUP BY feature),
raw AS (SELECT id, sum(greatest(0, coalesce(weight, 0))) AS raw FROM held LEFT JOIN weights USING (feature) GROUP BY id)
"""


@query(
    with_views(
        AFFINITY
        + """, s AS (SELECT *, (SELECT max(raw) FROM raw) AS top, (SELECT count(*) FROM acted WHERE weight > 0) AS liked FROM raw)
SELECT id, round(CASE WHEN liked >= 2 AND top > 0 THEN raw / top ELSE 0 END, 6)::DOUBLE AS affinity,
  round(price / 10 + 15 * CASE WHEN liked >= 2 AND top > 0 THEN raw / top ELSE 0 END, 6)::DOUBLE AS rank_value
FROM s JOIN listings USING (id)""",
        "listings", "user_state",
    )
)
def affinity_rank(spark, sf_dir):
    """AGG-21, SRT-03: learned affinity of one user, and the adjusted rank."""
    df = view(spark, sf_dir, "listings")
    own = view(spark, sf_dir, "user_state").filter("user_id = 1")
    found = affinities(df, own, listing_features())
    return found.join(df.select("id", "price"), "id").select(
        "id", F.round("affinity", 6).alias("affinity"), F.round(F.col("price") / 10 + BONUS * F.col("affinity"), 6).alias("rank_value")
    )


@query(
    with_views(
        OVERLAY + "SELECT id, CASE WHEN priority >= 85 THEN 'hot' ELSE 'rest' END AS shelf FROM own WHERE lifecycle = 'active'",
        "listings", "user_state", "user_score",
    )
)
def hot_and_rest(spark, sf_dir):
    """SRT-04, FLT-09: the split by priority; uncertain ads are hidden."""
    df = _overlay(spark, sf_dir).filter("lifecycle = 'active'")
    return df.select("id", F.when(F.col("priority") >= HOT, "hot").otherwise("rest").alias("shelf"))


@query(
    with_views(
        "SELECT id, row_number() OVER (ORDER BY coalesce(published_at, first_seen) DESC, id) AS place FROM listings ORDER BY 2 LIMIT 100",
        "listings",
    )
)
def client_recency(spark, sf_dir):
    """SRT-05: published, else first seen."""
    from pyspark.sql import Window

    df = view(spark, sf_dir, "listings").withColumn("at", F.coalesce("published_at", "first_seen"))
    top = df.orderBy(F.col("at").desc(), "id").limit(100)
    place = F.row_number().over(Window.orderBy(F.col("at").desc(), "id")).cast("long")
    return top.select("id", place.alias("place"))


@query(
    with_views(
        """SELECT source_id, id, place, overflow FROM (
  SELECT source_id, id, row_number() OVER (PARTITION BY source_id ORDER BY first_seen DESC, id) AS place,
         greatest(0, count(*) OVER (PARTITION BY source_id) - 4) AS overflow FROM occurrences) WHERE place <= 4""",
        "occurrences",
    )
)
def notification_truncation(spark, sf_dir):
    """SRT-11: the first four of each, and how many are left."""
    top = lists.top_by(view(spark, sf_dir, "occurrences"), ["source_id"], [F.col("first_seen").desc(), F.col("id")], 4)
    return top.select("source_id", "id", F.col("place").cast("long").alias("place"), F.col("overflow").cast("long").alias("overflow"))


@query(
    with_views(
        """SELECT id, CASE WHEN id % 3 = 0 THEN commute END AS shown FROM listings WHERE lifecycle IN ('active', 'possiblyInactive')""",
        "listings",
    )
)
def privacy_projection(spark, sf_dir):
    """FLT-16, SRC-26: distances are shown to their owner only."""
    df = view(spark, sf_dir, "listings").filter(F.col("lifecycle").isin("active", "possiblyInactive"))
    return df.select("id", F.when(F.col("id") % 3 == 0, F.col("commute")).alias("shown"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE CAST(o_orderkey AS VARCHAR) LIKE '12%' AND nullif(o_orderkey % 3, 2) IS DISTINCT FROM 1")
def prefix_and_null_safe(spark, sf_dir):
    """FLT-25: prefix match and null-safe inequality."""
    flag = F.nullif(F.col("o_orderkey") % 3, F.lit(2))
    return table(spark, sf_dir, "orders").filter(
        F.col("o_orderkey").cast("string").startswith("12") & ~flag.eqNullSafe(F.lit(1))
    ).select("o_orderkey", "o_totalprice")

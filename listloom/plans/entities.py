"""Entity resolution queries: pairs, verdicts, components, clusters, merge."""

from __future__ import annotations

from pyspark.sql import functions as F

from listloom.catalogue import query
from listloom.functions.text import ACCENTED, PLAIN, STOP_WORDS, tokenize
from listloom.operators import entities
from listloom.operators.affinity import without_redundant
from listloom.operators.similar import similar_sets
from listloom.session import Scratch
from listloom.sources.views import table, view, with_views


#: Sources that relay the ads of others, and sources of one operator, of the views' tables.
RELAYS = ("s2", "s5", "s7")
OPERATORS = {"s1": "north", "s4": "north", "s3": "south", "s8": "south"}


def _rows(spark, sf_dir):
    return entities.prepared(view(spark, sf_dir, "occurrences"), RELAYS, OPERATORS)


def _plain(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"


def _words(c: str) -> str:
    stops = ", ".join(repr(w) for w in STOP_WORDS)
    return f"list_distinct(list_filter(string_split({_plain(c)}, ' '), lambda w: len(w) > 2 AND NOT list_contains([{stops}], w)))"


KEYS = f"""
WITH r AS (SELECT *, floor(area / 5 + 0.5)::BIGINT AS a, floor(price / 50 + 0.5)::BIGINT AS p, coalesce(city, postal_code, 'anywhere') AS place,
  {_plain('reference')} AS reference_key, {_plain('address')} AS address_key, {_plain('agency')} AS agency_key, {_plain('district')} AS district_key,
  {_words('title')} AS title_tokens, {_words('description')} AS description_tokens, source_id IN ('s2', 's5', 's7') AS relays,
  list_distinct(list_transform(string_split(images, ','), lambda u: regexp_replace(u, '^https?://([^/?#]+)([^?#]*).*$', '\\1\\2'))) AS photos,
  CASE WHEN source_id IN ('s1', 's4') THEN 'north' WHEN source_id IN ('s3', 's8') THEN 'south' END AS operator FROM occurrences),
keyed AS (
  SELECT id, unnest(list_filter([
    'tel:' || phone, 'mail:' || email, CASE WHEN len(reference) >= 4 THEN 'ref:' || reference_key END,
    'area:' || place || ':' || a, 'area:' || place || ':' || (a - 1),
    'price:' || place || ':' || p, 'price:' || place || ':' || (p - 1), 'both:' || a || ':' || p, 'both:' || a || ':' || (p - 1),
    'both:' || (a - 1) || ':' || p, 'both:' || (a - 1) || ':' || (p - 1)], lambda x: x IS NOT NULL)) AS key FROM r),
held AS (SELECT id, key FROM keyed JOIN (SELECT key FROM keyed GROUP BY key HAVING count(*) BETWEEN 2 AND 200) USING (key)),
pairs AS (SELECT DISTINCT x.id AS left_id, y.id AS right_id FROM held x JOIN held y ON x.key = y.key AND x.id < y.id)
"""

VERDICTS = (
    KEYS
    + """, sides AS (
  SELECT left_id, right_id, x.source_id <> y.source_id AS other, abs(x.area - y.area) < 0.005 AS figure,
    CASE WHEN x.latitude IS NOT NULL AND y.latitude IS NOT NULL THEN 2 * 6371.0::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians(y.latitude - x.latitude) / 2), 2)
      + cos(radians(x.latitude)) * cos(radians(y.latitude)) * pow(sin(radians(y.longitude - x.longitude) / 2), 2)))) END AS km,
    abs(x.area - floor(x.area + 0.5)) > 0.004 AS exact, abs(y.area - floor(y.area + 0.5)) > 0.004 AS exact_y,
    len(list_intersect(x.photos, y.photos)) AS common,
    len(list_intersect(x.title_tokens, y.title_tokens)) AS titles, len(list_intersect(x.description_tokens, y.description_tokens)) AS texts,
    x, y
  FROM pairs JOIN r x ON x.id = left_id JOIN r y ON y.id = right_id),
judging AS (SELECT *,
  coalesce(x.city <> y.city, false) OR coalesce(abs(x.area - y.area) > greatest(2, 0.05 * greatest(x.area, y.area)), false)
    OR coalesce(abs(x.price - y.price) > greatest(30, 0.06 * greatest(x.price, y.price)), false) OR coalesce(x.rooms <> y.rooms, false)
    OR coalesce(km > 0.5, false)
    OR (NOT other AND NOT (x.relays AND coalesce(x.agency_key <> y.agency_key, false)) AND (coalesce(abs(x.price - y.price) > 0.5, false)
      OR coalesce(NOT (figure
        OR (NOT exact AND floor(x.area + 0.5) IN (floor(y.area + 0.005), floor(y.area + 0.5)))
        OR (NOT exact_y AND floor(y.area + 0.5) IN (floor(x.area + 0.005), floor(x.area + 0.5)))), false))) AS veto,
  CASE WHEN coalesce(common, 0) = 0 THEN 0
    WHEN common = len(x.photos) AND common = len(y.photos) THEN CASE WHEN other OR x.relays OR common >= 2 THEN 45 ELSE 0 END
    WHEN other OR x.relays THEN 8 ELSE 0 END AS photo,
  CASE WHEN titles > 0 THEN titles / (len(x.title_tokens) + len(y.title_tokens) - titles) ELSE 0 END AS title,
  CASE WHEN texts > 0 THEN texts / (len(x.description_tokens) + len(y.description_tokens) - texts) ELSE 0 END AS description FROM sides),
scored AS (SELECT left_id, right_id, CAST(CASE WHEN veto THEN 0 ELSE least(100, photo
  + CASE WHEN other AND x.phone = y.phone THEN 40 ELSE 0 END + CASE WHEN other AND x.email = y.email THEN 35 ELSE 0 END
  + CASE WHEN x.reference_key = y.reference_key AND len(x.reference) >= 4 THEN 35 ELSE 0 END
  + CASE WHEN x.address_key = y.address_key THEN 30 ELSE 0 END + CASE WHEN km <= 0.08 THEN 30 ELSE 0 END
  + CASE WHEN abs(x.area - y.area) <= greatest(2, 0.05 * greatest(x.area, y.area)) THEN 18 ELSE 0 END
  + CASE WHEN other AND exact AND figure THEN 30 ELSE 0 END
  + CASE WHEN abs(x.price - y.price) <= greatest(30, 0.06 * greatest(x.price, y.price)) THEN 18 ELSE 0 END
  + CASE WHEN x.rooms = y.rooms THEN 6 ELSE 0 END + CASE WHEN x.agency_key = y.agency_key THEN 12 ELSE 0 END
  + CASE WHEN x.postal_code = y.postal_code THEN 4 ELSE 0 END
  + CASE WHEN x.district_key = y.district_key THEN 12 WHEN coalesce(list_contains(y.title_tokens, x.district_key), false)
      OR coalesce(list_contains(x.title_tokens, y.district_key), false) THEN 8 ELSE 0 END
  + CASE WHEN other AND x.operator = y.operator AND x.price = y.price AND figure THEN 30 ELSE 0 END
  + CASE WHEN title > 0.4 THEN floor(15 * title + 0.5) ELSE 0 END + CASE WHEN description > 0.5 THEN floor(12 * description + 0.5) ELSE 0 END)
  END AS INT) AS score FROM judging),
judged AS (SELECT *, CASE WHEN score >= 70 THEN 'duplicate' WHEN score >= 45 THEN 'ambiguous' ELSE 'distinct' END AS verdict FROM scored)
"""
)


@query(with_views(KEYS + "SELECT left_id, right_id FROM pairs", "occurrences"))
def candidate_pairs(spark, sf_dir):
    """JON-10, JON-11: blocks of 2..200, each pair once."""
    return entities.candidate_pairs(_rows(spark, sf_dir))


@query(with_views(VERDICTS + "SELECT left_id, right_id, score, verdict FROM judged WHERE verdict <> 'distinct'", "occurrences"))
def pair_verdicts(spark, sf_dir):
    """JON-12..15, JON-20."""
    return entities.matches(_rows(spark, sf_dir))


@query(with_views(KEYS + "SELECT key, count(*) AS n FROM keyed GROUP BY key HAVING count(*) > 200", "occurrences"))
def skipped_blocks(spark, sf_dir):
    """JON-11: the blocks that are too large to be paired, and how large they are."""
    return entities.skipped_blocks(_rows(spark, sf_dir))


@query(with_views(VERDICTS + "SELECT verdict, count(*) AS n, round(avg(score), 6)::DOUBLE AS mean FROM judged GROUP BY verdict", "occurrences"))
def verdict_counts(spark, sf_dir):
    """JON-11, JON-15: how many pairs were compared, by verdict."""
    rows = _rows(spark, sf_dir)
    found = entities.verdicts(entities.candidate_pairs(rows), rows)
    return found.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean"))


@query(
    with_views(
        "WITH RECURSIVE" + VERDICTS.strip()[4:] + """, links AS (SELECT left_id AS a, right_id AS b FROM judged WHERE verdict = 'duplicate'),
ends AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, a AS b FROM ends UNION SELECT reach.a, ends.b FROM reach JOIN ends ON reach.b = ends.a)
SELECT a AS node, min(b) AS root FROM reach GROUP BY a""",
        "occurrences",
    )
)
def duplicate_components(spark, sf_dir):
    """JON-16, first half: connected components of the duplicate links."""
    rows = _rows(spark, sf_dir)
    links = entities.matches(rows).filter("verdict = 'duplicate'")
    return entities.components(links.select(F.col("left_id").alias("a"), F.col("right_id").alias("b")))


def _clusters(wanted: str, select: str) -> str:
    """Round by round: links that conflict are closed, those that are the best open one of both their clusters join."""
    return with_views(
        "WITH RECURSIVE" + VERDICTS.strip()[4:] + f""", links AS (
  SELECT left_id AS l, right_id AS r, row_number() OVER (ORDER BY score DESC, left_id, right_id) AS o FROM judged WHERE verdict IN ({wanted})),
facts AS (SELECT id, source_id, price, area, agency_key, relays FROM r WHERE id IN (SELECT l FROM links UNION ALL SELECT r FROM links)),
state(it, id, cluster) AS (
  SELECT 0, id, id FROM facts
  UNION ALL
  (WITH open AS (
    SELECT least(x.cluster, y.cluster) AS a, greatest(x.cluster, y.cluster) AS b, min(o) AS o
    FROM links JOIN state x ON x.id = l JOIN state y ON y.id = links.r WHERE x.cluster <> y.cluster GROUP BY 1, 2
  ), members AS (SELECT f.*, cluster FROM state JOIN facts f USING (id)),
  against AS (
    SELECT DISTINCT a, b FROM open JOIN members x ON x.cluster = a JOIN members y ON y.cluster = b AND x.source_id = y.source_id
    WHERE NOT (x.relays AND coalesce(x.agency_key <> y.agency_key, false)) AND (coalesce(abs(x.price - y.price) > 0.5, false) OR coalesce(NOT (
      abs(x.area - y.area) < 0.005
      OR (abs(x.area - floor(x.area + 0.5)) <= 0.004 AND floor(x.area + 0.5) IN (floor(y.area + 0.5), floor(y.area + 0.005)))
      OR (abs(y.area - floor(y.area + 0.5)) <= 0.004 AND floor(y.area + 0.5) IN (floor(x.area + 0.5), floor(x.area + 0.005)))), false))
  ), best AS (
    SELECT c, min(o) AS o FROM (SELECT a AS c, o FROM open ANTI JOIN against USING (a, b) UNION ALL SELECT b, o FROM open ANTI JOIN against USING (a, b)) GROUP BY c
  ), joins AS (SELECT min(c) AS root, max(c) AS node FROM best GROUP BY o HAVING count(*) = 2)
  SELECT it + 1, id, coalesce(root, cluster) FROM state LEFT JOIN joins ON node = cluster WHERE (SELECT count(*) FROM joins) > 0)
),
clusters AS (
  SELECT r.id, coalesce(cluster, r.id) AS cluster
  FROM r LEFT JOIN (SELECT id, cluster FROM state WHERE it = (SELECT max(it) FROM state)) s ON s.id = r.id)
{select}""",
        "occurrences",
    )


@query(_clusters("'duplicate'", "SELECT id, cluster FROM clusters"))
def constrained_clusters(spark, sf_dir):
    """JON-16: greedy clusters under cannot-link, in rounds of locally best links."""
    rows = _rows(spark, sf_dir)
    return entities.constrained_clusters(rows, entities.matches(rows))


@query(_clusters("'duplicate', 'ambiguous'", "SELECT id, cluster FROM clusters"))
def clusters_with_ambiguous(spark, sf_dir):
    """JON-18: as ``constrained_clusters``, ambiguous pairs linked too."""
    rows = _rows(spark, sf_dir)
    return entities.constrained_clusters(rows, entities.matches(rows), merge_ambiguous=True)


@query(
    _clusters(
        "'duplicate'",
        """SELECT cluster, count(*)::INT AS n, string_agg(left_id || ':' || right_id || ':' || score, ',' ORDER BY left_id, right_id) AS pairs
FROM judged JOIN clusters ON id = left_id WHERE verdict = 'ambiguous' GROUP BY cluster""",
    )
)
def ambiguous_by_cluster(spark, sf_dir):
    """JON-17: what is left to decide, by the cluster of the left id, each pair with its score."""
    rows = _rows(spark, sf_dir)
    scored = Scratch(spark, "matches").keep(entities.matches(rows))
    found = entities.ambiguous_by_cluster(entities.constrained_clusters(rows, scored), scored)
    said = F.transform("pairs", lambda p: F.concat_ws(":", *[p[c].cast("string") for c in ("left_id", "right_id", "score")]))
    return found.select("cluster", F.size("pairs").alias("n"), F.array_join(said, ",").alias("pairs"))


@query(with_views(VERDICTS + """SELECT left_id AS id, count(*) AS pairs, min(right_id) AS first_other,
  string_agg(right_id || ':' || score, ',' ORDER BY right_id) AS others FROM judged WHERE verdict = 'ambiguous' GROUP BY left_id""", "occurrences"))  # fmt: skip
def ambiguous_pairs(spark, sf_dir):
    """JON-15, JON-17: ambiguous pairs by their left id."""
    found = entities.matches(_rows(spark, sf_dir)).filter("verdict = 'ambiguous'")
    said = F.array_sort(F.collect_list(F.struct("right_id", "score")))
    return found.groupBy(F.col("left_id").alias("id")).agg(
        F.count(F.lit(1)).alias("pairs"), F.min("right_id").alias("first_other"),
        F.array_join(F.transform(said, lambda p: F.concat_ws(":", p["right_id"].cast("string"), p["score"].cast("string"))), ",").alias("others"),
    )


RANKED = f"""
WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY
  {' + '.join(f'({c} IS NOT NULL)::INT' for c in entities.COMPLETE)} + 2 * (phone IS NOT NULL)::INT + 2 * (email IS NOT NULL)::INT
  DESC, first_seen, id) AS place FROM occurrences)
"""


@query(with_views(RANKED + "SELECT group_id, id, source_id FROM ranked WHERE place = 1", "occurrences"))
def merge_primary(spark, sf_dir):
    """AGG-14."""
    return entities.ranked_members(view(spark, sf_dir, "occurrences")).filter("place = 1").select("group_id", "id", "source_id")


FIELD_ROWS = ", ".join(
    f"{{'field': '{c}', 'v': {c}::VARCHAR, 'tol': {entities.TOLERANCE.get(c, 'NULL')}::DOUBLE}}" for c in entities.FIELDS
)
FIELDS_SQL = RANKED + f""", long AS (SELECT group_id, id, source_id, place, unnest([{FIELD_ROWS}], recursive := true) FROM ranked),
chosen AS (SELECT group_id, field, coalesce(max(v) FILTER (place = 1), arg_min(v, id) FILTER (v IS NOT NULL)) AS value,
  coalesce(max(source_id) FILTER (place = 1 AND v IS NOT NULL), arg_min(source_id, id) FILTER (v IS NOT NULL), max(source_id) FILTER (place = 1)) AS source_id
  FROM long GROUP BY group_id, field),
against AS (SELECT l.group_id, l.field, count(*) AS n, string_agg(l.source_id || '=' || l.v, ';' ORDER BY l.source_id || '=' || l.v) AS conflicts
  FROM long l JOIN chosen c ON l.group_id = c.group_id AND l.field = c.field
  WHERE l.v IS NOT NULL AND l.source_id <> c.source_id AND CASE WHEN l.tol IS NULL THEN l.v <> c.value ELSE abs(l.v::DOUBLE - c.value::DOUBLE) > l.tol END
  GROUP BY l.group_id, l.field)
"""


@query(with_views(FIELDS_SQL + """SELECT group_id, field, value, source_id, coalesce(conflicts, '') AS conflicts
FROM chosen LEFT JOIN against USING (group_id, field)""", "occurrences"))  # fmt: skip
def merge_fields(spark, sf_dir):
    """AGG-15: every merged field with its provenance and conflicts."""
    return entities.merged_fields(entities.merge_groups(view(spark, sf_dir, "occurrences")))


@query(
    with_views(
        FIELDS_SQL + """, first_of AS (SELECT group_id, arg_min(phone, id) FILTER (phone IS NOT NULL) AS phone, arg_min(email, id) FILTER (email IS NOT NULL) AS email,
  arg_min(agency, id) FILTER (agency IS NOT NULL) AS agency, arg_min(reference, id) FILTER (reference IS NOT NULL) AS reference,
  coalesce(arg_min(landlord, id) FILTER (landlord <> 'unknown'), 'unknown') AS landlord,
  string_agg(DISTINCT source_id, ',' ORDER BY source_id) FILTER (phone IS NOT NULL OR email IS NOT NULL) AS provided_by,
  arg_min(id, (first_seen, id)) AS id, count(*)::INT AS occurrences, min(first_seen) AS first_seen, max(last_seen) AS last_seen,
  CASE min(CASE lifecycle WHEN 'active' THEN 0 WHEN 'possiblyInactive' THEN 1 ELSE 2 END) WHEN 0 THEN 'active' WHEN 1 THEN 'possiblyInactive' ELSE 'inactive' END AS lifecycle
  FROM ranked GROUP BY group_id),
price AS (SELECT c.group_id, value::DOUBLE AS price, source_id AS price_source, coalesce(n, 0)::INT AS price_conflicts
  FROM chosen c LEFT JOIN against USING (group_id, field) WHERE field = 'price'),
city AS (SELECT group_id, value AS city FROM chosen WHERE field = 'city')
SELECT group_id, id, occurrences, lifecycle, price, price_source, price_conflicts, city, phone, email, agency, reference, landlord,
  coalesce(provided_by, '') AS provided_by, first_seen, last_seen FROM first_of JOIN price USING (group_id) JOIN city USING (group_id)""",
        "occurrences",
    )
)
def merge_conflicts(spark, sf_dir):
    """AGG-15..18: values with provenance and conflicts, contact, lifecycle, sightings and the oldest id."""
    merged = entities.merge_groups(view(spark, sf_dir, "occurrences"))
    return merged.select(
        "group_id", "id", "occurrences", "lifecycle",
        F.col("price.value").alias("price"), F.col("price.source_id").alias("price_source"), F.size("price.conflicts").alias("price_conflicts"),
        F.col("city.value").alias("city"), "phone", "email", "agency", "reference", "landlord",
        F.array_join("provided_by", ",").alias("provided_by"), "first_seen", "last_seen",
    )


@query(
    with_views(
        """WITH f AS (SELECT group_id, id, unnest(string_split(features, ',')) AS x, generate_subscripts(string_split(features, ','), 1) AS k FROM occurrences),
ff AS (SELECT group_id, x, min((id, k)) AS o FROM f WHERE x <> '' GROUP BY group_id, x),
i AS (SELECT group_id, id, unnest(string_split(coalesce(images, ''), ',')) AS x, generate_subscripts(string_split(coalesce(images, ''), ','), 1) AS k FROM occurrences),
ii AS (SELECT group_id, x, min((id, k)) AS o FROM i WHERE x <> '' GROUP BY group_id, x),
q AS (SELECT group_id, min(CASE WHEN contains(description, 'Revenus de 1800') THEN id END) AS who FROM occurrences GROUP BY group_id)
SELECT group_id, coalesce((SELECT string_agg(x, ',' ORDER BY o) FROM ff WHERE ff.group_id = q.group_id), '') AS features,
  coalesce((SELECT string_agg(x, ',' ORDER BY starts_with(x, 'http://'), o) FROM ii WHERE ii.group_id = q.group_id), '') AS images,
  CASE WHEN who IS NOT NULL THEN 1800.0::DOUBLE END AS min_income, CASE WHEN who IS NOT NULL THEN 'guarantor' END AS guarantees FROM q""",
        "occurrences",
    )
)
def merge_sets(spark, sf_dir):
    """AGG-18: features and images of all members, and the first stated requirements."""
    merged = entities.merge_groups(view(spark, sf_dir, "occurrences"))
    return merged.select(
        "group_id", F.array_join("features", ",").alias("features"), F.array_join("images", ",").alias("images"),
        F.col("requirements.min_income").alias("min_income"), F.array_join("requirements.guarantees", ",").alias("guarantees"),
    )


TOKENS = f"""
WITH t AS (SELECT doc_id, list_distinct(list_filter(string_split(trim(regexp_replace(translate(lower(text), '{ACCENTED}', '{PLAIN}'),
  '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: len(w) > 2 AND NOT list_contains([{', '.join(repr(w) for w in STOP_WORDS)}], w))) AS tokens
  FROM documents)
"""


@query(TOKENS + "SELECT doc_id, len(tokens)::INT AS n, list_aggregate(tokens, 'min') AS first FROM t")
def text_fold_tokens(spark, sf_dir):
    """SCA-04, SCA-10."""
    df = table(spark, sf_dir, "documents").select("doc_id", tokenize(F.col("text")).alias("t"))
    return df.select("doc_id", F.size("t").alias("n"), F.array_min("t").alias("first"))


@query(
    TOKENS + """, w AS (SELECT doc_id, len(tokens) AS n, unnest(tokens) AS w FROM t),
p AS (SELECT a.doc_id AS left_id, b.doc_id AS right_id, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS similarity
  FROM w a JOIN w b ON a.w = b.w AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id)
SELECT left_id, right_id, round(similarity, 6)::DOUBLE AS similarity FROM p WHERE similarity > 0.4""",
)
def token_jaccard_pairs(spark, sf_dir):
    """JON-10, SCA-11: all pairs of texts of like words, by an exact prefix filter."""
    rows = table(spark, sf_dir, "documents").select("doc_id", tokenize(F.col("text")).alias("t"))
    return similar_sets(rows, 0.4).withColumn("similarity", F.round("similarity", 6))


@query(
    with_views(
        """WITH k AS (SELECT id, source_id IN ('s2', 's5', 's7') AS relayed, unnest(
  CASE WHEN rooms IS NOT NULL THEN ['s|' || city || '|' || CAST(round(price) AS BIGINT) || '|' || area || '|' || rooms, 'l|' || city || '|' || CAST(floor(price / 10) AS BIGINT) || '|' || CAST(floor(area) AS BIGINT)]
  ELSE ['l|' || city || '|' || CAST(floor(price / 10) AS BIGINT) || '|' || CAST(floor(area) AS BIGINT)] END) AS key
  FROM occurrences WHERE city IS NOT NULL AND price IS NOT NULL AND area IS NOT NULL),
r AS (SELECT DISTINCT id FROM k WHERE relayed AND key IN (SELECT key FROM k WHERE NOT relayed))
SELECT id, source_id FROM occurrences ANTI JOIN r USING (id)""",
        "occurrences",
    )
)
def redundancy_antijoin(spark, sf_dir):
    """JON-09, SCA-37: relayed ads that a direct ad makes redundant go."""
    return without_redundant(view(spark, sf_dir, "occurrences"), ["s2", "s5", "s7"]).select("id", "source_id")


@query("SELECT o_orderkey FROM orders WHERE nullif(o_custkey % 100, 7) NOT IN (SELECT nullif(l_suppkey, -1) FROM lineitem WHERE l_quantity > 49)")
def null_aware_not_in(spark, sf_dir):
    """JON-06: NOT IN, with its treatment of unknown keys."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return spark.sql(
        "SELECT o_orderkey FROM {o} WHERE nullif(o_custkey % 100, 7) NOT IN "
        "(SELECT l_suppkey FROM {l} WHERE l_quantity > 49)",
        o=orders, l=lines,
    )


@query("SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity = 50 AND l_discount > 0.05)")
def mark_rented(spark, sf_dir):
    """SNK-07, JON-05: membership as a semi join."""
    sold = table(spark, sf_dir, "lineitem").filter("l_quantity = 50 and l_discount > 0.05").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").join(sold, "p_partkey", "left_semi").select("p_partkey")


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_shipdate >= TIMESTAMP '2001-06-01 00:00:00')")
def retire_departed(spark, sf_dir):
    """SNK-06, JON-07: listings with no living occurrence."""
    living = table(spark, sf_dir, "lineitem").filter("l_shipdate >= timestamp_ntz '2001-06-01 00:00:00'").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").join(living, "p_partkey", "left_anti").select("p_partkey")


@query(
    """WITH p AS (SELECT p_partkey, p_size, p_partkey % 40 AS house, p_partkey % 30 AS street FROM part),
l AS (SELECT s_suppkey, s_suppkey % 40 AS house, s_suppkey % 30 AS street, 1 + s_suppkey % 50 AS area, chr((65 + s_suppkey % 7)::INT) AS label FROM supplier)
SELECT p_partkey, min(label) AS label FROM p JOIN l ON p.house = l.house AND p.street = l.street AND abs(p_size - area) <= 2
GROUP BY p_partkey HAVING count(DISTINCT label) = 1"""
)
def energy_label_match(spark, sf_dir):
    """JON-19: same house and street, area within 2, exactly one label."""
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size", "p_partkey % 40 AS house", "p_partkey % 30 AS street")
    found = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey % 40 AS house", "s_suppkey % 30 AS street", "1 + s_suppkey % 50 AS area", "char(65 + s_suppkey % 7) AS label"
    )
    near = p.join(found, ["house", "street"]).filter(F.abs(F.col("p_size") - F.col("area")) <= 2)
    one = near.groupBy("p_partkey").agg(F.min("label").alias("label"), F.max("label").alias("last"))
    return one.filter("label = last").select("p_partkey", "label")

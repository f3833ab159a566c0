"""Listing views over the driver's tables.

Each view is one SELECT of the SQL that Spark and DuckDB share, so a query and its oracle start from the same rows; every
unknown value is derived with CASE, since the tables themselves have no nulls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: One ad on one source, from orders.
OCCURRENCES = """
SELECT o_orderkey AS id,
       concat('s', CAST(o_custkey % 11 AS VARCHAR(9))) AS source_id,
       CAST(o_orderkey AS VARCHAR(12)) AS source_ref,
       concat('g', CAST(o_orderkey % 4001 AS VARCHAR(9))) AS group_id,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 400.0E0 + (o_orderkey * 7 % 90) * 10 END AS price,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 10.0E0 + (o_orderkey * 3 % 70) + (o_orderkey % 4) * 0.25E0 END AS area,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(1 + o_orderkey * 5 % 4 AS INT) END AS rooms,
       CASE WHEN o_orderkey % 19 = 0 THEN NULL WHEN o_custkey % 5 = 0 THEN 'arles' WHEN o_custkey % 5 = 1 THEN 'brest'
            WHEN o_custkey % 5 = 2 THEN 'calais' WHEN o_custkey % 5 = 3 THEN 'dijon' ELSE 'evian' END AS city,
       CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE concat('0', CAST(6000 + o_custkey % 10 AS VARCHAR(9))) END AS postal_code,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('Quart', CAST(o_custkey % 12 AS VARCHAR(9))) END AS district,
       CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE concat(
         CASE WHEN o_orderkey % 4 = 3 THEN 'Studio ' ELSE 'Appartement ' END,
         CASE o_custkey % 4 WHEN 0 THEN 'lumineux calme ' WHEN 1 THEN 'avec balcon ' WHEN 2 THEN 'refait neuf ' ELSE 'face gare ' END,
         CASE WHEN o_custkey % 6 = 0 THEN 'centre' ELSE concat('quart', CAST(o_custkey % 12 AS VARCHAR(9))) END) END AS title,
       CASE WHEN o_orderkey % 21 = 0 THEN NULL ELSE concat(
         CASE o_custkey % 5 WHEN 0 THEN 'Spacieux traversant, dernier etage. ' WHEN 1 THEN 'Cuisine equipee, double vitrage, cave. '
           WHEN 2 THEN 'Parquet ancien, moulures. ' WHEN 3 THEN 'Jardin, terrasse, garage. ' ELSE 'Meuble, internet. ' END,
         CASE o_orderkey % 3 WHEN 0 THEN 'Revenus de 1800 euros, garant.' WHEN 1 THEN 'Ideal couple.' ELSE 'Libre de suite.' END) END AS description,
       CASE WHEN o_orderkey % 4 = 1 THEN NULL ELSE 20.0E0 + o_custkey % 9 * 5 END AS charges,
       CASE WHEN o_orderkey % 5 = 2 THEN NULL WHEN o_orderkey % 7 = 1 THEN 'R1'
            ELSE concat('REF-', CAST(o_custkey * 13 % 900 AS VARCHAR(9))) END AS reference,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat(CAST(1 + o_custkey % 30 AS VARCHAR(9)), CASE WHEN o_orderkey % 2 = 0 THEN ' Rue Haute' ELSE ', rue haute' END) END AS address,
       CASE WHEN o_orderkey % 3 = 1 THEN NULL ELSE 43.0E0 + o_custkey % 11 * 0.0006E0 + o_orderkey % 2 * 0.0005E0 END AS latitude,
       CASE WHEN o_orderkey % 3 = 1 THEN NULL ELSE 5.0E0 + o_custkey % 3 * 0.0004E0 END AS longitude,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 8 = 2 THEN concat('https://img.test/', CAST(o_custkey * 7 % 800 AS VARCHAR(9)), '.jpg')
            ELSE concat('https://img.test/', CAST(o_custkey * 7 % 800 AS VARCHAR(9)), '.jpg?w=', CAST(o_orderkey % 5 AS VARCHAR(9)), ',http://cdn.test/b/',
              CAST(o_custkey % 300 AS VARCHAR(9))) END AS images,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE chr(CAST(65 + o_custkey % 7 AS INT)) END AS dpe,
       CASE WHEN o_orderkey % 10 < 6 THEN NULL ELSE CAST(1 + o_custkey % 5 AS INT) END AS max_occupants,
       CASE WHEN o_orderkey % 2 = 0 THEN 'balcon,cave' WHEN o_orderkey % 3 = 0 THEN 'ascenseur' ELSE '' END AS features,
       CASE WHEN o_orderkey % 9 = 2 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) - (o_custkey % 3) * INTERVAL '1' DAY END AS published_at,
       CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) + (o_custkey % 30) * INTERVAL '1' DAY END AS available_at,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 2 = 0 END AS furnished,
       CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey % 9 = 0 END AS flat_share,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat('+33', CAST(600000000 + o_custkey * 37 % 900 AS VARCHAR(12))) END AS phone,
       CASE WHEN o_orderkey % 3 = 1 THEN NULL ELSE concat('u', CAST(o_custkey % 700 AS VARCHAR(9)), '@mail.test') END AS email,
       CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE concat('agency ', CAST(o_custkey % 40 AS VARCHAR(9))) END AS agency,
       CASE WHEN o_custkey % 8 = 0 THEN 'unknown' WHEN o_custkey % 3 = 0 THEN 'private' ELSE 'agency' END AS landlord,
       CASE WHEN o_orderkey % 9 = 4 THEN 'parking' WHEN o_orderkey % 4 = 3 THEN 'studio' WHEN o_orderkey % 31 = 0 THEN 'unknown'
            ELSE 'apartment' END AS property_type,
       CASE WHEN o_orderstatus = 'O' THEN 'active' WHEN o_orderstatus = 'P' THEN 'possiblyInactive' ELSE 'inactive' END AS lifecycle,
       CAST(o_orderkey * 11 % 60 AS INT) AS views,
       CAST(o_custkey % 12 AS INT) AS favorites,
       CAST(o_orderdate AS TIMESTAMP) AS first_seen,
       CAST(o_orderdate AS TIMESTAMP) + (o_custkey % 40) * INTERVAL '1' DAY AS last_seen
FROM orders
"""

#: One dwelling, from part.
LISTINGS = """
SELECT p_partkey AS id,
       CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_retailprice END AS price,
       CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS area,
       CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(1 + p_partkey % 4 AS INT) END AS rooms,
       CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_brand END AS agency,
       lower(p_type) AS property_type,
       p_name AS title,
       CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE concat('q', CAST(p_partkey % 12 AS VARCHAR(9))) END AS district,
       CASE WHEN p_partkey % 5 = 0 THEN 'evian' WHEN p_partkey % 19 = 0 THEN NULL ELSE 'arles' END AS city,
       CASE WHEN p_partkey % 5 = 1 THEN NULL ELSE p_partkey % 2 = 0 END AS furnished,
       CASE WHEN p_partkey % 6 = 1 THEN NULL ELSE p_partkey % 9 = 0 END AS flat_share,
       p_partkey % 14 = 0 AS student_only,
       CASE WHEN p_partkey % 8 = 0 THEN 'unknown' WHEN p_partkey % 3 = 0 THEN 'private' ELSE 'agency' END AS landlord,
       CASE WHEN p_partkey % 4 = 1 THEN NULL ELSE CAST(5 + p_partkey * 7 % 60 AS INT) END AS commute,
       CASE WHEN p_partkey % 10 = 2 THEN NULL ELSE CAST(1 + p_partkey % 5 AS INT) END AS max_occupants,
       CASE WHEN p_partkey % 6 = 2 THEN NULL ELSE chr(CAST(65 + p_partkey % 7 AS INT)) END AS dpe,
       CASE WHEN p_partkey % 4 = 0 THEN 'balcony,lift' WHEN p_partkey % 4 = 1 THEN 'cellar' ELSE '' END AS features,
       CASE WHEN p_partkey % 5 = 4 THEN 'inactive' WHEN p_partkey % 5 = 3 THEN 'possiblyInactive' ELSE 'active' END AS lifecycle,
       CASE WHEN p_partkey % 9 = 5 THEN NULL ELSE TIMESTAMP '2024-01-01 00:00:00' + (p_partkey % 90) * INTERVAL '1' DAY END AS available_at,
       TIMESTAMP '2024-01-01 00:00:00' + (p_partkey * 37 % 2000) * INTERVAL '1' HOUR AS first_seen,
       CASE WHEN p_partkey % 4 = 2 THEN NULL ELSE TIMESTAMP '2024-01-01 00:00:00' + (p_partkey * 31 % 1900) * INTERVAL '1' HOUR END AS published_at
FROM part
"""

#: What one user did with a listing: the latest order of that customer touching it.
USER_STATE = """
SELECT id, user_id, viewed, favorite, archived, tracking, acted_at FROM (
  SELECT o_orderkey % 2000 AS id, o_custkey % 50 AS user_id, o_orderkey % 2 = 0 AS viewed, o_orderkey % 7 = 0 AS favorite,
         o_orderkey % 11 = 0 AS archived,
         CASE WHEN o_orderkey % 10 < 3 THEN 'new' WHEN o_orderkey % 10 < 4 THEN 'toContact' WHEN o_orderkey % 10 < 6 THEN 'contacted' WHEN o_orderkey % 10 < 7 THEN 'visited'
              WHEN o_orderkey % 10 < 8 THEN 'rejected' ELSE NULL END AS tracking,
         CAST(o_orderdate AS TIMESTAMP) AS acted_at,
         row_number() OVER (PARTITION BY o_orderkey % 2000, o_custkey % 50 ORDER BY o_orderdate DESC, o_orderkey) AS rn
  FROM orders) t
WHERE rn = 1
"""

#: Scores that belong to one user: a row for each listing that the user has met.
USER_SCORE = """
SELECT id, user_id, CAST((id * 13 + user_id * 7) % 101 AS INT) AS match,
       CAST((id * 5 + user_id) % 101 AS INT) AS opportunity, CAST((id * 3 + user_id * 11) % 101 AS INT) AS visit,
       CAST((id + user_id * 17) % 101 AS INT) AS risk, (id + user_id) % 3 <> 0 AS matches
FROM (SELECT DISTINCT o_orderkey % 2000 AS id, o_custkey % 50 AS user_id FROM orders) p
"""

VIEWS = {"occurrences": OCCURRENCES, "listings": LISTINGS, "user_state": USER_STATE, "user_score": USER_SCORE}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; the base tables are bound inside the statement, no temporary view is left behind."""
    tables = {
        "occurrences": ["orders"], "listings": ["part"], "user_state": ["orders"], "user_score": ["orders"],
    }[name]
    sql = VIEWS[name]
    for t in tables:
        for word in ("FROM", "part,"):
            sql = sql.replace(f"{word} {t}", f"{word} {{{t}}}")
    sql = sql.replace("FROM part,", "FROM {part},")
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in tables})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_views(sql: str, *names: str) -> str:
    """``sql`` after WITH clauses of the named views, for the oracle."""
    own = ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
    body = sql.strip()
    recursive = ""
    if body.upper().startswith("WITH RECURSIVE "):
        recursive, body = "RECURSIVE ", "WITH " + body[len("WITH RECURSIVE ") :]
    if body.upper().startswith("WITH "):
        return f"WITH {recursive}{own}, {body[5:]}"
    return f"WITH {own} {body}"

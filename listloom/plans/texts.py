"""Text, parsing and page extraction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from listloom.catalogue import query
from listloom.functions import parse, text
from listloom.sources import pages
from listloom.sources.views import table

FOLD = f"trim(regexp_replace(translate(lower(x), '{text.ACCENTED}', '{text.PLAIN}'), '[^a-z0-9]+', ' ', 'g'))"


@query(
    f"SELECT doc_id, {FOLD.replace('(x)', '(text)')} AS folded, replace({FOLD.replace('(x)', '(text)')}, ' ', '-') AS slug, "
    f"translate(lower(text), '{text.ACCENTED}', '{text.PLAIN}') AS search FROM documents",
)
def text_folds(spark, sf_dir):
    """SCA-05, SCA-06, SCA-09."""
    df, whole = table(spark, sf_dir, "documents"), F.col("text")
    return df.select(
        "doc_id", text.district_fold(whole).alias("folded"), F.replace(text.district_fold(whole), F.lit(" "), F.lit("-")).alias("slug"), text.search_fold(whole).alias("search")
    )


def _decoded() -> str:
    """The fixed entities as nested replacements, in the order of the decoder."""
    out = "text"
    for code in (33, 39, 45, 124):
        out = f"replace({out}, '&#{code};', chr({code}))"
    for name, value in text.ENTITIES.items():
        out = f"replace({out}, '{name}', chr({ord(value)}))"
    return out


@query(
    f"SELECT doc_id, trim(regexp_replace(translate({_decoded()}, chr(160) || chr(8239) || chr(8201) || chr(9) || chr(10) || chr(13), '      '), ' +', ' ', 'g')) AS cleaned FROM documents",
)
def clean_texts(spark, sf_dir):
    """SCA-01, SCA-02: entities decoded, blanks made plain."""
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))


ENCODED = [*text.ENTITIES, "&#33;", "&#39;", "&#45;", "&#124;"]


@query(
    f"""WITH t AS (SELECT o_orderkey, [{', '.join(repr(e) for e in ENCODED)}] AS e FROM orders),
x AS (SELECT o_orderkey, 'a ' || e[1 + o_orderkey % {len(ENCODED)}] || e[1 + o_orderkey * 7 % {len(ENCODED)}] || 'b  c' AS text FROM t)
SELECT o_orderkey, trim(regexp_replace(translate({_decoded()}, chr(160) || chr(8239) || chr(8201) || chr(9) || chr(10) || chr(13), '      '), ' +', ' ', 'g')) AS cleaned FROM x"""
)
def decoded_entities(spark, sf_dir):
    """SCA-01: every entity of the fixed subset, two at a time."""
    listed = F.array(*[F.lit(e) for e in ENCODED])
    pick = lambda k: F.element_at(listed, (1 + F.col("o_orderkey") * k % len(ENCODED)).cast("int"))
    said = F.concat(F.lit("a "), pick(1), pick(7), F.lit("b  c"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.clean_text(said).alias("cleaned"))


@query(
    """WITH t AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN CAST(o_orderkey AS VARCHAR) || ' 450,50 x' WHEN 1 THEN '1.' || CAST(100 + o_orderkey % 900 AS VARCHAR) || ',5'
 WHEN 2 THEN '1,' || CAST(100 + o_orderkey % 900 AS VARCHAR) || '.25' WHEN 3 THEN CAST(o_orderkey % 99 AS VARCHAR) || ',5' WHEN 4 THEN '2.' || CAST(100 + o_orderkey % 900 AS VARCHAR) ELSE 'none' END AS x FROM orders)
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN CAST(CAST(o_orderkey AS VARCHAR) || '450.50' AS DOUBLE) WHEN 1 THEN 1000 + 100 + o_orderkey % 900 + 0.5 WHEN 2 THEN 1000 + 100 + o_orderkey % 900 + 0.25
 WHEN 3 THEN o_orderkey % 99 + 0.5 WHEN 4 THEN 2000 + 100 + o_orderkey % 900 END::DOUBLE AS number FROM t"""
)
def french_numbers(spark, sf_dir):
    """SCA-12."""
    x = F.expr(
        "CASE o_orderkey % 6 WHEN 0 THEN concat(o_orderkey, ' 450,50 x') WHEN 1 THEN concat('1.', 100 + o_orderkey % 900, ',5') WHEN 2 THEN concat('1,', 100 + o_orderkey % 900, '.25') "
        "WHEN 3 THEN concat(o_orderkey % 99, ',5') WHEN 4 THEN concat('2.', 100 + o_orderkey % 900) ELSE 'none' END"
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", text.parse_number(x).alias("number"))


@query("SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)?'), lambda x: TRY_CAST(replace(x, ',', '.') AS DOUBLE)), lambda v: v >= 3 AND v <= 500)[1] AS number FROM documents")
def bounded_numbers(spark, sf_dir):
    """SCA-13."""
    return table(spark, sf_dir, "documents").select("doc_id", text.extract_number(F.col("text"), 3, 500).alias("number"))


@query(
    """WITH t AS (SELECT o_orderkey, o_orderkey % 5 AS k, o_orderkey % 28 + 1 AS d, o_orderkey % 12 + 1 AS m, o_orderkey % 47 AS n FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN '2024-03-' || lpad(CAST(d AS VARCHAR), 2, '0') || ' 00:00' WHEN 1 THEN strftime(TIMESTAMP '2024-05-01 12:00:00' - n * INTERVAL '1' HOUR, '%Y-%m-%d %H:%M')
 WHEN 2 THEN strftime(make_date(2023, m::INT, 1) + (d + 3 - 1) * INTERVAL '1' DAY, '%Y-%m-%d %H:%M') WHEN 3 THEN '2024-04-30 12:00' END AS at FROM t"""
)
def relative_dates(spark, sf_dir):
    """SCA-27: ISO dates, ages, dd/mm/yyyy with days that roll over, yesterday; else unknown."""
    x = F.expr(
        "CASE o_orderkey % 5 WHEN 0 THEN concat('2024-03-', lpad(o_orderkey % 28 + 1, 2, '0')) WHEN 1 THEN concat('publié il y a ', o_orderkey % 47, ' heures') "
        "WHEN 2 THEN concat('le ', o_orderkey % 28 + 4, '/', o_orderkey % 12 + 1, '/2023') WHEN 3 THEN 'hier' ELSE 'bientôt' END"
    )
    now = F.lit("2024-05-01 12:00:00").cast("timestamp")
    at = parse.parse_published_at(x, now)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(at, "yyyy-MM-dd HH:mm").alias("at"))


@query(
    """WITH t AS (SELECT p_partkey, p_partkey % 9 AS k, 300 + p_partkey % 700 AS price, 10 + p_partkey % 90 AS area, 1 + p_partkey % 6 AS rooms FROM part)
SELECT p_partkey, price::DOUBLE AS price, CASE WHEN k < 4 THEN true WHEN k < 7 THEN false END AS charges_included, area::DOUBLE AS area, rooms::INT AS rooms,
 CASE WHEN k = 1 THEN 'house' WHEN k = 2 THEN 'parking' ELSE 'apartment' END AS property_type, CASE WHEN k % 3 = 0 THEN true WHEN k % 3 = 1 THEN false END AS furnished,
 '+33612345' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') AS phone, '06' || CAST(100 + p_partkey % 800 AS VARCHAR) AS postal_code,
 CASE WHEN k <> 5 THEN chr((65 + p_partkey % 7)::INT) END AS dpe FROM t"""
)
def listing_fields(spark, sf_dir):
    """SCA-14, SCA-16..19, SCA-22, SCA-26: fields read from one sentence."""
    said = F.expr(
        "concat(CASE p_partkey % 9 WHEN 1 THEN 'Maison' WHEN 2 THEN 'Garage' ELSE 'Appartement' END, ' de ', 1 + p_partkey % 6, ' pièces, ', 10 + p_partkey % 90, ' m², loyer ', 300 + p_partkey % 700, ' € ', "
        "CASE WHEN p_partkey % 9 < 4 THEN 'CC' WHEN p_partkey % 9 < 7 THEN 'HC' ELSE '' END, '. ', CASE p_partkey % 9 % 3 WHEN 0 THEN 'Meublé' WHEN 1 THEN 'Non meublé' ELSE 'Calme' END, "
        "'. ', CASE WHEN p_partkey % 9 <> 5 THEN concat('DPE ', char(65 + p_partkey % 7)) ELSE 'lumineux' END, ', 06', 100 + p_partkey % 800, ' tél 06 12 34 5', substring(lpad(p_partkey % 1000, 3, '0'), 1, 1), ' ', substring(lpad(p_partkey % 1000, 3, '0'), 2, 2))"
    )
    df = table(spark, sf_dir, "part").select("p_partkey", said.alias("t"))
    price = parse.parse_price(F.col("t"))
    return df.select(
        "p_partkey", price["amount"].alias("price"), price["charges_included"].alias("charges_included"), parse.parse_area(F.col("t")).alias("area"),
        parse.parse_rooms(F.col("t")).alias("rooms"), parse.parse_property_type(F.col("t")).alias("property_type"), parse.parse_furnished(F.col("t")).alias("furnished"),
        parse.parse_phone(F.col("t")).alias("phone"), parse.parse_postal_code(F.col("t")).alias("postal_code"), parse.parse_dpe(F.col("t")).alias("dpe"),
    )


@query("SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang FROM pages")
def html_titles(spark, sf_dir):
    """SRC-07, SRC-23: one generic extractor over raw pages."""
    return pages.titles(table(spark, sf_dir, "pages"))


@query("SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages")
def html_links(spark, sf_dir):
    """SRC-05, SRC-07."""
    return pages.links(table(spark, sf_dir, "pages"))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path FROM pages")
def url_parts(spark, sf_dir):
    """SRC-14, SCA-40, SCA-41."""
    return pages.url_parts(table(spark, sf_dir, "pages"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS text FROM pages")
def html_texts(spark, sf_dir):
    """SRC-07: readable text of a page."""
    return pages.texts(table(spark, sf_dir, "pages"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, json_extract_string(props, '$.none') AS none FROM events")
def json_props(spark, sf_dir):
    """SCA-49, SRC-08: JSON paths; malformed or missing gives null."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), F.get_json_object("props", "$.none").alias("none"))


@query("SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n, round(sum(value), 4)::DOUBLE AS total FROM events GROUP BY 1")
def json_props_rollup(spark, sf_dir):
    """SCA-49 with AGG-03."""
    k = F.from_json("props", "k int")["k"]
    return table(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    """SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'note' WHEN turn = 0 THEN 'first' ELSE 'follow-up ' || CAST(turn AS VARCHAR) END AS subject,
concat_ws(' / ', role, CAST(length(text) AS VARCHAR)) AS line FROM conversations"""
)
def message_composition(spark, sf_dir):
    """SCA-48, SCA-53: composed from known parts."""
    df = table(spark, sf_dir, "conversations")
    subject = F.when(F.col("role") == "system", "note").when(F.col("turn") == 0, "first").otherwise(F.concat(F.lit("follow-up "), F.col("turn").cast("string")))
    return df.select("conv_id", "turn", subject.alias("subject"), F.concat_ws(" / ", "role", F.length("text").cast("string")).alias("line"))

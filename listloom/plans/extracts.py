"""Extractor and adapter queries: sitemaps, structured data, mails, paged scans, and scalars over made texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from listloom.catalogue import query
from listloom.functions import geo, listing, parse, text
from listloom.operators import stores
from listloom.session import spread
from listloom.sources import adapters, normalize, pages
from listloom.sources.views import table

ENTRIES = """
e AS (SELECT 'http://a.test/' || CASE s_suppkey % 3 WHEN 0 THEN 'arles' WHEN 1 THEN 'Brest' ELSE 'lyon' END || '/' || s_suppkey || '-' || k AS loc,
 '2024-' || lpad(CAST(1 + (s_suppkey + k) % 12 AS VARCHAR), 2, '0') || '-15' AS lastmod FROM supplier, (SELECT unnest([1, 2, 3]) AS k) n)
"""


def _sitemaps(spark, sf_dir):
    entry = (
        "concat('<url><loc> http://a.test/', CASE s_suppkey % 3 WHEN 0 THEN 'arles' WHEN 1 THEN 'Brest' ELSE 'lyon' END, '/', s_suppkey, '-', k, "
        "' </loc><lastmod>2024-', lpad(1 + (s_suppkey + k) % 12, 2, '0'), '-15</lastmod></url>')"
    )
    xml = f"concat('<urlset>', array_join(transform(array(1, 2, 3), k -> {entry}), ''), '</urlset>')"
    return pages.sitemap(table(spark, sf_dir, "supplier").selectExpr(f"{xml} AS xml"))


@query(f"WITH {ENTRIES} SELECT loc, lastmod FROM e")
def sitemap_entries(spark, sf_dir):
    """SRC-05."""
    return _sitemaps(spark, sf_dir)


@query(f"""WITH {ENTRIES}, w AS (SELECT * FROM e WHERE (contains(lower(loc), 'arles') OR contains(lower(loc), 'brest')) AND lastmod >= '2024-04-01'),
n AS (SELECT *, row_number() OVER (ORDER BY lastmod DESC, loc) AS k FROM w WHERE NOT ends_with(loc, '-2'))
SELECT loc, 'confirmed' AS kind FROM w WHERE ends_with(loc, '-2') UNION ALL SELECT loc, 'visit' FROM n WHERE k <= 40""")  # fmt: skip
def crawl_plan(spark, sf_dir):
    """SRC-17, SRC-25, SRT-10: known refs are confirmed, of the others the latest are visited."""
    entries = _sitemaps(spark, sf_dir)
    known = entries.filter(F.endswith("loc", F.lit("-2"))).select("loc")
    confirmed, visit = pages.crawl_candidates(entries, known, "2024-04-01", 40, ["arles", "brest"])
    return confirmed.select("loc", F.lit("confirmed").alias("kind")).unionByName(visit.select("loc", F.lit("visit").alias("kind")))


ADAPTER = """WITH e AS (SELECT page_id, url, html, '2024-' || lpad(CAST(1 + page_id % 12 AS VARCHAR), 2, '0') || '-01' AS lastmod FROM pages),
w AS (SELECT *, page_id % 3 = 0 AS known FROM e WHERE lastmod >= '2024-03-01' AND contains(trim(regexp_replace(lower(url), '[^a-z0-9]+', ' ', 'g')), 'org')),
r AS (SELECT *, row_number() OVER (ORDER BY lastmod DESC, url) AS k FROM w WHERE NOT known)
"""


def _run(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    entries = p.selectExpr("url AS loc", "concat('2024-', lpad(1 + page_id % 12, 2, '0'), '-01') AS lastmod")
    known = p.filter("page_id % 3 = 0").select(F.col("url").alias("loc"))
    return adapters.SitemapAdapter("site", ("org",), "2024-03-01", 200).run(entries, p, known)


@query(ADAPTER + "SELECT 'site' AS source_id, url AS source_url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM r WHERE k <= 200")
def adapter_listings(spark, sf_dir):
    """SRC-01, SRC-17: the raw listings of a run."""
    return _run(spark, sf_dir).listings.select("source_id", "source_url", "title")


@query(ADAPTER + """SELECT kind, n, CASE WHEN (SELECT count(*) FROM r WHERE k > 200) > 0 THEN 'budget' ELSE 'exhausted' END AS stop FROM (
 SELECT 'listings' AS kind, count(*) AS n FROM r WHERE k <= 200 UNION ALL SELECT 'confirmed', count(*) FROM w WHERE known UNION ALL SELECT 'left', count(*) FROM r WHERE k > 200)""")  # fmt: skip
def adapter_counts(spark, sf_dir):
    """SRC-01: counts and stop reason of a run."""
    return _run(spark, sf_dir).counts()


SCANS = """SELECT c_custkey % 40 AS source_id, CAST(c_custkey // 40 AS BIGINT) AS page, CASE WHEN c_custkey % 37 = 5 THEN 12 ELSE 20 END AS n,
 CASE WHEN c_custkey % 40 < 10 THEN 60 END AS total, CASE WHEN c_custkey % 23 = 3 THEN 304 ELSE 200 END AS status,
 CASE WHEN c_custkey % 46 = 3 THEN 7 WHEN c_custkey % 5 < 3 THEN 20 END AS remembered FROM customer WHERE c_custkey >= 40"""


@query(f"""WITH p AS ({SCANS}), m AS (SELECT *, CASE WHEN status = 304 AND remembered < 20 THEN 'remembered' WHEN CASE WHEN status = 304 THEN remembered ELSE n END < 20 THEN 'short'
 WHEN page * 20 >= total THEN 'total' END AS reason FROM p),
s AS (SELECT source_id, coalesce(min(page) FILTER (reason IS NOT NULL), max(page)) AS last_page, coalesce(arg_min(reason, page) FILTER (reason IS NOT NULL), 'end') AS reason FROM m GROUP BY source_id)
SELECT source_id, last_page, reason, CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.source_id = s.source_id AND page <= last_page AND status = 304 AND remembered IS NULL) THEN 'notModified' ELSE 'ok' END AS outcome FROM s""")  # fmt: skip
def paged_scans(spark, sf_dir):
    """SRC-29: where a paged scan ends and why, and unchanged pages that nobody remembers."""
    sql = SCANS.replace("c_custkey // 40", "c_custkey div 40").replace(" AS n,", " AS rows,").replace("FROM customer", "FROM {c}")
    return adapters.paged_scan(spark.sql(sql, c=table(spark, sf_dir, "customer")), 20)


@query("""WITH p AS (SELECT c_custkey % 40 AS source_id, CAST(c_custkey // 40 AS BIGINT) AS page, c_custkey % 7 = 1 AND c_custkey % 40 <> 9 AS known FROM customer WHERE c_custkey >= 40),
d AS (SELECT source_id, source_id % 10 = 0 OR source_id % 4 = 1 OR source_id % 6 = 5 AS full_due FROM (SELECT DISTINCT source_id FROM p)),
s AS (SELECT source_id, min(page) FILTER (known) AS stop, max(page) AS last FROM p GROUP BY source_id)
SELECT p.source_id, page, full_due OR stop IS NULL AS "full" FROM p JOIN d USING (source_id) JOIN s USING (source_id) WHERE page <= CASE WHEN full_due THEN last ELSE coalesce(stop, last) END""")  # fmt: skip
def full_pass_pages(spark, sf_dir):
    """SRC-30, SRC-31: full passes when they are due, else up to the first page of known refs."""
    p = table(spark, sf_dir, "customer").filter("c_custkey >= 40").selectExpr(
        "c_custkey % 40 AS source_id", "c_custkey div 40 AS page", "c_custkey % 7 = 1 AND c_custkey % 40 <> 9 AS known"
    )
    last = F.expr("CASE WHEN source_id % 4 = 1 THEN NULL WHEN source_id % 6 = 5 THEN timestamp '2024-05-01 05:00:00' ELSE timestamp '2024-05-01 11:00:00' END")
    now = F.lit("2024-05-01 12:00:00").cast("timestamp")
    due = p.select("source_id").distinct().withColumn("full", adapters.full_pass(last, now, F.expr("source_id % 10 = 0")))
    return adapters.pages_of_run(p, due)


@query("""SELECT c_custkey AS page_id, 'Offer' AS type, 'n' || c_custkey AS name, CAST(500 + c_custkey % 300 AS VARCHAR) AS price FROM customer WHERE c_custkey % 4 < 2
UNION ALL SELECT c_custkey, 'Place', NULL, NULL FROM customer WHERE c_custkey % 4 = 1""")  # fmt: skip
def json_ld_nodes(spark, sf_dir):
    """SRC-06: single nodes, graphs, and blocks that cannot be read."""
    offer = """concat('{"@type":"Offer","name":"n', c_custkey, '","price":"', 500 + c_custkey % 300, '"}')"""
    block = f"""CASE c_custkey % 4 WHEN 0 THEN {offer} WHEN 1 THEN concat('{{"@graph":[', {offer}, ',{{"@type":"Place"}}]}}') WHEN 2 THEN '{{broken' ELSE '{{}}' END"""
    html = f"""concat('<html><script type="application/ld+json">', {block}, '</script><p>x</p></html>')"""
    return pages.json_ld(table(spark, sf_dir, "customer").selectExpr("c_custkey AS page_id", f"{html} AS html")).select("page_id", "type", "name", "price")


@query("""WITH m AS (SELECT c_custkey AS mail_id, c_custkey % 60 AS ad FROM customer),
f AS (SELECT ad, min(mail_id) AS mail_id FROM m GROUP BY ad)
SELECT 'https://p.test/ad/' || ad AS ref, mail_id, 'https://p.test/ad/' || ad || '?s=' || mail_id AS url, 'T2 ' || (500 + mail_id % 90) || ' €' AS text FROM f""")  # fmt: skip
def mail_digest_cards(spark, sf_dir):
    """SRC-12, SRC-13: cards of mails behind tracking links, in two ways; the first of a ref stays."""
    target = "concat('https://p.test/ad/', c_custkey % 60, '?s=', c_custkey)"
    wrapped = f"CASE WHEN c_custkey % 2 = 0 THEN concat('https://t.test/r?url=', url_encode({target})) ELSE concat('https://t.test/', rtrim('=', translate(base64(encode({target}, 'UTF-8')), '+/', '-_'))) END"
    html = f"""concat('<table><tr><td><a href="', {wrapped}, '"><b>T2</b> ', 500 + c_custkey % 90, ' €</a></td></tr></table><a href="https://t.test/more">plus</a>')"""
    return pages.mail_cards(table(spark, sf_dir, "customer").selectExpr("c_custkey AS mail_id", f"{html} AS html"))


@query("""SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 1000.0 + c_custkey % 500 END::DOUBLE AS min_income, CASE WHEN c_custkey % 4 = 1 THEN true END AS insured_rent,
 CASE c_custkey % 4 WHEN 0 THEN 'guarantor' WHEN 2 THEN 'visale' ELSE '' END AS guarantees, CASE c_custkey % 4 WHEN 0 THEN 'permanent' WHEN 2 THEN 'student' ELSE '' END AS situations,
 CASE c_custkey % 5 WHEN 0 THEN 'private' WHEN 1 THEN 'agency' WHEN 2 THEN 'agency' WHEN 3 THEN 'private' ELSE 'unknown' END AS landlord,
 c_custkey % 6 IN (1, 2) AS sale FROM customer""")  # fmt: skip
def requirement_fields(spark, sf_dir):
    """SCA-36, SCA-51, FLT-22: conditions, the landlord's kind, and sales among rentals."""
    said = F.expr(
        "CASE c_custkey % 4 WHEN 0 THEN concat('Revenus de ', 1000 + c_custkey % 500, ' euros, CDI et garant exigés') WHEN 1 THEN 'Assurance loyers impayés' "
        "WHEN 2 THEN 'Visale accepté, étudiant bienvenu' ELSE 'Joli' END"
    )
    r = parse.parse_requirements(said)
    kind = parse.landlord_kind(
        F.expr("CASE c_custkey % 5 WHEN 0 THEN 'private' WHEN 3 THEN 'unknown' END"), F.expr("CASE c_custkey % 5 WHEN 1 THEN 'agency 7' END"),
        F.expr("CASE c_custkey % 5 WHEN 2 THEN 'honoraires en sus' WHEN 3 THEN 'loué par particulier' ELSE '' END"), F.lit(None).cast("string"),
    )
    url = F.expr("CASE c_custkey % 6 WHEN 1 THEN 'https://x.test/vente/1' WHEN 3 THEN 'https://x.test/ventes-privees' ELSE 'https://x.test/location/1' END")
    sale = parse.is_sale(url, F.expr("CASE c_custkey % 6 WHEN 2 THEN 'Appartement à vendre' ELSE 'à louer' END"))
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("k"), r["min_income"].alias("min_income"), r["insured_rent"].alias("insured_rent"),
        F.array_join(r["guarantees"], ",").alias("guarantees"), F.array_join(r["situations"], ",").alias("situations"), kind.alias("landlord"), sale.alias("sale"),
    )


@query("""SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN (1 + c_custkey % 90) || ' avenue du port' WHEN 1 THEN (1 + c_custkey % 90) || ' boulevard haut' ELSE 'place neuve' END AS street,
 'a b' || chr(10) || chr(10) || 'c' || c_custkey AS lines, 'login [mail] password=[hidden] ok' AS redacted, 'm' || c_custkey || '@x.test,other@y.test' AS addresses,
 CASE WHEN c_custkey % 2 = 0 THEN lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS token, make_date(2024, 1 + (c_custkey % 12)::INT, 15)::VARCHAR AS latest,
 CASE WHEN c_custkey % 2 = 1 THEN (20 + c_custkey % 70)::DOUBLE END AS charges, (1 + c_custkey % 40)::INT AS minutes,
 CAST(floor((5 + c_custkey % 30) * 18.0::DOUBLE / 4.5 + 0.5) AS INT) AS walk, 'https://img.test/' || c_custkey AS image,
 'About: T' || c_custkey % 5 || '. Free for a visit tomorrow. Regards, ' || c_name AS message, c_custkey % 7 = 3 AS closed FROM customer""")  # fmt: skip
def made_scalars(spark, sf_dir):
    """SCA-03, SCA-07, SCA-32, SCA-42, SCA-46..48, SCA-56..58, SRC-15, SRC-34: scalars over texts made for them."""
    e = lambda x: F.expr(x)
    address = e("CASE c_custkey % 3 WHEN 0 THEN concat(1 + c_custkey % 90, ', Av. du Port') WHEN 1 THEN concat(1 + c_custkey % 90, ' bd. Haut') ELSE 'Pl Neuve' END")
    wrapped = e("translate(base64(encode(concat('https://img.test/', c_custkey), 'UTF-8')), '+/=', '-_')")
    slices = F.array(F.substring(wrapped, 1, 7), F.substring(wrapped, 8, 400))
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("k"), text.comparable_address(address).alias("street"),
        text.clean_multiline(e("concat('a  b \\n\\n\\n\\n c', c_custkey, '  ')")).alias("lines"),
        text.redact(e("concat('login u', c_custkey, '@x.test password=s', c_custkey, ' ok')")).alias("redacted"),
        F.array_join(listing.addresses_in(e("concat('M', c_custkey, '@x.test <other@y.test>, m', c_custkey, '@x.test')")), ",").alias("addresses"),
        pages.recipient_token(e("CASE WHEN c_custkey % 2 = 0 THEN concat('in+', lpad(c_custkey, 8, '0'), '@z.test') ELSE 'in@z.test' END")).alias("token"),
        listing.most_recent(e("concat('2024-', lpad(1 + c_custkey % 12, 2, '0'), '-15')"), e("CASE WHEN c_custkey % 2 = 0 THEN '2023-01-01' ELSE 'soon' END")).cast("string").alias("latest"),
        listing.charges_from_mentions(e("CASE WHEN c_custkey % 2 = 1 THEN concat('Provision mensuelle pour charges : ', 20 + c_custkey % 70, ' €') ELSE 'Charges comprises' END")).alias("charges"),
        listing.journey_minutes(e("array(60 * (1 + c_custkey % 40) + 20, 9000, 60 * (1 + c_custkey % 40) + 29)")).alias("minutes"),
        geo.converted_minutes(e("5 + c_custkey % 30"), "transit", "walk").alias("walk"), pages.proxied_image(slices).alias("image"),
        listing.message(F.col("c_name"), e("concat(' T', c_custkey % 5, ' ')"), F.lit("tomorrow")).alias("message"),
        stores.closed(e("CASE WHEN c_custkey % 7 = 3 THEN 'Cette annonce n''est plus disponible' ELSE 'Disponible' END"), ("plus disponible", "déjà loué")).alias("closed"),
    )


NORMAL = """WITH p AS (SELECT p_partkey AS k, p_partkey % 8 AS m FROM part)
SELECT 'src:' || k AS id, 'Appartement T' || (1 + k % 4) || CASE WHEN m < 4 THEN ' meublé' ELSE '' END AS title, (600 + k % 500)::DOUBLE AS price,
 CASE WHEN m % 2 = 0 THEN true ELSE false END AS charges_included, (20 + k % 60)::DOUBLE AS area, (1 + k % 4)::INT AS rooms, 'apartment' AS property_type,
 CASE WHEN m < 4 THEN true END AS furnished, chr((65 + k % 7)::INT) AS dpe, '+336' || lpad(CAST(k % 100000000 AS VARCHAR), 8, '0') AS phone,
 CASE WHEN m % 3 = 0 THEN 'agency' ELSE 'private' END AS landlord, CASE WHEN m < 2 THEN 'balcony' ELSE '' END AS features, 'Arles' AS city, '13200' AS postal_code
FROM p WHERE m <> 7"""


@query(NORMAL)
def normalized_listings(spark, sf_dir):
    """SCA-52: raw text rows of a source to typed occurrences; sales and rows without a title go."""
    raw = spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").selectExpr(
        "'src' AS source_id", "cast(p_partkey AS string) AS source_ref",
        "concat('https://x.test/', CASE WHEN p_partkey % 16 = 7 THEN 'vente/' ELSE 'location/' END, p_partkey) AS source_url",
        "CASE WHEN p_partkey % 16 = 15 THEN ' ' ELSE concat(' Appartement  T', 1 + p_partkey % 4, CASE WHEN p_partkey % 8 < 4 THEN ' meublé' ELSE '' END) END AS title",
        "concat('Bel ', CASE WHEN p_partkey % 8 < 2 THEN 'appart, balcon' ELSE 'espace' END, '. DPE : ', char(65 + p_partkey % 7), '. Tél 06 ', "
        "regexp_replace(lpad(p_partkey % 100000000, 8, '0'), '(..)(..)(..)(..)', '$1 $2 $3 $4')) AS description",
        "concat(600 + p_partkey % 500, ' € ', CASE WHEN p_partkey % 2 = 0 THEN 'CC' ELSE 'HC' END) AS price_text", "concat(20 + p_partkey % 60, ' m²') AS area_text",
        "'arles' AS city", "'13200' AS postal_code", "CASE WHEN p_partkey % 8 % 3 = 0 THEN 'Agence X' END AS agency",
    )
    done = normalize.normalize(raw, F.lit("2024-05-01 12:00:00").cast("timestamp"), "private")
    return done.select(
        "id", "title", "price", "charges_included", "area", "rooms", "property_type", "furnished", "dpe", "phone", "landlord",
        F.array_join("features", ",").alias("features"), "city", "postal_code",
    )


@query("""WITH p AS (SELECT c_custkey AS k, c_custkey % 5 AS m FROM customer WHERE c_custkey % 5 <> 4)
SELECT k, unnest(CASE m WHEN 0 THEN ['n' || k] WHEN 1 THEN ['r' || k, 's' || k] WHEN 2 THEN ['n' || k, 't' || k] END) AS ref FROM p WHERE m < 3""")  # fmt: skip
def page_memory(spark, sf_dir):
    """SCH-07: refs of fetched pages, and the remembered ones of pages that have not changed."""
    c = table(spark, sf_dir, "customer")
    fetched = c.filter("c_custkey % 5 <> 4").selectExpr(
        "c_custkey AS k", "concat('u', c_custkey) AS url",
        "CASE c_custkey % 5 WHEN 0 THEN array(concat('n', c_custkey)) WHEN 2 THEN array(concat('n', c_custkey), concat('t', c_custkey)) END AS fresh",
    )
    memory = c.filter("c_custkey % 5 < 2").selectExpr("concat('u', c_custkey) AS url", """concat('["r', c_custkey, '","s', c_custkey, '"]') AS refs""")
    joined = fetched.join(memory, "url", "left")
    return joined.select("k", F.explode(listing.merged_pages(F.col("refs"), F.col("fresh"))).alias("ref"))


@query("""SELECT 'a' || c_custkey AS id, 'T' || c_custkey % 5 AS title, (500 + c_custkey % 400)::DOUBLE AS price,
 CASE WHEN c_custkey % 3 < 2 THEN 43.5::DOUBLE END AS lat, CASE WHEN c_custkey % 3 < 2 THEN 5.25::DOUBLE END AS lon FROM customer WHERE c_custkey % 6 <> 5""")
def api_answers(spark, sf_dir):
    """SRC-08, SRC-09: ads of JSON answers; blurred positions do not count, nor do answers that cannot be read."""
    position = """CASE c_custkey % 3 WHEN 0 THEN ',"position":{"lat":43.5,"lon":5.25}' WHEN 1 THEN ',"position":{"lat":43.5,"lon":5.25,"radius":100}' ELSE ',"position":{"lat":43.5,"lon":5.25,"radius":500}' END"""
    ad = f"""concat('{{"id":"a', c_custkey, '","title":"T', c_custkey % 5, '","price":', 500 + c_custkey % 400, {position}, '}}')"""
    body = f"""CASE WHEN c_custkey % 6 = 5 THEN '<html>' ELSE concat('{{"ads":[', {ad}, ']}}') END"""
    return pages.api_listings(table(spark, sf_dir, "customer").selectExpr(f"{body} AS body"))


@query("""SELECT c_custkey AS page_id, 'r' || c_custkey || '-' || k AS ref, CASE WHEN k = 1 THEN CAST(400 + c_custkey % 300 AS VARCHAR) END AS price
FROM customer, (SELECT unnest([1, 2]) AS k) n WHERE c_custkey % 4 <> 3""")  # fmt: skip
def inline_ads(spark, sf_dir):
    """SRC-10: the objects of a script's array."""
    html = (
        "CASE WHEN c_custkey % 4 = 3 THEN '<p>none</p>' ELSE concat('<script>var x = 1; var ads = [{ref: \"r', c_custkey, '-1\", price: ', 400 + c_custkey % 300, "
        "'}, {ref:''r', c_custkey, '-2'', price: \"\"}];</script>') END"
    )
    return pages.inline_entries(table(spark, sf_dir, "customer").selectExpr("c_custkey AS page_id", f"{html} AS html"), "ads", ("ref", "price"))


@query("""WITH n AS (SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'Agence ' || c_mktsegment WHEN 1 THEN substr(c_mktsegment, 1, 4) WHEN 2 THEN 'New ' || c_custkey % 30 ELSE '' END AS name FROM customer)
SELECT DISTINCT name FROM n WHERE name LIKE 'New %' AND name <> 'New 7'""")
def unknown_agencies(spark, sf_dir):
    """SRC-16: names that neither hold nor are held by a known one."""
    c = table(spark, sf_dir, "customer")
    found = c.selectExpr("CASE c_custkey % 4 WHEN 0 THEN concat('Agence ', c_mktsegment) WHEN 1 THEN substring(c_mktsegment, 1, 4) WHEN 2 THEN concat('New ', c_custkey % 30) ELSE '' END AS name")
    known = c.selectExpr("c_mktsegment AS name").union(c.selectExpr("'new 7' AS name")).distinct()
    return pages.unknown_names(found, known).distinct()

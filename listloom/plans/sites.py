"""Queries over HTML: the node table of the given pages, and sites run from rule rows over pages made of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from listloom.catalogue import query
from listloom.session import Scratch, spread
from listloom.sources import html, sites
from listloom.sources.views import table


@query(
    """WITH t AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(coalesce(html, ''), '<!--.*?-->|(<script[^>]*>).*?</script>', '\\1', 'g'), '<([a-z][a-z0-9]*)[ >]', 1)) AS tag FROM pages)
SELECT page_id, tag, count(*) AS n FROM t GROUP BY page_id, tag"""
)
def html_tags(spark, sf_dir):
    """SRC-23: elements of every page by tag, from the node table."""
    found = html.nodes(table(spark, sf_dir, "pages"))
    return found.filter("not startswith(tag, '#')").groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


PARAGRAPHS = r"""
WITH a AS (SELECT page_id, regexp_extract(html, '<article>(.*)</article>', 1, 's') AS x FROM pages),
p AS (SELECT page_id, unnest(string_split(x, '<p>')[2:]) AS part, generate_subscripts(string_split(x, '<p>')[2:], 1) AS k FROM a),
t AS (SELECT page_id, k, string_split(part, '</p>')[1] AS part FROM p)
SELECT page_id, k, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(part, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[\s ]+', ' ', 'g')) AS text FROM t
"""


@query(PARAGRAPHS)
def html_paragraphs(spark, sf_dir):
    """SRC-23: paragraphs of the articles with their whole text; many are never closed."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), "html")
    found = Scratch(spark, "nodes").keep(html.nodes(pages, "page"))
    article = found.filter("tag = 'article'").select("page", F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"))
    inside = found.filter("tag = 'p'").join(article, "page").filter("lo > a_lo and lo <= a_hi").select("page", "lo", "hi")
    said = html.texts_of(inside, found, ["page", "lo"])
    listed = said.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("lo", "said"))).alias("x"))
    each = listed.select("page", F.posexplode("x").alias("k", "x"))
    return each.select(F.col("page").alias("page_id"), (F.col("k") + 1).cast("long").alias("k"), F.col("x.said").alias("text"))


CITY = "CASE k % 3 WHEN 0 THEN 'Nice' WHEN 1 THEN 'Arles' ELSE 'La Rochelle' END"
AREA = "concat(10 + k % 70, CASE WHEN k % 2 = 1 THEN '.5' ELSE '' END)"
#: Pages of the sites; k is the key of the row that a page or a card is made of.
ARIA_ROW = "concat('<div role=\"row\" class=\"', CASE WHEN k % 2 = 0 THEN concat('table-aria__tr table-aria__tr--', '{key}') ELSE concat('table-aria__tr ', '{key}') END, '\"><span role=\"cell\">x</span> <span role=\"cell\">', {value}, '</span></div>')"


def _aria_row(key: str, value: str, when: str = "true") -> str:
    return f"CASE WHEN {when} THEN {ARIA_ROW.format(key=key, value=value)} ELSE '' END"


ARIA = f"""
SELECT concat('aria', k) AS page, 'aria' AS site, concat('https://aria.test/location/1-nice/', k, '-bel-appart?x=1') AS url,
  CASE WHEN k % 11 = 0 THEN NULL ELSE concat('<!DOCTYPE html><html><head><title>Location appartement ', {CITY}, ' ', 1 + k % 5, ' pièces ',
    CASE WHEN k % 4 = 0 THEN '' ELSE concat({AREA}, 'm² ') END, 400 + k % 900, '€ | Agence</title><script>if (a < b) {{ "<h1>no</h1>" }}</script></head><body>',
    CASE WHEN k % 5 = 0 THEN '' ELSE concat('<h1>Bel  appart&eacute; ', k, '</h1>') END, '<div class="table-aria">',
    {_aria_row('loyer_cc', "concat(400 + k % 900, ' €')", 'k % 3 <> 0')}, {_aria_row('surface', f"concat({AREA}, ' m2')", 'k % 8 = 0')}, {_aria_row('surf_habitable', AREA, 'k % 8 = 4')},
    {_aria_row('charges_mensuelles', "concat(k % 40, ' €')", 'k % 6 = 2')}, {_aria_row('meuble', "CASE WHEN k % 6 = 0 THEN 'OUI' ELSE 'Non' END", 'k % 6 < 2')},
    {_aria_row('cp', "concat('060', lpad(CAST(k % 100 AS STRING), 2, '0'))", 'k % 7 <> 1')}, {_aria_row('balcon', "CASE WHEN k % 2 = 0 THEN 'Oui' ELSE 'NON' END")},
    {_aria_row('cave', "'OUI'", 'k % 3 = 1')}, {_aria_row('vue', "'mer'", 'k % 5 = 2')}, '</div>',
    '<div class="c description__text big">Bel &amp; grand<br>  appart ', k, ' <b>calme', CASE WHEN k % 7 = 0 THEN '' ELSE '</b>' END, '</div></i>',
    '<img src="data:x" data-src="//cdn.test/images/biens/original/', k, '-1.jpg"><img data-src="https://cdn.test/images/biens/1600xauto/', k, '-1.jpg">',
    '<img data-src="https://cdn.test/images/biens/', k, '-2.jpg?x=1"/><img data-src="/images/logo.png">', CASE WHEN k % 7 = 0 THEN '<p><ul><li>' ELSE '</body></html>' END) END AS html
FROM (SELECT p_partkey AS k FROM {{part}}) t"""
BLOCKS = """
SELECT concat('blocks', k) AS page, 'blocks' AS site, concat('https://blocks.test/location/appartement-nice,', k, '#top') AS url,
  concat('<html><head><script type="application/ld+json">', CASE WHEN k % 9 = 0 THEN '{broken' ELSE concat('{"@type":"Product","name":"N ', k, '","image":"https://img.test/', k,
    '.jpg","offers":{"price":"', 400 + k % 900, '","itemOffered":{', CASE WHEN k % 4 = 1 THEN '' ELSE concat('"numberOfRooms":', 1 + k % 5, ',') END,
    '"floorSize":{"value":', 10 + k % 70, '},"address":{"addressLocality":"Nice","postalCode":"06', lpad(CAST(k % 100 AS STRING), 3, '0'), '"}}}}') END, '</script></head><body>',
    CASE WHEN k % 5 = 0 THEN '' ELSE concat('<section><div data-author="builder"> Descriptif </div>text<div data-author="builder"><h2>T ', k, '</h2><p>Bel <i>appart</i> ', k, '<p>Autre</div></section>') END,
    '<ul><li><span class="textblock a">Surface :</span> <span class="textblock">', 10 + k % 70, ',5 m²</span>', CASE WHEN k % 2 = 0 THEN '<li>' ELSE '</li><li>' END,
    '<span class="textblock">Pièces</span><span class="textblock">', 1 + k % 5, '</span></li>', CASE WHEN k % 6 = 0 THEN '<li><span class="textblock">Charges</span><span class="textblock">30 €</span></li>' ELSE '' END,
    CASE WHEN k % 8 < 3 THEN '<li><span class="textblock">Ameublement :</span><span class="textblock">Meublé</span></li>' ELSE '' END, '</ul><a href="tel:+33', k, '">Appeler</a>') AS html
FROM (SELECT c_custkey AS k FROM {customer}) t"""
CARD = """concat('<div class="x liste-bien-container y"', CASE WHEN k % 13 = 5 THEN '' ELSE concat(' data-show-on-map="', k, '"') END, '><h2 class="liste-bien-type">Appartement T', 1 + k % 5,
  '</h2><h3>Nice', CASE WHEN k % 2 = 0 THEN ' - Port' ELSE '' END, '</h3><costpermonth data-ope="', CASE WHEN k % 10 = 3 THEN 1 ELSE 2 END, '" data-price="', 400 + k % 900, '.00"></costpermonth>',
  '<ul><li data-ribbon-prop="Vendu">', CASE WHEN k % 17 = 2 THEN 1 ELSE 0 END, '<li data-ribbon-prop="New">1</ul><img data-src="', CASE WHEN k % 5 = 0 THEN 'https://img.test/vide_liste.png' ELSE concat('https://img.test/', k, '.jpg') END,
  '"><a href="/detail.htm?cle=', k, '&amp;x=1">Voir</a></div>')"""
SPECS = """
SELECT concat('specs', k) AS page, 'specs' AS site, concat('https://cards.test/detail.htm?cle=', k) AS url,
  concat('<body><h1>Nice (06', lpad(CAST(k % 100 AS STRING), 3, '0'), ')</h1><div class="detail-bien-specs"><ul><li><span class="bien-specs-label">Surface</span> 4', k % 10, ',5 m²<li><b class="bien-specs-label">Nombre de pièces</b>: ',
    1 + k % 5, '</ul></div><p itemprop="description">Calme ', k, '</p>') AS html
FROM (SELECT p_partkey AS k FROM {part}) t WHERE k % 2 = 0"""
ROW = """concat('<tr data-ref="r', k, '"><td><a href="/o/r', k, '">Studio ', k, '</a><td>', 300 + k % 500, ' €<td>', CASE WHEN k % 4 = 0 THEN '' ELSE concat(12 + k % 30, ' m²') END)"""
DEFS = """
SELECT concat('defs', k) AS page, 'defs' AS site, concat('https://rows.test/o/r', k, '?u=2') AS url,
  concat('<dl><dt>Pièces<dd>', 1 + k % 5, '<dt>Meublé<dd>', CASE WHEN k % 2 = 0 THEN 'oui' ELSE 'non' END, '<dt>Ville<dd>Brest<dt>Atouts<dd><ul><li>Cave<li>Balcon<li>Cave</ul></dl><section id="text">Lumineux <em>', k, '</em></section>') AS html
FROM (SELECT s_suppkey AS k FROM {supplier}) t WHERE k % 3 <> 0"""


def _list_pages(spark, rows, site: str, card: str, size: int, before: str, after: str):
    """Pages of ``size`` cards each, in the order of their keys."""
    cards = rows.selectExpr("k", f"k div {size} AS n", f"{card} AS card").groupBy("n").agg(F.array_sort(F.collect_list(F.struct("k", "card"))).alias("x"))
    body = F.array_join(F.transform("x", lambda c: c["card"]), "\n")
    return cards.select(
        F.concat(F.lit(site), F.col("n").cast("string")).alias("page"), F.lit(site).alias("site"), F.concat(F.lit(f"https://{site}.test/list/"), F.col("n").cast("string")).alias("url"),
        F.concat(F.lit(before), body, F.lit(after)).alias("html"),
    )


def site_pages(spark, sf_dir):
    """(page, site, url, html) of all five sites."""
    keys = {"part": "p_partkey", "customer": "c_custkey", "supplier": "s_suppkey"}
    # A page is made of a key: few bytes are read, and much is made and parsed of them.
    t = {n: spread(table(spark, sf_dir, n).select(k), k) for n, k in keys.items()}
    parts, suppliers = t["part"].select(F.col("p_partkey").alias("k")), t["supplier"].select(F.col("s_suppkey").alias("k"))

    def made_of(sql: str, name: str):
        """Braces of the pages are doubled, but for the table's place."""
        return spark.sql(sql.replace("{", "{{").replace("}", "}}").replace(f"{{{{{name}}}}}", f"{{{name}}}"), **{name: t[name]})

    made = [
        made_of(ARIA, "part"),
        made_of(BLOCKS, "customer"),
        made_of(SPECS, "part"),
        made_of(DEFS, "supplier"),
        _list_pages(spark, parts, "cards", CARD, 10, "<html><body><nav><li>x</nav>", "</body></html>"),
        _list_pages(spark, suppliers, "rows", ROW, 25, "<table id=nav><tr data-ref=no><td>no</table><table id=offers><tr><th>a<th>b<th>c", "</table>"),
    ]
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out


RULES = [
    *sites.aria_rules("aria"), *sites.block_rules("blocks"), *sites.card_rules("cards"), *sites.spec_rules("specs"), *sites.row_rules("rows"),
    *sites.definition_rules("defs"),
]

NOTHING = {f: "NULL" for f in sites.FIELDS}
S_CITY, S_AREA = CITY, "(10 + k % 70) || CASE WHEN k % 2 = 1 THEN '.5' ELSE '' END"
ARIA_SQL = NOTHING | {
    "ref": "k::VARCHAR", "url": "'https://aria.test/location/1-nice/' || k || '-bel-appart'", "title": f"CASE WHEN k % 5 = 0 THEN 'Location appartement ' || {S_CITY} || ' ' || (1 + k % 5) || ' pièces ' || CASE WHEN k % 4 = 0 THEN '' ELSE {S_AREA} || 'm² ' END || (400 + k % 900) || '€' ELSE 'Bel apparté ' || k END",
    "description": "'Bel & grand appart ' || k || ' calme'", "price_text": "CASE WHEN k % 3 = 0 THEN (400 + k % 900) || '€' ELSE (400 + k % 900) || ' € CC' END",
    "charges_text": "CASE WHEN k % 6 = 2 THEN (k % 40) || ' € de charges' END", "area_text": f"CASE WHEN k % 4 = 0 THEN {S_AREA} || ' m²' ELSE {S_AREA} || 'm²' END",
    "rooms_text": "(1 + k % 5) || ' pièces'", "type_text": "'appartement'", "furnished_text": "CASE k % 6 WHEN 0 THEN 'meublé' WHEN 1 THEN 'non meublé' END", "city": S_CITY,
    "postal_code": "CASE WHEN k % 7 <> 1 THEN '060' || lpad((k % 100)::VARCHAR, 2, '0') END", "images": "k || '-1.jpg|' || k || '-2.jpg'",
    "features": "nullif(array_to_string(list_filter([CASE WHEN k % 2 = 0 THEN 'Balcon' END, CASE WHEN k % 3 = 1 THEN 'Cave' END, CASE WHEN k % 5 = 2 THEN 'Vue mer' END], lambda x: x IS NOT NULL), '|'), '')",
}
ARIA_SQL = {f: v if f in ("ref", "url") else f"CASE WHEN k % 11 <> 0 THEN {v} END" for f, v in ARIA_SQL.items()}
_J = "CASE WHEN k % 9 <> 0 THEN {} END"
BLOCKS_SQL = NOTHING | {
    "ref": "k::VARCHAR", "url": "'https://blocks.test/location/appartement-nice,' || k", "title": f"CASE WHEN k % 5 = 0 THEN {_J.format(chr(39) + 'N ' + chr(39) + ' || k')} ELSE 'T ' || k END",
    "description": "CASE WHEN k % 5 <> 0 THEN 'Bel appart ' || k END", "price_text": _J.format("(400 + k % 900) || ' €'"), "charges_text": "CASE WHEN k % 6 = 0 THEN '30 €' END",
    "area_text": "(10 + k % 70) || ',5 m²'", "rooms_text": "CASE WHEN k % 9 = 0 OR k % 4 = 1 THEN (1 + k % 5)::VARCHAR ELSE (1 + k % 5) || ' pièces' END", "type_text": "'appartement'",
    "furnished_text": "CASE WHEN k % 8 < 3 THEN 'Meublé' END", "city": _J.format("'Nice'"), "postal_code": _J.format("'06' || lpad((k % 100)::VARCHAR, 3, '0')"), "phone": "'+33' || k",
    "images": _J.format("'https://img.test/' || k || '.jpg'"),
}
CARDS_SQL = NOTHING | {
    "ref": "k::VARCHAR", "url": "'/detail.htm'", "title": "'Appartement T' || (1 + k % 5)", "type_text": "'Appartement T' || (1 + k % 5)", "city": "'Nice'",
    "price_text": "CASE WHEN k % 10 <> 3 THEN (400 + k % 900) || '.00' END", "images": "CASE WHEN k % 5 <> 0 THEN 'https://img.test/' || k || '.jpg' END",
    "area_text": "CASE WHEN k % 2 = 0 THEN '4' || (k % 10) || ',5 m²' END", "rooms_text": "CASE WHEN k % 2 = 0 THEN (1 + k % 5)::VARCHAR END",
    "postal_code": "CASE WHEN k % 2 = 0 THEN '06' || lpad((k % 100)::VARCHAR, 3, '0') END", "description": "CASE WHEN k % 2 = 0 THEN 'Calme ' || k END",
}
_D = "CASE WHEN k % 3 <> 0 THEN {} END"
ROWS_SQL = NOTHING | {
    "ref": "'r' || k", "url": "'/o/r' || k", "title": "'Studio ' || k", "price_text": "(300 + k % 500) || ' €'", "area_text": "CASE WHEN k % 4 <> 0 THEN (12 + k % 30) || ' m²' END",
    "rooms_text": _D.format("(1 + k % 5)::VARCHAR"), "furnished_text": _D.format("CASE WHEN k % 2 = 0 THEN 'oui' ELSE 'non' END"), "city": _D.format("'Brest'"),
    "features": _D.format("'Cave|Balcon'"), "description": _D.format("'Lumineux ' || k"),
}


def _expected(site: str, fields: dict[str, str], key: str, source: str, sold: str = "false") -> str:
    warning = f"CASE WHEN {sold} THEN 'sold' WHEN {fields['price_text']} IS NULL THEN 'no price' END"
    return f"SELECT '{site}' AS site, {', '.join(f'{v} AS {f}' for f, v in fields.items())}, {warning} AS warning FROM (SELECT {key} AS k FROM {source}) t"


SITES_SQL = " UNION ALL ".join([
    _expected("aria", ARIA_SQL, "p_partkey", "part"),
    _expected("blocks", BLOCKS_SQL, "c_custkey", "customer"),
    _expected("cards", CARDS_SQL, "p_partkey", "part", "k % 17 = 2"),
    _expected("rows", ROWS_SQL, "s_suppkey", "supplier"),
])


def _columns(df):
    return df.select("site", *sites.FIELDS, sites.warning().alias("warning"))


@query(SITES_SQL)
def site_listings(spark, sf_dir):
    """SRC-18, SRC-19, SRC-20, SRC-22, SRC-23: three platform shapes and two sites of list and details, from rule rows."""
    found = Scratch(spark, "records").keep(sites.site_records(site_pages(spark, sf_dir), RULES))
    of = lambda site: found.filter(F.col("site") == site)
    whole = [of("aria"), of("blocks"), sites.with_details(of("cards"), of("specs")), sites.with_details(of("rows"), of("defs"))]
    out = _columns(whole[0])
    for w in whole[1:]:
        out = out.unionByName(_columns(w))
    return out


@query("SELECT site, count(*) AS listings, count(*) FILTER (warning IS NULL) AS whole, count(*) FILTER (warning = 'sold') AS sold, count(*) FILTER (warning = 'no price') AS no_price, count(area_text) AS with_area FROM (" + SITES_SQL + ") GROUP BY site")
def site_runs(spark, sf_dir):
    """SRC-22: what the runs of the sites gave."""
    n = lambda when: F.count(F.when(when, 1))
    return site_listings(spark, sf_dir).groupBy("site").agg(
        F.count(F.lit(1)).alias("listings"), n(F.col("warning").isNull()).alias("whole"), n(F.col("warning") == "sold").alias("sold"),
        n(F.col("warning") == "no price").alias("no_price"), F.count("area_text").alias("with_area"),
    )

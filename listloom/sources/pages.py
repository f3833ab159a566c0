"""Extractors over raw pages, mails and sitemaps, as DataFrame to DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listloom.functions.text import comparable

LD_SCHEMA = "`@type` string, name string, url string, price string, `@graph` array<struct<`@type`:string,name:string,url:string,price:string>>"


def titles(pages: DataFrame) -> DataFrame:
    return pages.select(
        "page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"),
    )


def links(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))


def texts(pages: DataFrame) -> DataFrame:
    """Scripts and styles go, tags become blanks, blanks collapse."""
    bare = F.regexp_replace("html", "(?s)<script.*?</script>|<style.*?</style>", " ")
    plain = F.regexp_replace(F.regexp_replace(bare, "<[^>]*>", " "), "[ \t\r\n]+", " ")
    return pages.select("page_id", F.trim(plain).alias("text"))


def lined_text(html) -> Column:
    """Text with block elements as line breaks."""
    broken = F.regexp_replace(html, "(?i)<br ?/?>|</?(p|div|li|tr|h[1-6]|ul|ol|table|section|article)[^>]*>", "\n")
    plain = F.regexp_replace(F.regexp_replace(broken, "<[^>]*>", ""), "[ \t]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, " ?\n ?", "\n"), "\n+", "\n"))


def url_parts(pages: DataFrame) -> DataFrame:
    return pages.select(
        "page_id", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"), F.regexp_extract("url", "^https?://[^/]+(/[^?#]*)", 1).alias("path")
    )


def json_ld(pages: DataFrame) -> DataFrame:
    """(page_id, type, name, url, price) of every JSON-LD node, ``@graph`` flattened; malformed blocks give nothing."""
    blocks = F.regexp_extract_all("html", F.lit('(?s)<script[^>]*application/ld\\+json[^>]*>(.*?)</script>'), F.lit(1))
    node = F.from_json("block", LD_SCHEMA)
    nodes = pages.select("page_id", F.explode(blocks).alias("block")).select("page_id", node.alias("n"))
    own = F.struct(*[F.col(f"n.`{c}`").alias(c) for c in ("@type", "name", "url", "price")])
    each = nodes.select("page_id", F.explode(F.when(F.col("n.`@graph`").isNotNull(), F.col("n.`@graph`")).otherwise(F.array(own))).alias("x"))
    return each.select("page_id", F.col("x.`@type`").alias("type"), "x.name", "x.url", "x.price").filter("type is not null")


def sitemap(xml: DataFrame, column: str = "xml") -> DataFrame:
    """(loc, lastmod) of every url entry."""
    entries = F.regexp_extract_all(column, F.lit("(?s)<url>(.*?)</url>"), F.lit(1))
    each = xml.select(F.explode(entries).alias("e"))
    pick = lambda tag: F.nullif(F.trim(F.regexp_extract("e", f"<{tag}>([^<]*)</{tag}>", 1)), F.lit(""))
    return each.select(pick("loc").alias("loc"), pick("lastmod").alias("lastmod")).filter("loc is not null")


API_SCHEMA = "ads array<struct<id:string,title:string,price:double,position:struct<lat:double,lon:double,radius:double>>>"


def api_listings(answers: DataFrame, column: str = "body", exact_metres: float = 100.0) -> DataFrame:
    """(id, title, price, lat, lon) of the ads in JSON answers, asked for by address or by body alike. A position counts
    where it is exact or blurred by at most ``exact_metres``; answers that cannot be read give nothing."""
    each = answers.select(F.explode(F.from_json(column, API_SCHEMA)["ads"]).alias("a"))
    sharp = F.coalesce(F.col("a.position.radius"), F.lit(0.0)) <= exact_metres
    return each.select(
        "a.id", "a.title", "a.price", F.when(sharp, F.col("a.position.lat")).alias("lat"), F.when(sharp, F.col("a.position.lon")).alias("lon")
    )


def inline_entries(pages: DataFrame, name: str, fields: tuple[str, ...]) -> DataFrame:
    """(page_id, fields as text) of the objects in a script's array literal ``name = [{...}, ...]``; values may be quoted."""
    array = F.regexp_extract("html", rf"(?s)\b{name}\s*=\s*\[(.*?)\]", 1)
    each = pages.select("page_id", F.explode(F.regexp_extract_all(array, F.lit(r"(?s)\{(.*?)\}"), F.lit(1))).alias("o"))
    value = lambda f: F.regexp_extract("o", rf"(?:^|[,\s]){f}\s*:\s*[\"']?([^,\"']*)", 1)
    return each.select("page_id", *[F.nullif(F.trim(value(f)), F.lit("")).alias(f) for f in fields])


def sitemap_index(xml: DataFrame, column: str = "xml") -> DataFrame:
    return xml.select(F.explode(F.regexp_extract_all(column, F.lit("(?s)<sitemap>.*?<loc>([^<]*)</loc>.*?</sitemap>"), F.lit(1))).alias("loc"))


def wanted_entries(entries: DataFrame, newest: str, places: list[str]) -> DataFrame:
    """Entries whose address names one of the places, of ``newest`` or later."""
    wanted = F.lit(False)
    for p in places:
        wanted = wanted | F.contains(comparable(F.col("loc")), F.lit(p))
    return entries.filter(wanted & (F.col("lastmod") >= newest))


def crawl_candidates(entries: DataFrame, known: DataFrame, newest: str, top: int, places: list[str]) -> tuple[DataFrame, DataFrame]:
    """(confirmed, to visit): entries of the places younger than ``newest``; known ones are confirmed, of the others the
    ``top`` latest are visited."""
    fresh = wanted_entries(entries, newest, places)
    confirmed = fresh.join(known, "loc", "left_semi")
    return confirmed, fresh.join(known, "loc", "left_anti").orderBy(F.col("lastmod").desc(), "loc").limit(top)


def unwrapped(link) -> Column:
    """The target of a tracking link: a query parameter that is an address, or a path part in base64url."""
    parameter = F.regexp_extract(link, "[?&](?:url|u|target|redirect)=([^&#]+)", 1)
    part = F.regexp_extract(link, "/(aHR0c[A-Za-z0-9_-]+)", 1)
    padded = F.rpad(F.translate(part, "-_", "+/"), (F.ceil(F.length(part) / 4) * 4).cast("int"), F.lit("="))
    decoded = F.when(part != "", F.try_to_binary(padded, F.lit("base64")).cast("string"))
    return F.coalesce(F.when(parameter != "", F.try_url_decode(parameter)), decoded, link)


def mail_cards(mails: DataFrame) -> DataFrame:
    """(mail_id, ref, url, text) of the anchors that name a price; the first card of a ref stays. ``ref`` is the address,
    or a hash of the text where the address is none."""
    anchors = F.regexp_extract_all("html", F.lit('(?s)<a [^>]*href="[^"]*"[^>]*>.*?</a>'), F.lit(0))
    each = mails.select("mail_id", F.posexplode(anchors).alias("at", "a"))
    url = unwrapped(F.regexp_extract("a", 'href="([^"]*)"', 1))
    words = F.trim(F.regexp_replace(F.regexp_replace("a", "<[^>]*>", " "), "\\s+", " "))
    cards = each.select("mail_id", "at", url.alias("url"), words.alias("text")).filter(F.col("text").rlike("[0-9] ?(€|eur)"))
    ref = F.when(F.col("url").rlike("^https?://"), F.regexp_replace("url", "[?#].*$", "")).otherwise(F.substring(F.sha2("text", 256), 1, 16))
    first = F.min_by(F.struct("url", "text"), F.struct("mail_id", "at"))
    return cards.withColumn("ref", ref).groupBy("ref").agg(first.alias("x"), F.min("mail_id").alias("mail_id")).select("mail_id", "ref", "x.url", "x.text")


def recipient_token(address) -> Column:
    """The account's token in a templated address."""
    return F.nullif(F.regexp_extract(address, "\\+([a-z0-9]{6,32})@", 1), F.lit(""))


def unknown_names(found: DataFrame, known: DataFrame) -> DataFrame:
    """Names whose squeezed form neither holds nor is held by a known one."""
    squeeze = lambda c: F.replace(comparable(F.col(c)), F.lit(" "), F.lit(""))
    names = found.select("name", squeeze("name").alias("s")).distinct()
    listed = known.select(squeeze("name").alias("k")).filter("k <> ''").distinct()
    # What is held stands in the holder from its first letters on: only names that share those are compared.
    start = lambda c: F.substring(c, 1, 3)

    def inner(c: str) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c)))
        return F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(*[F.substring(F.col(c), i, F.lit(n)) for n in (1, 2, 3)]))))

    holding = names.select("s", F.explode(inner("s")).alias("g")).join(listed.select("k", start("k").alias("g")), "g")
    held = listed.select("k", F.explode(inner("k")).alias("g")).join(names.select("s", start("s").alias("g")), "g")
    same = holding.filter(F.contains("s", F.col("k"))).select("s").union(held.filter(F.contains("k", F.col("s"))).select("s"))
    # An empty name is held by every known one.
    void = names.filter("s = ''").select("s").join(listed.limit(1).select(F.lit("").alias("s")), "s", "left_semi")
    return names.join(same.union(void).distinct(), "s", "left_anti").select("name")


def proxied_image(slices) -> Column:
    """The address behind a proxied image: slices of base64url joined and decoded; only http(s) is kept."""
    joined = F.array_join(slices, "")
    padded = F.rpad(F.translate(joined, "-_", "+/"), (F.ceil(F.length(joined) / 4) * 4).cast("int"), F.lit("="))
    got = F.try_to_binary(padded, F.lit("base64")).cast("string")
    return F.when(got.rlike("^https?://"), got)

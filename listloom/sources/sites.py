"""Sites as rule rows: three platform shapes and two sites of a list with details, all run by ``html.extract``.

The shapes are those that rental platforms use: names of their classes, attributes, elements and keys inside the rules are
fixed values. Addresses and pages, and the two sites of list and details, are ours.
A warning is a reason for which a record gives no listing or lacks its price.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listloom.session import Scratch

from .html import extract, nodes, rule, rules_table, step

FIELDS = (
    "ref", "url", "title", "description", "price_text", "charges_text", "area_text", "rooms_text", "type_text", "furnished_text", "city", "postal_code",
    "phone", "features", "images",
)


def _row(key: str) -> tuple[tuple, tuple]:
    """The last cell of a table row whose key is a class: behind two dashes in one template, a class of its own in another."""
    return step(attr="class", op="like", value=rf"table-aria__tr(--| (.* )?){key}( |$)"), step(attr="role", op="is", value="cell", nth=-1)


def aria_rules(site: str) -> list[tuple]:
    """A platform that keeps a listing's figures in one key-value table."""
    title = step(tag="title", nth=1)
    picture = step(tag="img", attr="data-src", op="holds", value="/images/biens/")
    return [
        rule(site, "ref", take="url", pattern=r"/(\d+)-[^/]*$"),
        rule(site, "url", take="url", pattern=r"^([^?#]+)"),
        rule(site, "title", step(tag="h1", nth=1)),
        rule(site, "title", title, pattern=r"^([^|]*)", rank=1),
        rule(site, "description", step(attr="class", op="holds", value="description__text")),
        rule(site, "price_text", *_row("loyer_cc"), form="{} CC"),
        rule(site, "price_text", title, pattern=r"([\d][\d .,]*€)", rank=1),
        rule(site, "charges_text", *_row("charges_mensuelles"), form="{} de charges"),
        rule(site, "area_text", title, pattern=r"(\d+(?:[.,]\d+)? ?m²)"),
        rule(site, "area_text", *_row("surface"), pattern=r"([\d.,]+)", form="{} m²", rank=1),
        rule(site, "area_text", *_row("surf_habitable"), pattern=r"([\d.,]+)", form="{} m²", rank=2),
        rule(site, "rooms_text", *_row("nbpieces"), form="{} pièces"),
        rule(site, "rooms_text", title, pattern=r"(\d+ pièces?)", rank=1),
        rule(site, "type_text", title, pattern=r"(?i)^location (\w+) "),
        rule(site, "furnished_text", *_row("meuble"), pattern="(?i)^(oui)$", form="meublé"),
        rule(site, "furnished_text", *_row("meuble"), form="non meublé", rank=1),
        rule(site, "city", title, pattern=r"(?i)^location \w+ ([^\d|]*[^\d| ])(?: +\d| *\|)"),
        rule(site, "postal_code", *_row("cp")),
        *[rule(site, "features", *_row(key), pattern="(?i)^(oui)$", form=name, many=True, rank=k) for k, (key, name) in enumerate((("balcon", "Balcon"), ("cave", "Cave")))],
        rule(site, "features", *_row("vue"), form="Vue {}", many=True, rank=2),
        # The same photo stands in two sizes; its file's name tells.
        rule(site, "images", picture, take="data-src", pattern=r"([^/?]+)(?:\?.*)?$", many=True),
    ]


def _criterion(label: str) -> tuple[tuple, tuple]:
    """Of a list of pairs, the value beside a label."""
    return step(tag="span", attr="class", op="word", value="textblock", says=rf"(?i)^{label} *:? *$"), step("after", tag="span", nth=1)


def block_rules(site: str) -> list[tuple]:
    """A platform whose structured data tells the figures, with pairs of labels and a block behind its heading."""
    data = step(tag="script", attr="type", op="is", value="application/ld+json", nth=1)
    block = step(attr="data-author", op="is", value="builder", says="(?i)^descriptif *$")
    return [
        rule(site, "ref", take="url", pattern=r"/location/[^/]*,(\d+)"),
        rule(site, "url", take="url", pattern=r"^([^?#]+)"),
        rule(site, "title", block, step("after", nth=1), step(tag="h2", nth=1)),
        rule(site, "title", data, take="raw", path="$.name", rank=1),
        rule(site, "description", block, step("after", nth=1), step(tag="p", nth=1)),
        rule(site, "price_text", data, take="raw", path="$.offers.price", form="{} €"),
        rule(site, "charges_text", *_criterion("charges?"), rank=1),
        rule(site, "area_text", *_criterion("surface")),
        rule(site, "area_text", data, take="raw", path="$.offers.itemOffered.floorSize.value", form="{} m²", rank=1),
        rule(site, "rooms_text", data, take="raw", path="$.offers.itemOffered.numberOfRooms", form="{} pièces"),
        rule(site, "rooms_text", *_criterion("pi[eè]ces?"), rank=1),
        rule(site, "type_text", *_criterion("type de bien")),
        rule(site, "type_text", take="url", pattern=r"/location/([a-z]+)", rank=1),
        rule(site, "furnished_text", *_criterion("ameublement")),
        rule(site, "city", data, take="raw", path="$.offers.itemOffered.address.addressLocality"),
        rule(site, "postal_code", data, take="raw", path="$.offers.itemOffered.address.postalCode"),
        rule(site, "phone", step(tag="a", attr="href", op="starts", value="tel:", nth=1), take="href", pattern="^tel:(.*)"),
        rule(site, "images", data, take="raw", path="$.image"),
    ]


def card_rules(site: str) -> list[tuple]:
    """A platform whose list pages are cards with the price in attributes; what is sold or for sale has no price here."""
    price = step(tag="costpermonth", attr="data-ope", op="is", value="2", nth=1)
    return [
        rule(site, "@record", step(attr="class", op="word", value="liste-bien-container")),
        rule(site, "ref", take="data-show-on-map"),
        rule(site, "ref", step(tag="a", attr="href", op="holds", value="detail.htm", nth=1), take="href", pattern=r"[?&]cle=(\d+)", rank=1),
        rule(site, "url", step(tag="a", attr="href", op="holds", value="detail.htm", nth=1), take="href", pattern=r"^([^?]*)"),
        rule(site, "title", step(tag="h2", nth=1)),
        rule(site, "type_text", step(tag="h2", nth=1)),
        rule(site, "city", step(tag="h3", nth=1), pattern=r"^(.*?)(?: - .*)?$"),
        rule(site, "price_text", price, take="data-price", pattern=r"^(\d+(?:[.,]\d+)?)"),
        rule(site, "sold", step(tag="li", attr="data-ribbon-prop", op="is", value="Vendu", nth=1), pattern="^(1)$"),
        rule(site, "images", step(tag="img", attr="data-src", op="like", value="^https?:(?!.*vide_liste)"), take="data-src", many=True),
    ]


def spec_rules(site: str) -> list[tuple]:
    """Details of the cards: figures named by a label inside their list entry."""

    def spec(label: str) -> tuple[tuple, tuple]:
        return step(attr="class", op="word", value="bien-specs-label", says=f"(?i){label}"), step("up", tag="li", nth=-1)

    return [
        rule(site, "ref", take="url", pattern=r"[?&]cle=(\d+)"),
        rule(site, "area_text", *spec("surface"), pattern=r"(\d.*)$"),
        rule(site, "rooms_text", *spec("pi[eè]ce"), pattern=r"(\d.*)$"),
        rule(site, "postal_code", step(tag="body", nth=1), pattern=r"\((\d{5})\)"),
        rule(site, "description", step(attr="itemprop", op="is", value="description", nth=1)),
    ]


def row_rules(site: str) -> list[tuple]:
    """A site whose list is a table: one row a listing, figures by column."""
    cell = lambda k: step("child", tag="td", nth=k)
    return [
        rule(site, "@record", step(tag="table", attr="id", op="is", value="offers", nth=1), step(tag="tr", attr="data-ref")),
        rule(site, "ref", take="data-ref"),
        rule(site, "url", cell(1), step(tag="a", attr="href", nth=1), take="href"),
        rule(site, "title", cell(1)),
        rule(site, "price_text", cell(2)),
        rule(site, "area_text", cell(3)),
    ]


def definition_rules(site: str) -> list[tuple]:
    """Its details: terms and definitions."""
    said = lambda term: (step(tag="dt", says=f"(?i)^{term}$"), step("after", tag="dd", nth=1))
    return [
        rule(site, "ref", take="url", pattern=r"/o/(\w+)"),
        rule(site, "rooms_text", *said("pièces")),
        rule(site, "furnished_text", *said("meublé")),
        rule(site, "city", *said("ville")),
        rule(site, "features", *said("atouts"), step(tag="li"), many=True),
        rule(site, "description", step(tag="section", attr="id", op="is", value="text", nth=1)),
    ]


def site_records(pages: DataFrame, rules: list[tuple]) -> DataFrame:
    """(page, site, rec, each of FIELDS, sold) of ``pages(page, site, url, html)``; all sites in one pass."""
    # Parsed once; every step of every rule joins it.
    table = Scratch(pages.sparkSession, "nodes").keep(nodes(pages, "page", "url", "site"))
    found = extract(table, rules_table(pages.sparkSession, rules))
    return found.select("page", "site", "rec", *[F.col("fields")[c].alias(c) for c in (*FIELDS, "sold")])


def with_details(cards: DataFrame, details: DataFrame) -> DataFrame:
    """Cards with what their details add: a field of the card stays, unknown ones come from the detail of the same ref.
    The first card of a ref stays, and so does the first detail."""
    first = lambda df: df.filter("ref is not null").groupBy("ref").agg(F.min_by(F.struct(*df.columns), F.struct("page", "rec")).alias("x")).select("x.*")
    own, more = first(cards), first(details).withColumnsRenamed({c: f"d_{c}" for c in FIELDS}).drop("page", "site", "rec", "sold")
    joined = own.join(more, own["ref"] == more["d_ref"], "left")
    return joined.select("page", "site", "rec", *[F.coalesce(c, f"d_{c}").alias(c) for c in FIELDS], "sold")


def warning() -> Column:
    """Why a record is no listing, or what a listing lacks."""
    return (
        F.when(F.col("ref").isNull(), "no reference")
        .when(F.col("sold") == "1", "sold")
        .when(F.col("price_text").isNull(), "no price")
    )

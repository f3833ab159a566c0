"""Listing scalars beyond field parsing: places, formats, tokens, composition."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import parse
from .text import clean_text, commune_fold, comparable, js_round

#: Places and their spellings, in order of precedence. Own sample gazetteer; pass another one for real data.
GAZETTEER = [
    ("port", ("port", "vieux port", "le port")),
    ("vieille-ville", ("vieille ville", "centre historique")),
    ("gare", ("gare", "quartier gare")),
    ("collines", ("collines", "les collines")),
]
NEGATIVE = ("proche", "proche de", "pres de", "pres du", "a cote de", "vers", "non loin de")


def canonical_district(text: Column, gazetteer=GAZETTEER) -> Column:
    """The first entry of which a spelling stands in the text, unless only as something nearby."""
    folded = F.concat(F.lit(" "), comparable(text), F.lit(" "))
    near = "|".join(NEGATIVE)
    out = None
    for slug, spellings in gazetteer:
        words = "|".join(sorted(spellings, key=len, reverse=True))
        own = F.regexp_replace(folded, rf" ({near})( la| le| les)? ({words}) ", " ").rlike(rf" ({words}) ")
        out = F.when(own, slug) if out is None else out.when(own, slug)
    return out


#: Communes by folded name. Own sample list.
COMMUNES = ("aix en provence", "saint denis", "la rochelle", "arles", "brest", "dijon")
SMALL_WORDS = ("de", "du", "des", "la", "le", "les", "en", "sur", "sous", "et", "d", "l")


def split_commune(text: Column, communes=COMMUNES) -> Column:
    """struct(commune, rest): the longest known commune at the start of a text, and what follows."""
    folded = commune_fold(text)
    hits = F.array(*[F.when(folded.rlike(f"^{c}( |$)"), F.struct(F.lit(len(c)).alias("n"), F.lit(c).alias("c"))) for c in communes])
    best = F.array_max(F.array_compact(hits))
    return F.struct(best["c"].alias("commune"), F.trim(F.substring(folded, best["n"] + 1, 1000)).alias("rest"))


def title_case(text: Column) -> Column:
    """Capitals at word starts; small words stay small unless they come first."""
    words = F.split(F.lower(F.trim(text)), " ")
    small = F.array(*[F.lit(w) for w in SMALL_WORDS])
    parts = F.transform(words, lambda w, i: F.when((i > 0) & F.array_contains(small, w), w).otherwise(F.array_join(F.transform(F.split(w, "-"), F.initcap), "-")))
    return F.array_join(parts, " ")


def format_location(address: Column, district: Column, postal_code: Column, city: Column) -> Column:
    """Known parts: the address (else the district), then postal code and city."""
    return F.nullif(F.concat_ws(", ", F.coalesce(address, title_case(district)), F.nullif(F.concat_ws(" ", postal_code, title_case(city)), F.lit(""))), F.lit(""))


def format_price(price: Column, included: Column) -> Column:
    amount = F.translate(F.format_number(js_round(price).cast("double"), 0), ",", " ")
    return F.when(price.isNotNull(), F.concat(amount, F.lit(" €"), F.when(included, " CC").when(~included, " HC").otherwise("")))


def format_area(area: Column) -> Column:
    return F.concat(F.regexp_replace(F.round(area, 1).cast("string"), "\\.0$", ""), F.lit(" m²"))


def format_age(seconds: Column) -> Column:
    minutes, hours, days = (F.floor(seconds / k).cast("string") for k in (60, 3600, 86400))
    return F.when(seconds < 60, "now").when(seconds < 3600, F.concat(minutes, F.lit(" min"))).when(seconds < 86400, F.concat(hours, F.lit(" h"))).otherwise(F.concat(days, F.lit(" d")))


def format_phone(phone: Column) -> Column:
    """+33612345678 as 06 12 34 56 78."""
    national = F.concat(F.lit("0"), F.substring(phone, 4, 9))
    return F.when(phone.rlike("^\\+33[0-9]{9}$"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.substring(national, i * 2 + 1, F.lit(2))), " ")).otherwise(phone)


def image_identity(url: Column) -> Column:
    """Host and path; queries and fragments do not tell images apart."""
    return F.nullif(F.concat(F.lower(F.regexp_extract(url, "^https?://([^/?#]+)", 1)), F.regexp_extract(url, "^https?://[^/?#]+([^?#]*)", 1)), F.lit(""))


def portal_label(url: Column, hosts: dict[str, str]) -> Column:
    host = F.regexp_extract(url, "^https?://([^/?#:]+)", 1)
    out = F.lit(None).cast("string")
    for suffix, label in hosts.items():
        out = F.when((host == suffix) | host.endswith(f".{suffix}"), label).otherwise(out)
    return out


def addresses_in(header: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(header, F.lit("[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+"), F.lit(0)), F.lower))


def occurrence_matching(occurrences: Column, email: Column) -> Column:
    """The nested occurrence whose host is in the domain of the address, else the first."""
    domain = F.regexp_extract(email, "@(.+)$", 1)
    own = F.filter(occurrences, lambda o: (domain != "") & F.contains(F.regexp_extract(o["url"], "^https?://([^/?#]+)", 1), domain))
    return F.coalesce(F.try_element_at(own, F.lit(1)), F.try_element_at(occurrences, F.lit(1)))


def most_recent(a: Column, b: Column) -> Column:
    """The later of two days as text; what cannot be read does not count."""
    return F.greatest(F.try_to_date(a), F.try_to_date(b))


def charges_from_mentions(text: Column) -> Column:
    folded = comparable(text)
    got = F.regexp_extract(folded, "(?:provision|forfait)(?: mensuelle?| mensuel)?(?: pour| sur| de)?(?: les)? charges[a-z ]{0,30} ([0-9]{1,4})(?: |$)", 1)
    return parse.bounded(F.nullif(got, F.lit("")).try_cast("double"), 1, 2000)


def next_weekday_arrival(today: Column, hour: int = 9) -> Column:
    """The next Monday to Friday after a day, at an hour."""
    step = F.when(F.dayofweek(today) == 6, 3).when(F.dayofweek(today) == 7, 2).otherwise(1)
    return F.timestamp_seconds(F.unix_timestamp(F.date_add(today, step).cast("timestamp")) + hour * 3600)


def journey_minutes(durations: Column) -> Column:
    """The shortest of several journeys in seconds, in rounded minutes."""
    return js_round(F.array_min(durations) / 60).cast("int")


def merged_pages(known: Column, fresh: Column) -> Column:
    """Refs of a remembered page where the fetch said that nothing changed."""
    return F.coalesce(fresh, F.from_json(known, "array<string>"))


def short_reference(ref: Column) -> Column:
    return F.nullif(F.upper(F.regexp_replace(ref, "[^A-Za-z0-9]", "")), F.lit(""))


MAX_TOKEN = 4000


def search_token(fields: Column) -> Column:
    """A saved search as base64url of its JSON, without padding; null when too long."""
    token = F.regexp_replace(F.translate(F.base64(F.encode(F.to_json(fields), "UTF-8")), "+/\r\n", "-_"), "=+$", "")
    return F.when(F.length(token) <= MAX_TOKEN, token)


def read_search_token(token: Column, schema: str) -> Column:
    padded = F.rpad(F.translate(token, "-_", "+/"), (F.ceil(F.length(token) / 4) * 4).cast("int"), F.lit("="))
    raw = F.try_to_binary(F.when(F.length(token) <= MAX_TOKEN, padded), F.lit("base64"))
    return F.from_json(raw.cast("string"), schema)


def search_token_of(criteria: dict) -> str:
    """Driver side twin of ``search_token``."""
    return base64.urlsafe_b64encode(json.dumps(criteria, separators=(",", ":")).encode()).decode().rstrip("=")


def describe_search(c) -> str:
    parts = [f"up to {c.max_price:g}" if c.max_price else "", f"from {c.min_area:g} m2" if c.min_area else "", c.city or ""]
    return ", ".join(p for p in parts if p) or "everything"


def message(profile_name: Column, title: Column, visit: Column) -> Column:
    return F.concat_ws(" ", F.concat(F.lit("About: "), clean_text(title), F.lit(".")), F.concat(F.lit("Free for a visit "), visit, F.lit(".")), F.concat(F.lit("Regards, "), profile_name))


def channel(email: Column, form: Column, phone: Column) -> Column:
    return F.when(email.isNotNull(), "email").when(form.isNotNull(), "form").when(phone.isNotNull(), "phone").otherwise("manual")

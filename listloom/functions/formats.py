"""How values are shown: times, rooms, sources, addresses and districts. An unknown is shown as ``UNKNOWN``.

Words of the interface are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "inconnu"
MONTHS = ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre")
SHORT_MONTHS = ("janv.", "févr.", "mars", "avr.", "mai", "juin", "juil.", "août", "sept.", "oct.", "nov.", "déc.")
WEEKDAYS = ("dimanche", "lundi", "mardi", "mercredi", "jeudi", "vendredi", "samedi")
#: Words that stay small inside an address.
PARTICLES = ("de", "du", "des", "la", "le", "les", "l", "d", "et", "au", "aux", "sur", "sous", "en", "à", "a", "bis", "ter")
#: Short words of addresses and what they stand for.
SHORT_WORDS = {
    "bd": "boulevard", "bld": "boulevard", "blvd": "boulevard", "av": "avenue", "ave": "avenue", "imp": "impasse", "chem": "chemin",
    "ch": "chemin", "prom": "promenade", "pl": "place", "rte": "route", "sq": "square", "all": "allée", "crs": "cours", "res": "résidence",
}


def _or_unknown(c: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(UNKNOWN))


def _word(words: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), at)


def format_rooms(rooms: Column) -> Column:
    return F.when(rooms.isNull(), UNKNOWN).when(rooms == 1, "1 pièce").otherwise(F.concat(rooms.cast("string"), F.lit(" pièces")))


def format_duration(minutes: Column) -> Column:
    return F.concat(minutes.cast("string"), F.lit(" min"))


def format_availability(day: Column, now: Column) -> Column:
    """Free now when within three days; the year only where it is another one; null when unknown."""
    shown = F.concat_ws(" ", F.lit("Dispo"), F.dayofmonth(day).cast("string"), _word(SHORT_MONTHS, F.month(day)), F.when(F.year(day) != F.year(now), F.year(day).cast("string")))
    soon = F.unix_micros(day.cast("timestamp")) <= F.unix_micros(now.cast("timestamp")) + 3 * 86_400_000_000
    return F.when(soon, "Dispo maintenant").when(day.isNotNull(), shown)


def format_day(at: Column, now: Column) -> Column:
    """Today, yesterday, else weekday, day and month."""
    day, today = F.to_date(at), F.to_date(now)
    named = F.concat_ws(" ", _word(WEEKDAYS, F.dayofweek(day)), F.dayofmonth(day).cast("string"), _word(MONTHS, F.month(day)))
    return F.when(day == today, "Aujourd'hui").when(day == F.date_sub(today, 1), "Hier").when(day.isNotNull(), named)


def format_time(at: Column) -> Column:
    return F.date_format(at, "HH:mm")


def format_source_name(source_id: Column, names: dict[str, str]) -> Column:
    """The known name, else the id's parts with capitals."""
    known = F.coalesce(*[F.when(source_id == k, F.lit(v)) for k, v in names.items()], F.lit(None).cast("string"))
    parts = F.transform(F.split(source_id, "[-_]"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20)))
    return F.coalesce(known, F.array_join(parts, " "))


def tel_link(phone: Column) -> Column:
    return F.concat(F.lit("tel:"), F.regexp_replace(phone, "[^0-9+]", ""))


def _capital(word: Column, first: Column) -> Column:
    """One part of an address: numbers and particles small, Roman numerals large, elided articles apart."""
    low = F.lower(word)
    elided = low.rlike("^[ld]['’].")
    head = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))
    return (
        F.when(low.rlike("^[0-9]"), low).when(low.rlike("^[ivx]{1,4}$"), F.upper(word))
        .when(elided, F.concat(F.substring(low, 1, 1), F.lit("’"), head(F.substring(low, 3, 1 << 20))))
        .when(~first & low.isin(*PARTICLES), low).otherwise(head(low))
    )


def _capitals(words: Column) -> Column:
    """Capitals for the words of an address; the first word of letters that is no particle is its first."""
    begins = F.transform(words, lambda w: F.lower(w).rlike("[a-zà-ÿ]") & ~F.lower(w).isin(*PARTICLES))
    first = F.array_position(begins, F.lit(True)) - 1
    shown = F.transform(words, lambda w, i: F.array_join(F.transform(F.split(w, "-"), lambda p, k: _capital(p, (i == first) & (k == 0))), "-"))
    return F.array_join(shown, " ")


def format_address(address: Column) -> Column:
    """The street alone: postal code and what follows go, ranges are closed up, short words are written out."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(address), r"\s+", " "), r"[\s,]+[0-9]{5}\b.*$", "")
    closed = F.trim(F.regexp_replace(F.regexp_replace(bare, r"([0-9]) ?- ?([0-9])", "$1-$2"), r",\s*$", ""))
    full = F.create_map(*[F.lit(x) for pair in SHORT_WORDS.items() for x in pair])
    words = F.transform(F.split(closed, " "), lambda w: F.coalesce(F.try_element_at(full, F.regexp_replace(F.lower(w), r"\.$", "")), w))
    return _or_unknown(_capitals(words))


def format_district(district: Column) -> Column:
    """Marks at the ends go."""
    bare = F.regexp_replace(F.regexp_replace(district, r"^[\s–—•-]+|[\s–—•-]+$", ""), r"\s+", " ")
    return _or_unknown(_capitals(F.split(bare, " ")))

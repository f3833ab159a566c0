"""Text folding and number scalars as Column expressions."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accented Latin letters and their plain forms; ligatures stay as they are. Fixed values.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
#: Named entities that are decoded. Fixed values.
ENTITIES = {
    "&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&eacute;": "é", "&egrave;": "è",
    "&agrave;": "à", "&ccedil;": "ç", "&euro;": "€", "&rsquo;": "’", "&middot;": "·", "&copy;": "©", "&amp;": "&",
}
STOP_WORDS = ("the", "and", "for", "with", "les", "des", "une", "dans", "pour", "avec", "sur", "und", "der", "die", "que", "los", "del")


def decode_entities(text: Column) -> Column:
    """Named entities of a fixed subset, and decimal references of ASCII letters and marks (``&`` comes last)."""
    out = text
    for code in (33, 39, 45, 124):
        out = F.replace(out, F.lit(f"&#{code};"), F.lit(chr(code)))
    for name, value in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(value))
    return out


def clean_text(text: Column) -> Column:
    """Entities decoded, exotic blanks made plain, white space collapsed, ends trimmed."""
    plain = F.translate(decode_entities(text), "   \t\n\r", " " * 6)
    return F.trim(F.regexp_replace(plain, " +", " "))


def clean_multiline(text: Column) -> Column:
    """As ``clean_text`` line by line; at most one empty line in a row."""
    plain = F.translate(decode_entities(text), "   \t\r", " " * 5)
    lines = F.regexp_replace(F.regexp_replace(plain, " +", " "), " ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(lines, "\n{3,}", "\n\n"), "^[ \n]+|[ \n]+$", "")


def search_fold(text: Column) -> Column:
    """Lower case without accents; marks stay."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


class Folded(NamedTuple):
    """A text with its folded forms, which are columns already; parsers take it in a text's place and fold nothing again."""

    text: Column
    marks: Column
    words: Column


def with_folds(df: DataFrame, *names: str) -> tuple[DataFrame, dict[str, Folded]]:
    """``df`` with the folded forms of its text columns as columns of their own, a projection each: what many parsers read
    is then computed once a row."""
    marked = df.withColumns({f"{n}#marks": search_fold(clean_text(F.col(n))) for n in names})
    out = marked.withColumns({f"{n}#words": _words(F.col(f"{n}#marks")) for n in names})
    return out, {n: Folded(F.col(n), F.col(f"{n}#marks"), F.col(f"{n}#words")) for n in names}


def plain(text: Column | Folded) -> Column:
    return text.text if isinstance(text, Folded) else text


def marks(text: Column | Folded) -> Column:
    """Cleaned and in lower case without accents; marks stay."""
    return text.marks if isinstance(text, Folded) else search_fold(clean_text(text))


def _words(marked: Column) -> Column:
    return F.trim(F.regexp_replace(marked, "[^a-z0-9]+", " "))


def comparable(text: Column | Folded) -> Column:
    """Cleaned and folded; everything but a-z and digits becomes single blanks."""
    return text.words if isinstance(text, Folded) else _words(marks(text))


def once(value: Column, use) -> Column:
    """``use(value)``, the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def district_fold(text: Column) -> Column:
    """As ``comparable``, entities left alone."""
    return F.trim(F.regexp_replace(search_fold(text), "[^a-z0-9]+", " "))


def commune_fold(text: Column) -> Column:
    """Hyphens and apostrophes become blanks, then lower case without accents."""
    return F.trim(F.regexp_replace(search_fold(F.translate(text, "-'’", "   ")), " +", " "))


#: Street words and their short forms. Fixed values.
STREET_WORDS = {"av": "avenue", "ave": "avenue", "bd": "boulevard", "bld": "boulevard", "pl": "place", "imp": "impasse", "ch": "chemin", "rte": "route"}


def comparable_address(text: Column) -> Column:
    padded = F.concat(F.lit(" "), comparable(text), F.lit(" "))
    for short, full in STREET_WORDS.items():
        padded = F.replace(padded, F.lit(f" {short} "), F.lit(f" {full} "))
    return F.trim(padded)


def slugify(text: Column) -> Column:
    return F.replace(comparable(text), F.lit(" "), F.lit("-"))


def tokenize(text: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Distinct folded words of more than two letters that are no stop words, in order of appearance."""
    words = F.split(comparable(text), " ")
    stops = F.array(*[F.lit(w) for w in stop])
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(stops, w)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two distinct token arrays; 0 when either is empty or unknown."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.least(F.size(a), F.size(b)) > 0, both / F.size(F.array_union(a, b))).otherwise(0.0)


def js_round(x: Column) -> Column:
    """Half up, also below zero."""
    return F.floor(x + 0.5)


def clamp_score(x: Column) -> Column:
    known = F.when(x.isNull() | F.isnan(x), 0.0).otherwise(x)
    return F.greatest(F.lit(0), F.least(F.lit(100), js_round(known))).cast("int")


def parse_number(text: Column) -> Column:
    """A number as French or English text writes it.

    Blanks part thousands. With both a comma and a dot, the later one is the decimal mark. One mark alone is a decimal
    mark unless exactly three digits follow it or it occurs again: then it parts thousands.
    """
    raw = F.regexp_extract(text, r"-?[0-9][0-9 .,  ]*", 0)
    digits = F.regexp_replace(F.regexp_replace(raw, "[   ]", ""), "[.,]+$", "")
    both = F.contains(digits, F.lit(",")) & F.contains(digits, F.lit("."))
    comma_last = F.length(F.substring_index(digits, ",", -1)) < F.length(F.substring_index(digits, ".", -1))
    mixed = F.when(
        comma_last, F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    ).otherwise(F.replace(digits, F.lit(","), F.lit("")))
    one = F.translate(digits, ",", ".")
    parted = one.rlike(r"^-?[0-9]{1,3}(\.[0-9]{3})+$")
    single = F.when(parted, F.replace(one, F.lit("."), F.lit(""))).otherwise(one)
    return F.when(both, mixed).otherwise(single).try_cast("double")


def extract_number(text: Column, low: float, high: float) -> Column:
    """The first number of a text within bounds, else null."""
    found = F.regexp_extract_all(text, F.lit(r"([0-9]+(?:[.,][0-9]+)?)"), F.lit(1))
    values = F.transform(found, lambda x: F.translate(x, ",", ".").try_cast("double"))
    return F.try_element_at(F.filter(values, lambda v: (v >= low) & (v <= high)), F.lit(1))


def all_terms(haystack: Column, query: str) -> Column:
    """Every blank-separated term of the query is a substring of the folded text; an empty query matches all."""
    terms = [t for t in query.split(" ") if t]
    return reduce(lambda a, t: a & F.contains(haystack, search_fold(F.lit(t))), terms, F.lit(True))


def redact(text: Column) -> Column:
    """Secrets in log text: e-mail addresses, bearer tokens and values of telling keys."""
    out = F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "[mail]")
    out = F.regexp_replace(out, r"(?i)bearer [A-Za-z0-9._-]+", "[token]")
    return F.regexp_replace(out, r"(?i)(password|secret|token|api_key)([=:] ?)[^ ,;]+", "$1$2[hidden]")

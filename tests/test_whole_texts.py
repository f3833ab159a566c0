"""Folds and cleaning of whole texts, against brute force."""

import re

from listloom import catalogue
from listloom.functions.text import ACCENTED, ENTITIES, PLAIN

TEXTS = [
    (1, "Crème brûlée & thé, " * 20 + "l'École-Neuve’s FIN"),
    (2, "a&nbsp;b &amp;lt; c&#39;d &eacute;t&eacute; &&& x   \t\r\n y"),
    (3, "&&&"),
    (4, ""),
    (5, "plain " * 30 + "&euro;&middot;&#33;&#45;&#124;&copy;"),
]


def folded(t):
    return t.lower().translate(str.maketrans(ACCENTED, PLAIN))


def cleaned(t):
    for code in (33, 39, 45, 124):
        t = t.replace(f"&#{code};", chr(code))
    for name, value in ENTITIES.items():
        t = t.replace(name, value)
    return re.sub("[   \t\r\n ]+", " ", t).strip(" ")


def slug(t):
    return "-".join(re.findall("[a-z0-9]+", folded(t)))


def commune(t):
    return re.sub(" +", " ", folded(re.sub("[-'’]", " ", t))).strip(" ")


def test_whole_texts(spark, tmp_path):
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name, column, want in (("text_folds", "slug", slug), ("commune_folds", "commune", commune), ("clean_texts", "cleaned", cleaned)):
        got = catalogue.queries()[name](spark, str(tmp_path)).collect()
        assert {r["doc_id"]: r[column] for r in got} == {i: want(t) for i, t in TEXTS}, name

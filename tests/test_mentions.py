"""Mentions of features against windows of 42 characters either side."""

import itertools
import re

from pyspark.sql import functions as F

from listloom import catalogue
from listloom.functions import parse
from listloom.functions.text import comparable
from listloom.plans.mentions import AFTER, BEFORE, placed

DENIED = r"\b(sans|non|pas de|pas du|pas d|aucun|aucune|ni) ([a-z0-9]+ )?$"
NEAR = (
    r"\b(a proximite|a proximite immediate|a deux pas|proche|proches|pres|face|a cote|vue|vue imprenable|donnant sur|acces|non loin|situe pres|situee pres)"
    r"( (de|du|des|d|a|au|aux|sur))? ((le|la|les|l|du|des|au|aux) )?$"
)
BEHIND = (
    r"^ (a proximite|a deux pas|dans le quartier|a \d+ ?m(etres)?|public|publique|publics|publiques|municipale?|collectif|collective|communs?|communes?"
    r"|de la residence|de la ville|d enfants|botanique|exotique)\b"
)


def own(folded, words):
    for m in re.finditer(rf"\b({'|'.join(sorted(words, key=len, reverse=True))})\b", folded):
        before, after = folded[max(0, m.start() - 42) : m.start()], folded[m.end() : m.end() + 42]
        if not re.search(DENIED, before) and not re.search(NEAR, before) and not re.search(BEHIND, after):
            return True
    return False


def expected(folded):
    mine = {f for f, words in parse.FEATURES.items() if own(folded, words)}
    named = {f for f, words in parse.FEATURES.items() if re.search(rf"\b({'|'.join(words)})\b", folded)}
    return mine, named - mine


def texts():
    for k, (b, w, a) in enumerate(itertools.product(BEFORE, ("jardin", "lave-vaisselle", "Balcons"), AFTER)):
        yield k, f"Appartement {b} {w} {a}. " + ("Parking" if k % 2 else "Proche parking, parking clos")
    yield 9_000, None
    yield 9_001, ""
    yield 9_002, "mot " * 200_000 + "sans ascenseur mais balcon balcon public"


def test_mentions_by_windows(spark):
    df = spark.createDataFrame(list(texts()), "id int, t string")
    held = F.array(*[F.lit(f) for f in parse.FEATURES])
    got = df.select("id", comparable(F.col("t")).alias("c"), parse.extract_features(F.col("t")).alias("own"), parse.stale_features(held, F.col("t")).alias("stale"))
    kinds = set()
    for r in got.collect():
        mine, stale = expected(r["c"] or "")
        assert ({f for f in r["own"] if not f.startswith("floor")}, set(r["stale"])) == (mine, stale), r
        kinds.add((bool(mine), bool(stale)))
    assert len(kinds) >= 3


def test_only_held_features_are_stale(spark):
    df = spark.createDataFrame([("sans balcon, sans cave", ["cellar", "lift"])], "t string, f array<string>")
    assert df.select(parse.stale_features(F.col("f"), F.col("t"))).first()[0] == ["cellar"]


def test_query_over_documents(spark, tmp_path):
    rows = [(k, t) for k, t in texts() if k % 7 == 0 or k >= 9_000]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    path = str(tmp_path)
    folded = {r[0]: r[1] for r in placed(spark.read.parquet(f"{path}/documents.parquet")).select("doc_id", comparable(F.col("t"))).collect()}
    out = catalogue.queries()["own_features"](spark, path).collect()
    assert len(out) == len(rows) == len(folded)
    for r in out:
        mine, stale = expected(folded[r["doc_id"]])
        assert (r["own"], r["stale"]) == (",".join(sorted(mine)), ",".join(sorted(stale))), folded[r["doc_id"]][:200]

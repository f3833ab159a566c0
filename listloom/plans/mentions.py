"""What a text says of features: whole texts with mentions set among their own words."""

from __future__ import annotations

from pyspark.sql import functions as F

from listloom.catalogue import query
from listloom.functions import parse
from listloom.functions.text import comparable
from listloom.sources.views import table

BEFORE = ("sans", "Avec", "pas de grand", "à deux pas du", "vue sur la", "ni", "Très beau", "", "proche de l'", "aucune")
AFTER = ("privatif", "public", "à 200 m", ", calme", "commune", "de la ville", "à proximité", "", "d'enfants", "neuf")


def placed(documents):
    """(doc_id, t): every whole text between two mentions, chosen by the id."""
    names = [w for words in parse.FEATURES.values() for w in words]

    def pick(words, k: int):
        return F.array(*[F.lit(w) for w in words])[F.pmod(F.xxhash64(F.lit(k), "doc_id"), F.lit(len(words))).cast("int")]

    said = [F.concat_ws(" ", pick(BEFORE, k), pick(names, k + 1), pick(AFTER, k + 2)) for k in (0, 3)]
    return documents.select("doc_id", F.concat_ws(" ", said[0], "text", said[1]).alias("t"))


@query()
def own_features(spark, sf_dir):
    """SCA-23, SCA-24: of every document with two mentions set around its text, the features of its own, and those of all
    features that are stale. Held against windows of 42 characters in the tests; SQL has no look-behind."""
    held = F.array(*[F.lit(f) for f in parse.FEATURES])
    folded = placed(table(spark, sf_dir, "documents")).select("doc_id", comparable(F.col("t")).alias("t"))
    found = folded.withColumn("own", parse.features_of(F.col("t"))).withColumn("stale", parse.stale_of(held, F.col("t"), F.col("own")))
    return found.select("doc_id", *[F.array_join(F.array_sort(c), ",").alias(c) for c in ("own", "stale")])

"""Whole texts and all pairs, against brute force."""

import os
import random

import pytest

from listloom import catalogue
from listloom.functions.text import ACCENTED, PLAIN, STOP_WORDS
from listloom.operators.similar import similar_sets

from oracle import DATA

needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def brute(sets, above):
    found, ids = {}, sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            union = len(sets[a] | sets[b])
            j = len(sets[a] & sets[b]) / union if union else 0.0
            if j > above:
                found[a, b] = round(j, 6)
    return found


def pairs_of(df):
    return {(r["left_id"], r["right_id"]): round(r["similarity"], 6) for r in df.collect()}


def test_large_groups_and_long_texts(spark, tmp_path):
    rng = random.Random(5)
    base = [f"word{i}" for i in range(120)]
    rows = [(k, " ".join(base)) for k in range(45)]
    for k in range(45, 90):
        rows.append((k, " ".join(rng.choice(base) if rng.random() < 0.7 else f"own{rng.randint(0, 99)}" for _ in range(rng.randint(1, 150)))))
    rows += [(90, ""), (91, "a b"), (92, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = pairs_of(catalogue.queries()["token_jaccard_pairs"](spark, str(tmp_path)))
    want = brute({i: {w for w in (t or "").split() if len(w) > 2} for i, t in rows}, 0.4)
    assert got == want
    assert sum(v == 1.0 for v in want.values()) >= 45 * 44 // 2 and len(rows[0][1]) > 500


def test_random_sets_at_the_threshold(spark):
    rng = random.Random(6)
    sets = {i: set(rng.sample(range(14), rng.randint(0, 10))) for i in range(120)}
    rows = spark.createDataFrame([(i, [f"w{x}" for x in s]) for i, s in sets.items()], "doc_id long, t array<string>")
    for above in (0.4, 0.5, 0.75):
        assert pairs_of(similar_sets(rows, above)) == brute(sets, above)


@needs_tables
def test_tokens_of_every_text(spark):
    fold = str.maketrans(ACCENTED, PLAIN)
    want = {}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect():
        plain = "".join(c if c.isascii() and c.isalnum() else " " for c in r["text"].lower().translate(fold))
        words = {w for w in plain.split() if len(w) > 2 and w not in STOP_WORDS}
        want[r["doc_id"]] = (len(words), min(words, default=None))
    got = catalogue.queries()["text_fold_tokens"](spark, DATA).collect()
    assert {r["doc_id"]: (r["n"], r["first"]) for r in got} == want and len(got) == len(want)

import hashlib
import random
import re

import pytest

from listloom.llm import exact_dedup as ed


def brute(rows):
    """(doc_id, keep_id, group_size, kept, sha) by reading the rule."""
    norm = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "")
    groups = {}
    for i, (doc, text) in enumerate(rows):
        groups.setdefault(norm(text), []).append((-len(text or ""), doc is None, doc or 0, i, doc))
    out = []
    for t, members in groups.items():
        best = min(members)
        sha = hashlib.sha256(t.encode()).hexdigest()
        out += [(m[4], best[4], len(members), m[3] == best[3], sha) for m in members]
    return out


def result(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return [tuple(r) for r in ed.exact_dedup(df, **options).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]


@pytest.mark.parametrize("counters", [2, 5, 1024])
def test_against_brute_force_with_hot_groups(spark, counters):
    rng = random.Random(5)
    texts = ["hot text", "hot  text", "hottext", "warm", "wa rm"] * 30 + [f"t{rng.randint(0, 60)} x" for _ in range(200)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    key = lambda r: (repr(r[0]), r)
    assert sorted(result(spark, rows, counters=counters), key=key) == sorted(brute(rows), key=key)


def test_every_frequent_digest_is_found(spark):
    digests = ["a"] * 400 + ["b"] * 300 + [f"d{i}" for i in range(300)]
    random.Random(1).shuffle(digests)
    df = spark.createDataFrame([(d,) for d in digests], "sha string").repartition(7)
    found = {r["sha"] for r in ed.frequent_digests(df, counters=4, fan_in=2).collect()}
    assert {"a", "b"} <= found and len(found) <= 4


def test_nulls_empty_ties_repeats(spark):
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (None, "z"), (7, "z"), (7, "z"), (6, "z "), (9, " z")]
    got = result(spark, rows)
    assert {r[:3] for r in got} == {r[:3] for r in brute(rows)}
    kept = [r for r in got if r[3]]
    assert {r[0] for r in kept} == {3, 6, 9} and len(kept) == 3
    same = result(spark, [(4, "q"), (4, "q")])
    assert sorted(r[3] for r in same) == [False, True]


def test_smallest_ids_and_ids_of_other_types(spark):
    low = -(1 << 63)
    assert {r[1] for r in result(spark, [(3, "q"), (low, "q"), (None, "q")])} == {low}
    df = spark.createDataFrame([("b", "x y"), ("a", "xy "), (None, "x y")], "doc_id string, text string")
    got = ed.exact_dedup(df)
    assert dict(got.dtypes)["keep_id"] == "string" and {r["keep_id"] for r in got.collect()} == {"a"}
    assert [r["doc_id"] for r in ed.drop_exact_copies(df).collect()] == ["a"]


def test_empty_table_and_long_text(spark):
    assert result(spark, []) == []
    long = "word " * 400_000
    assert [r[2] for r in result(spark, [(1, long), (2, long.replace(" ", "\n"))])] == [2, 2]


def test_dropping_keeps_columns_and_clashing_names(spark):
    rows = [(1, "a b", 5, "s", "k"), (2, "a  b", 6, "t", "l"), (3, "c", 7, "u", "m"), (3, "c", 8, "v", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, uid int, sha string, _key string")
    out = ed.drop_exact_copies(df)
    assert out.columns == df.columns
    got = out.collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(2, "a  b"), (3, "c")]

import random

import numpy as np
import pyarrow as pa
import pytest

from listloom.llm import ngram_join as nj

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in (text or "").translate(LOWER)).split(" ") if w]


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if sets[i] and 100 * k >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [d for j, (d, _) in enumerate(rows) if find(j) == find(i) and d is not None]
        out.append((doc, len(sets[i]), min(ids, default=None)))
    return sorted(out, key=repr)


def result(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = nj.ngram_components(df, **options).select("doc_id", "n_shingles", "component_id").collect()
    return sorted(map(tuple, got), key=repr)


def corpus(seed, clusters=12, copies=12):
    """Near copies on both sides of the threshold, shared passages, short texts and exact copies."""
    rng = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = []
    for c in range(clusters):
        base = [f"c{c}w{rng.randint(0, 400)}" for _ in range(rng.choice([4, 8, 60, 200]))]
        for _ in range(rng.randint(1, copies)):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 18))):
                t[rng.randrange(len(t))] = f"x{rng.randint(0, 9999)}"
            texts.append(" ".join(t) + (" " + passage if rng.random() < 0.3 else ""))
        texts.append(" ".join(base).upper())
    texts += ["", None, "  ", "a b", "A\tB", "a b c", "", *texts[:3]]
    rng.shuffle(texts)
    return [(100 + i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    assert result(spark, rows) == brute(rows)


def test_large_groups_go_by_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(nj, "GROUP_ROWS", 3)
    monkeypatch.setattr(nj, "BLOCK_ROWS", 4)
    monkeypatch.setattr(nj, "SLICE_COLUMNS", 50)
    monkeypatch.setattr(nj, "FLUSH", 500)
    rows = corpus(5, clusters=5, copies=40)
    assert result(spark, rows, block_bytes=2000) == brute(rows)


@pytest.mark.parametrize("hubs", [0, 2])
def test_a_large_group_of_near_copies_and_a_common_passage(spark, monkeypatch, hubs):
    """Hubs tie most of the group; the rest, and a chain of neighbours below the hub's threshold, go by pairs of blocks."""
    monkeypatch.setattr(nj, "GROUP_ROWS", 8)
    monkeypatch.setattr(nj, "BLOCK_ROWS", 4)
    monkeypatch.setattr(nj, "HUB_ROUNDS", hubs)
    rng = random.Random(8)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for i in range(60):
        t = list(base)
        t[rng.randrange(len(t))] = f"x{i}"
        rows.append((i, " ".join(t)))
    chain = [f"c{k}" for k in range(260)]
    rows += [(100 + i, " ".join(chain[4 * i : 4 * i + 100])) for i in range(40)]
    rows += [(200 + i, " ".join(base[:70] + [f"own{i}w{k}" for k in range(40)])) for i in range(30)]
    assert result(spark, rows, block_bytes=2000) == brute(rows)


def test_frequent_columns_are_set_aside(spark):
    passage = " ".join(f"p{k}" for k in range(12))
    rows = [(i, f"{passage} " + " ".join(f"w{i}x{k}" for k in range(5))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    documents = nj.document_rows(docs, block_bytes=1 << 20)
    found = nj.frequent_columns(documents, nj.column_blocks(docs, 1 << 20))
    common = set.intersection(*(set(x.tolist()) for x in nj.shingle_sets(pa.array([t for _, t in rows[:3]]))))
    assert set(found.tolist()) == common and len(found) == 8
    assert len(nj.frequent_columns(documents, nj.column_blocks(docs, 1 << 20), most=3)) == 3
    assert result(spark, rows) == brute(rows)


def test_sets_with_one_hash_stay_apart(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b d"), (3, "a b e"), (4, "a b f"), (5, "a b c")], "doc_id long, text string")
    documents, _ = nj.kept_rows(docs, class_bits=1)
    classes = {r["doc_id"]: r["klass"] for r in documents.collect()}
    assert classes[1] == classes[5] and len(set(classes.values())) == 4


def test_block_overlaps_and_forest():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, 90)).astype(np.uint64) for _ in range(20)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = nj.block_overlaps(sets)
    np.fill_diagonal(got, np.diag(want))
    assert got.tolist() == want
    links = np.zeros((5, 5), bool)
    for a, b in ((0, 1), (1, 2), (0, 2), (3, 4)):
        links[a, b] = links[b, a] = True
    assert len(nj.forest(links)) == 3


def test_shingles_of_odd_texts():
    texts = ["", " \t", "a b c", "a b c d e", "A  b\nc d e", "a b c d e f", "\x1ca b"]
    got = nj.shingle_sets(pa.array(texts))
    assert [len(s) for s in got] == [len(shingles(t)) for t in texts]
    assert got[3].tolist() == got[4].tolist()


def test_nulls_repeats_empty_and_dropping(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(None, text), (9, text + " z"), (4, text), (4, text), (7, "other words stand here now"), (8, None), (8, "")]
    assert result(spark, rows) == brute(rows)
    assert result(spark, []) == []
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, klass int, _key int")
    out = nj.drop_near_copies(df)
    assert out.columns == df.columns
    assert sorted(map(repr, (r["doc_id"] for r in out.collect()))) == ["4", "4", "7", "8", "8"]

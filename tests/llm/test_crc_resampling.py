import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from listloom.llm import crc_resampling as rs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, n=2):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + k]).encode() for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, percent=25, least=20, n=2, buckets=10_000):
    own = [(d, *features(t, n)) for d, t in docs]
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, lists in ((s, [f for *_, f in own]), (t, [features(x, n)[1] for x in target])):
        for f in lists:
            for x in f:
                counts[zlib.crc32(x) % buckets] += 1
    rows = []
    for d, words, f in own:
        gains = []
        for x in f:
            b = zlib.crc32(x) % buckets
            gains.append(math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))))
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    drawn = able[: percent * len(able) // 100]
    out = [(d, nf, w, sc, k + 1) for k, (d, _, nf, w, sc) in enumerate(drawn)]
    left = list(rows)
    for r in drawn:
        left.remove(r)
    return sorted([*out, *((d, nf, w, sc, None) for d, _, nf, w, sc in left)], key=repr)


def texts(seed, count=150):
    rng = random.Random(seed)
    words = ["the", "The", "of", "Ünder", "naïve", "漢字", "a1", "x" * 31, "x" * 32, "y" * 33, "z" * 200, "é" * 40, "7"]
    return [None, "", "--", "one"] + [
        "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "...", "_"]) for _ in range(rng.choice([5, 19, 20, 21, 60])))
        for _ in range(count)
    ]


def drawn(spark, rows, target, extra=(), **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in extra:
        docs = docs.withColumn(c, docs["doc_id"])
    other = spark.createDataFrame([(t,) for t in target], "text string")
    return sorted((tuple(r) for r in rs.resample(docs, other, **options).collect()), key=repr)


def test_against_brute_force(spark):
    rows = list(enumerate(texts(1)))
    target = texts(2, 20)
    assert drawn(spark, rows, target, extra=("score", "weight", "rank", "bucket", "id")) == brute(rows, target)
    assert drawn(spark, rows, target, n=3, percent=40, buckets=97) == brute(rows, target, n=3, percent=40, buckets=97)


def test_algebra_equals_zlib():
    rng = np.random.default_rng(3)
    firsts = [rng.bytes(k) for k in (0, 1, 5, 40)]
    seconds = [rng.bytes(k) for k in (0, 1, 33, 34, 35, 1000, 70_000)]
    pairs = [(a, b) for a in firsts for b in seconds]
    crc = np.array([[zlib.crc32(a), zlib.crc32(b)] for a, b in pairs], dtype=np.uint32)
    got = rs.combine(crc[:, 0], crc[:, 1], np.array([len(b) for _, b in pairs]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_pieces_of_a_long_text(n):
    text = "\n".join(t or "" for t in texts(4, 60)).encode()
    whole = sorted(zlib.crc32(f) for f in features(text.decode(), n)[1])
    for most in (7, 64, 1000):
        got = [c for _, crcs, _ in rs.text_runs([text], n, most) for c in crcs.tolist()]
        assert sorted(got) == whole


def test_one_enormous_word_ties_repeats_and_null_ids(spark):
    twenty = " ".join(f"w{k}" for k in range(20))
    rows = [(1, "q" * 5_000_000), (2, "word " * 900_000), *[(3, twenty)] * 9, *[(None, twenty)] * 3]
    assert drawn(spark, rows, [twenty]) == brute(rows, [twenty])


def test_empty_tables(spark):
    assert drawn(spark, [], ["a b"]) == []
    rows = list(enumerate(texts(5, 30)))
    assert drawn(spark, rows, []) == brute(rows, [])

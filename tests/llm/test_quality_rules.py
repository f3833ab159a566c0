import math
import random
import re
import zlib

import numpy as np

from listloom.llm import quality_rules as qr

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    counts = {}
    for r in runs:
        counts[r] = counts.get(r, 0) + 1
    again = {p for i, r in enumerate(runs) if counts[r] > 1 for p in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


def brute(docs, labels, buckets, most):
    grams = []
    for _, text in docs:
        w = WORD.findall((text or "").translate(LOWER))
        grams.append([zlib.crc32(g.encode()) % buckets for g in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]])
    ids = {d for d, *_ in labels if d is not None}
    good = [d for d in ids if all((q, t) == (1, 0) for e, q, t in labels if e == d)]
    good = sorted(good, key=lambda d: (zlib.crc32(str(d).encode()), d))[:most]
    fits = {d for d in good if zlib.crc32(str(d).encode()) % 2 == 0}
    s, t = np.zeros(buckets), np.zeros(buckets)
    for (d, _), g in zip(docs, grams):
        for b in g:
            s[b] += 1
            t[b] += d in fits
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in range(buckets)]
    scores = [sum(gain[b] for b in g) // len(g) if g else 0 for g in grams]
    held = sorted(x for (d, _), x in zip(docs, scores) if d in set(good) - fits)
    at = [held[max(0, math.ceil(len(held) * p / 100) - 1)] for p in (50, 5)] if held else None
    threshold = at[0] - qr.SPREAD * (at[0] - at[1]) if held else None
    out = []
    for (d, text), x in zip(docs, scores):
        figures = base(text)
        failed = figures[0] < 20 or 100 * figures[4] > 30 * figures[0]
        out.append((d, *figures, failed, not failed and (threshold is None or x >= threshold), x, threshold))
    return sorted(out, key=repr)


def texts(seed, count=150):
    rng = random.Random(seed)
    good = ["river", "Stone", "light", "Été", "of", "the", "moves"]
    bad = ["BUY", "now", "$$$", "click|here", "#1", "cheap"]
    out = [None, "", " \n\t ", "a\nb\n\na\nb\n", "w " * 30]
    for k in range(count):
        words = [rng.choice(bad if k % 5 == 0 else good) + (str(rng.randint(0, 40)) if rng.random() < 0.7 else "") for _ in range(rng.randint(5, 90))]
        if k % 7 == 0:
            words += words[:12] * rng.randint(1, 3)
        out.append("".join(w + rng.choice([" ", " ", "\n", "\t"]) for w in words))
    return out


def judged(spark, rows, labels, extra=(), **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in extra:
        docs = docs.withColumn(c, docs["doc_id"])
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return sorted((tuple(r) for r in qr.quality_rules(docs, marks, **options).collect()), key=repr)


def labels_of(rows):
    marks = [(d, int(d % 5 != 0), int(d % 11 == 0)) for d, _ in rows if d % 3]
    return [*marks, (None, 1, 0), (7, 1, None), (8, 0, 0), (8, 1, 0)]


def test_against_brute_force(spark):
    rows = list(enumerate(texts(2)))
    labels = labels_of(rows)
    got = judged(spark, rows, labels, extra=("words", "runs", "fits", "trusted_id", "score"), buckets=512)
    assert got == brute(rows, labels, 512, qr.TRUSTED)
    assert {r[7] for r in got if not r[6]} == {True, False}
    assert judged(spark, rows, labels, buckets=64, most_trusted=20) == brute(rows, labels, 64, 20)


def test_no_labels_empty_table_repeats_and_long_text(spark):
    assert judged(spark, [], [(1, 1, 0)]) == []
    long = " ".join(f"w{k}" for k in range(120_000))
    rows = [(1, long), (2, long + " " + long), (3, "a b"), (3, "a b"), (3, "other " * 40)]
    assert judged(spark, rows, []) == brute(rows, [], qr.BUCKETS, qr.TRUSTED)


def test_every_trusted_document_counts(spark):
    # More labels than any bounded list of trusted documents held; those of documents that are not there change nothing.
    rows = list(enumerate(texts(3)))
    labels = labels_of(rows)
    absent = [(d, 1, 0) for d in range(1_000_000, 1_060_000)]
    whole = brute(rows, labels, 512, len(labels))
    assert judged(spark, rows, [*labels, *absent], buckets=512) == whole
    # Too many ids for a broadcast: documents and ids meet in a shuffle; rows that repeat count as often as they are there.
    twice = [*rows, *rows[40:60], (None, "of the river")]
    assert judged(spark, twice, labels, buckets=512, most_broadcast=0) == brute(twice, labels, 512, len(labels))

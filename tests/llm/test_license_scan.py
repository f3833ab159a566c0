import math
import random
import re

from listloom.llm import license_scan as ls

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    w = WORD.findall((text or "").translate(LOWER))
    places, base = [], set()
    for phrase, label in ls.PHRASES.items():
        p = phrase.split(" ")
        at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    found, share = set(), 0.0
    for begin in range(0, max(0, len(w) - 1 - (ls.BLOCK - ls.STEP)) + 1, ls.STEP):
        block = set(w[begin : begin + ls.BLOCK])
        for label, t in ls.TEMPLATES:
            own = set(t.split(" "))
            if len(own & block) >= math.ceil(ls.THRESHOLD * len(own) - 1e-9):
                found.add(label)
                share = max(share, len(own & block) / len(own))
    first, last = (min(places), max(places)) if places else (None, None)
    score = 1.0 if base else share
    return (len(w), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(base | found)), score)


def scan(spark, texts, extra=()):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for c in extra:
        df = df.withColumn(c, df["doc_id"])
    return {r["doc_id"]: tuple(r)[1:] for r in ls.license_scan(df).collect()}


def texts():
    rng = random.Random(3)
    common = [f"w{i}" for i in range(30)] + ["the", "of", "License", "software", "free", "Éa", "ß"]
    out = [None, "", "...", "CC-BY", "cc  by cc BY-nc", "MIT License! Apache license; mit LICENSE", "gnu general public licenses"]
    for _ in range(120):
        words = [rng.choice(common) for _ in range(rng.choice([3, 40, 200]))]
        for _ in range(rng.randint(0, 2)):
            t = rng.choice(ls.TEMPLATES)[1].split(" ")
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(common)
            at = rng.randrange(len(words) + 1)
            words[at:at] = t
        out.append(rng.choice([" ", ", ", "\n"]).join(words))
    return out


def test_against_brute_force(spark):
    rows = texts()
    got = scan(spark, rows)
    assert got == {i: brute(t) for i, t in enumerate(rows)}
    assert sum(1 for r in got.values() if r[5] != r[4]) > 20


def test_empty_table_long_text_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ls.license_scan(df).count() == 0
    long = "filler text " * 50_000 + "released under the MIT license"
    got = scan(spark, [long, long], extra=("uid", "words", "labels", "known"))
    assert got[0] == got[1] == brute(long)

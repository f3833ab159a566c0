"""Quality and mixing: held-out accuracy, the moments that rates must meet, and odd tables."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from listloom.llm import mixing, quality, text_views

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def corpus(n=900, seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeiorstnl") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(30, 150))]
        good, toxic = int(rng.random() > 0.25), int(rng.random() < 0.15)
        if not good:
            words = rng.choice([[words[0]] * 60, [w.upper() + "!!" for w in words], [w + " |" for w in words]])
        if toxic:
            for _ in range(8):
                words[rng.randrange(len(words))] = rng.choice(["grumph", "snarl", "blight"])
        text = " ".join(words)
        rows.append((i, text, rng.choice(["en", "fr"]), f"s{rng.randint(0, 5)}", len(text)))
        labels.append((i, good, toxic))
    return rows, labels


def test_quality_on_held_out_rows(spark):
    rows, labels = corpus()
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels[:400], LABELS)
    report = []
    got = {r["doc_id"]: r for r in quality.quality_scores(docs, known, report=report).collect()}
    assert len(got) == len(rows) and report
    held = labels[400:]
    assert np.mean([got[i]["keep"] == bool(good) for i, good, _ in held]) > 0.97
    kept = {r["doc_id"] for r in quality.keep_good(docs, known).collect()}
    assert kept == {i for i, r in got.items() if r["keep"]}


def test_quality_of_odd_tables(spark):
    rows = [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "a " * 200_000, "en", "s", 5), (2, "b", "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("uid", F.lit(1)).withColumn("good", F.lit(2))
    none = spark.createDataFrame([], LABELS)
    assert [r["keep"] for r in quality.quality_scores(docs, none).collect()] == [True] * 4
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (2, None, 1), (77, 1, 0)], LABELS)
    assert quality.quality_scores(docs, labels).count() == 4
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.quality_scores(docs.limit(0), labels).count() == 0


def bounded_least_squares(p, tokens, wanted, most=np.inf, steps=200_000):
    """Plain projected gradient in the ordinary norm on the rates themselves, to the end."""
    share = tokens / tokens.sum()
    r = np.ones(len(p))
    a = (p * np.sqrt(share)[:, None]).T
    step = 1 / np.linalg.eigvalsh(a @ a.T).max()
    for _ in range(steps):
        e = (r * share) @ p - wanted
        new = np.clip(r - step * (p @ e), 0, most)
        if np.abs(new - r).max() < 1e-12:
            break
        r = new
    return (r * share) @ p


def shares_of(got):
    p = np.array([[r[f"p_{d}"] for d in mixing.DOMAINS] for r in got])
    rate, tokens = np.array([r["rate"] for r in got]), np.array([r["tokens"] for r in got], float)
    return p, rate, tokens, (rate * tokens) @ p / tokens.sum()


def test_rates_meet_the_targets(spark):
    rows, labels = corpus(700, 9)
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels[:400], LABELS)
    targets = {"low": 0.1, "high": 0.85, "toxic": 0.05}
    got = mixing.mix_rates(docs, known, targets).collect()
    p, rate, tokens, met = shares_of(got)
    assert (rate >= 0).all() and np.allclose(p.sum(axis=1), 1) and all(r["converged"] for r in got)
    assert np.allclose(met, [targets[d] for d in mixing.DOMAINS], atol=2e-4)
    truth = {i: 2 if t else g for i, g, t in labels}
    held = [k for k, x in enumerate(got) if x["doc_id"] >= 400]
    assert np.mean([p[k].argmax() == truth[got[k]["doc_id"]] for k in held]) > 0.93
    assert abs(sum(x["copies"] for x in got) - rate.sum()) < 40


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_rates_on_the_given_tables_in_the_ordinary_norm(spark):
    docs, known = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = mixing.mix_rates(docs, known).collect()
    p, rate, tokens, met = shares_of(got)
    wanted = np.array([mixing.TARGETS[d] for d in mixing.DOMAINS])
    assert np.abs(met - wanted).max() < 0.01 and got[0]["converged"] and got[0]["excess"] < 0.01
    assert rate.max() < 3 and (rate == 0).mean() < 0.1
    # The classifier sees each of its domains, toxic ones too.
    truth = {r["doc_id"]: r["domain"] for r in mixing.domain_labels(known).collect()}
    own = [k for k, r in enumerate(got) if r["doc_id"] in truth]
    assert np.mean([p[k].argmax() == truth[got[k]["doc_id"]] for k in own]) > 0.97


def test_targets_out_of_reach_are_met_as_near_as_brute_force(spark):
    rng = np.random.default_rng(5)
    raw = rng.dirichlet([6, 10, 4], 300)
    p, tokens = mixing.rounded(raw), rng.integers(1, 400, 300)
    assert np.allclose(p.sum(axis=1), 1) and np.abs(p - raw).max() <= 1 / mixing.LEVELS
    rows = spark.createDataFrame([(k, int(t), x.tolist()) for k, (t, x) in enumerate(zip(tokens, p))], "doc_id long, tokens long, p array<double>")
    for most, targets in ((4.0, {"low": 0.1, "high": 0.8, "toxic": 0.1}), (1.5, {"low": 0.02, "high": 0.96, "toxic": 0.02})):
        mixer = mixing.Mixer(None, np.ones(3) / 3, most=most)
        fit = mixing.fit_rates(rows, mixer, targets, iterations=400)
        brute = bounded_least_squares(p, tokens.astype(float), fit.wanted, most)
        assert fit.converged and fit.iterations < 400
        assert np.linalg.norm(fit.reached - fit.wanted) <= np.linalg.norm(brute - fit.wanted) + 3e-3
        assert np.allclose((mixer.rates(p) * tokens) @ p / tokens.sum(), fit.reached)
    short = mixing.fit_rates(rows, mixing.Mixer(None, np.ones(3) / 3), {"high": 1}, iterations=2)
    assert not short.converged and short.iterations == 2


def test_mixed_rows_follow_the_copies(spark):
    rows, labels = corpus(300, 4)
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    docs = docs.withColumn("_copies", F.lit("kept"))
    out = mixing.mixed(docs, known)
    assert out.columns == docs.columns
    counts = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    want = {r["doc_id"]: r["copies"] for r in mixing.mix_rates(docs, known).collect() if r["copies"]}
    assert counts == want


def test_mixing_of_odd_tables(spark):
    rows = [(1, None, None, None, None), (None, "a b", "en", "s", 0), (2, "c", "en", "s", 5), (2, "d e", "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("p", F.lit(1)).withColumn("tokens", F.lit("x"))
    none = spark.createDataFrame([], LABELS)
    assert {r["rate"] for r in mixing.mix_rates(docs, none, mixing.TARGETS).collect()}
    one = spark.createDataFrame([(1, 1, 0), (2, 1, None)], LABELS)
    got = mixing.mix_rates(docs, one).collect()
    assert len(got) == 4 and all(abs(r["rate"] - 1) < 1e-6 for r in got)
    assert mixing.mix_rates(docs.limit(0), one).count() == 0


def test_vocabulary_counts_words_and_starts():
    v = text_views.Vocabulary(["0:one", "0:two", "4:thre", "6:threef"])
    row, column, count = v.counts(text_views.split_words(pa.array(["one two two", "", "Threefold, (One) threads", "x"])))
    assert list(zip(row, column, count)) == [(0, 0, 1), (0, 1, 2), (2, 0, 1), (2, 2, 2), (2, 3, 1)]


def test_chosen_words_are_those_of_the_class(spark):
    rows = [(f"common word{i % 7} " + ("marker" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(60)]
    v = text_views.choose_words(spark.createDataFrame(rows, "text string, klass int"), 2, 5)
    assert v.names == ["0:marker", "4:mark", "6:marker"]


def test_one_round_of_co_training_against_brute_force(spark):
    rows, labels = corpus(500, 21)
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels[:200], LABELS)
    report = []
    options = dict(rounds=1, bound=10_000, pseudo=10_000)
    got = {r["doc_id"]: r for r in quality.quality_scores(docs, known, report=report, **options).collect()}
    # The same by hand: both views of all rows, no samples, no Spark.
    vocabulary = quality.content_vocabulary(docs, quality.labelled_keys(docs, quality.quality_marks(known)))
    keys = {r["doc_id"]: r["key"] for r in quality.features(docs, vocabulary).collect()}
    rows.sort(key=lambda r: keys[r[0]])
    texts = pa.array([r[1] for r in rows])
    split = text_views.split_words(texts)
    form = text_views.style(texts, split).astype(np.float32).astype(float)
    words = text_views.dense(len(rows), len(vocabulary), *vocabulary.counts(split))
    views = [quality.text_view(form, words), quality.page_view([r[3] for r in rows], [r[2] for r in rows], np.array([r[4] for r in rows]), form)]
    good = np.array([labels[r[0]][1] if r[0] < 200 else -1 for r in rows])
    held = np.array([xxhash.xxh32_intdigest(str(keys[r[0]])) % 10 < 3 for r in rows])
    train, pool, test = (good >= 0) & ~held, good < 0, (good >= 0) & held
    odds = lambda m, x: np.clip(m.scores(x)[:, 1] - m.scores(x)[:, 0], -30, 30)
    size = [((good == k) & (good >= 0)).sum() / max(1, (good == k).sum()) for k in (0, 1)]
    first = [text_views.Softmax(2, x.shape[1]).fit(x[train], good[train], np.array(size)[good[train]]) for x in views]
    models = []
    for pupil in (0, 1):
        says = quality._sigmoid(odds(first[1 - pupil], views[1 - pupil][pool]))
        sure = (says >= quality.CONFIDENT) | (says <= 1 - quality.CONFIDENT)
        name = ("text", "page")[1 - pupil]
        assert sure.sum() == sum(n for k, n in report[0].items() if k.startswith(name)) and sure.any()
        x = np.concatenate([views[pupil][train], views[pupil][pool][sure]])
        y = np.concatenate([good[train], (says[sure] > 0.5).astype(int)])
        models.append(text_views.Softmax(2, x.shape[1]).fit(x, y, np.ones(len(y))))
    a, b = (odds(m, x) for m, x in zip(models, views))
    ta, tb = (quality._logistic(o[test][:, None], good[test], np.array([1.0, 0.0]), np.ones(test.sum())) for o in (a, b))
    both = np.stack([ta[0] * a + ta[1], tb[0] * b + tb[1]], axis=1)
    w = quality._logistic(both[test], good[test], np.array([1.0, 0.0, 0.0]), np.ones(test.sum()))
    score = quality._sigmoid(both @ w[:2] + w[2])
    assert np.allclose([got[r[0]]["score"] for r in rows], score, atol=1e-5)


def test_quality_does_not_depend_on_the_order_of_rows(spark):
    rows, labels = corpus(400, 6)
    known = spark.createDataFrame(labels[:250], LABELS)
    one, other = (
        {r["doc_id"]: r["score"] for r in quality.quality_scores(d, known, bound=60, pseudo=20).collect()}
        for d in (spark.createDataFrame(rows, DOCS), spark.createDataFrame(rows[::-1], DOCS).repartition(7, "text"))
    )
    assert one == other

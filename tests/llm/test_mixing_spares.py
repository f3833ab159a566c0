"""The pipeline's mixture drops no document that is probably clean."""

import random

import corpus_pipeline
from listloom.llm import mixing


def blurred(n=900, seed=13):
    """Words of two overlapping vocabularies, so that many memberships are unsure."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        domain = rng.choices([0, 1, 2], [0.2, 0.65, 0.15])[0]
        own = {0: 0.25, 1: 0.5, 2: 0.75}[domain] + rng.uniform(-0.25, 0.25)
        words = [f"a{rng.randint(0, 40)}" if rng.random() < own else f"b{rng.randint(0, 40)}" for _ in range(60)]
        text = " ".join(words)
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(domain != 0), int(domain == 2)))
    return rows, labels


def test_clean_documents_survive_the_mixture(spark, tmp_path):
    rows, labels = blurred()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    known = spark.createDataFrame(labels[:600], "doc_id long, quality int, toxic int")
    known.write.parquet(f"{tmp_path}/labels.parquet")
    shares = mixing.posteriors(docs, mixing.fit_domains(docs, mixing.domain_labels(known))).collect()
    clean = {r["doc_id"] for r in shares if r["p"][1] >= max(r["p"])}
    out = [r["doc_id"] for r in corpus_pipeline.mix_stage(spark, docs, str(tmp_path)).collect()]
    assert 400 < len(clean) < 900 and clean <= set(out)
    # Nothing is repeated, and the rest is thinned until it has little more than its share.
    assert len(out) == len(set(out))
    rest = {r["doc_id"] for r in shares} - clean
    assert len(rest & set(out)) < 0.3 * len(rest)

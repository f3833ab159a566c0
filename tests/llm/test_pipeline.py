import random

import corpus_pipeline
from listloom.llm import common


def test_stages_on_planted_copies(spark, tmp_path):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aeiorstnl") for _ in range(rng.randint(2, 8)))
    rows, labels = [], []
    for i in range(300):
        good = i % 5 != 0
        text = " ".join(word() for _ in range(120)) if good else " ".join([word()] * 80)
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        if i % 2 == 0:
            labels.append((i, int(good), 0))
    base = rows[1][1]
    rows += [(1000 + k, base.replace(" ", "  ", k + 1), "en", "s", 1) for k in range(4)]
    rows += [(2000 + k, base + f" tail{k}", "en", "s", 1) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5
    seen = docs
    ids = []
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        out = common.stage(f(spark, seen, str(tmp_path)), f"s{k}")
        assert k == 4 or out.columns == docs.columns
        seen = out
        ids.append({r["doc_id"] for r in out.collect()})
    clean = {i for i in range(300) if i % 5}
    assert not any(i in ids[0] for i in range(0, 300, 5)) and clean <= ids[0]
    assert len(ids[1] & {1, 1000, 1001, 1002, 1003}) == 1
    assert len(ids[2] & {1, *range(1000, 1004), *range(2000, 2005)}) == 1
    assert ids[4] == ids[3]
    direct = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(direct.select("doc_id", "piece", "length").collect()) == sorted(
        seen.select("doc_id", "piece", "length").collect()
    )

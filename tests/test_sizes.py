"""What a query's work hangs on at size: how often texts are folded, how many tasks share the work, what rows are copied."""

import random
import re

from pyspark.sql import functions as F

from listloom import catalogue
from listloom.operators import nearby
from listloom.operators.similar import similar_sets
from listloom.session import Scratch
from listloom.sources import html


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_normalising_folds_each_text_once_in_all_tasks(spark, tmp_path):
    spark.range(40).withColumnRenamed("id", "p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    df = catalogue.queries()["normalized_listings"](spark, str(tmp_path))
    plan = optimized(df)
    assert len(re.findall(re.escape("[^a-z0-9]+"), plan)) <= 15
    # Nothing of the texts is made below the place where rows are dealt out.
    assert "regexp_replace" not in plan[plan.index("RepartitionByExpression"):]
    assert df.select(F.spark_partition_id().alias("p")).distinct().count() == 4
    assert df.count() == sum(k % 8 != 7 for k in range(40))


def test_similar_sets_hold_one_block_after_another_and_join_no_candidates(spark, monkeypatch):
    """As many pairs of texts share rare words as there are pairs; what is staged and shuffled is the texts."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    sets = {i: set(rng.sample(words, rng.randint(1, 60))) for i in range(150)}
    sets |= {1000 + i: (sets[i] | {f"own{i}"}) - {min(sets[i])} for i in range(0, 150, 3)} | {5000 + i: sets[7] for i in range(20)}
    rows = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "doc_id long, t array<string>")
    written, keep = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df: written.append(df.columns) or keep(self, df))
    for block in (500, 10**6):
        written.clear()
        df = similar_sets(rows, 0.4, block)
        got = {(r["left_id"], r["right_id"]): r["similarity"] for r in df.collect()}
        assert got == {(a, b): j for a, x in sets.items() for b, y in sets.items() if a < b and (j := len(x & y) / len(x | y)) > 0.4}
        assert df.count() == len(got) and "Join" not in optimized(df)
        assert (written.count(["left_id", "right_id", "similarity"]) > 1) == (block == 500)


def test_distances_are_taken_of_places(spark, tmp_path):
    spark.range(3000).withColumnRenamed("id", "s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    df = catalogue.queries()["haversine_pairs"](spark, str(tmp_path))
    plan = optimized(df)
    # Below the distance stands an aggregation by place on either side, and ids meet by place and part.
    assert plan.index("ASIN") < plan.index("Aggregate [zone") and re.search(r"Join Inner, .*part#\d+ = part#\d+", plan)
    rows = df.select("a", "b").collect()
    assert len(rows) == len(set(rows)) and all(r["a"] < r["b"] and (r["b"] - r["a"]) % 4 == 0 for r in rows)
    assert df.select(F.spark_partition_id().alias("p")).distinct().count() == 4


def test_crowded_cells_copy_few_positions(spark):
    points = spark.range(20000).selectExpr("id", "43.6 + id * 7919 % 20011 * 1e-7 AS latitude", "7.2 + id * 104729 % 20021 * 1e-7 AS longitude")
    near, held = nearby.dealt_positions(points, 0.5)
    # One cell: two salts and ten parts. Dealt on one side only, by 1,000, each position was there twenty times.
    assert near.count() <= 2 * 20000 and held.count() == 10 * 20000
    assert held.groupBy("cell", "salt", "part").count().agg(F.max("count")).first()[0] < 11000


def test_nodes_are_tested_before_they_meet_rules(spark):
    """Rules join the few nodes that pass a test, not all of a page's; attributes stay with the node table."""
    pages = spark.createDataFrame([(f"p{k}", "s", f"u{k}", "<div>" + f"<p>x</p><b class='n'>{k}</b>" * 3 + "</div>") for k in range(8)], "page string, site string, url string, html string")
    table = Scratch(spark, "nodes").keep(html.nodes(pages, "page", "url", "site"))
    rules = html.rules_table(spark, [html.rule("s", "n", html.step(tag="div", nth=1), html.step(tag="b", attr="class", op="like", value="^n$", nth=2))])
    found = html.extract(table, rules, depth=2)
    assert {r["page"]: r["fields"]["n"] for r in found.collect()} == {f"p{k}": str(k) for k in range(8)}
    passing, _ = html._tested(table, rules)
    assert passing.count() == 8 * 4

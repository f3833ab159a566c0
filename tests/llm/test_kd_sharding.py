import random
import zlib

from pyspark.sql import functions as F

from listloom.llm import kd_sharding as kd
from listloom.llm.common import weighted_cuts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shards(spark, rows, **options):
    return kd.kd_shards(spark.createDataFrame(rows, SCHEMA), **options).collect()


def sample(n, hot=0):
    rng = random.Random(6)
    rows = [(i, "x" * rng.randint(0, 3000) + str(i), rng.choice("ab"), f"s{rng.randint(0, 9)}", 0) for i in range(n)]
    return rows + [(n + i, "copy" * 20, "a", f"s{i % 3}", 0) for i in range(hot)]


def test_sizes_near_equal_and_slots_gapless(spark):
    rows = sample(900, 60)
    got = shards(spark, rows)
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    text = {r[0]: r[1] for r in rows}
    total, slots = [0] * 8, [[] for _ in range(8)]
    for r in got:
        raw = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        total[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    assert max(total) <= 1.05 * min(total)
    copies = {r["shard"] for r in got if text[r["doc_id"]] == "copy" * 20}
    assert len(copies) == 1  # a light group stays together


def test_a_group_that_holds_most_bytes_is_cut(spark):
    rows = [(i, "same text " * 30, "a", "s", 0) for i in range(600)] + sample(50)
    total = [0] * 8
    for r in shards(spark, rows):
        total[r["shard"]] += r["size"]
    assert max(total) <= 1.15 * min(total)


def test_cuts_are_exact_weighted_quantiles(spark):
    rng = random.Random(2)
    rows = [(n, rng.choice([rng.randint(0, 50), rng.randint(0, 1 << 40)]), rng.randint(1, 9)) for n in (1, 2) for _ in range(400)]
    df = spark.createDataFrame(rows, "node int, key long, w long")
    targets = {n: [q * sum(w for m, _, w in rows if m == n) for q in (0.1, 0.5, 0.93)] for n in (1, 2)}
    cuts = weighted_cuts(df, "node", "key", "w", targets, bits=41, digit=7)
    for n, ts in targets.items():
        for t, c in zip(ts, cuts[n]):
            upto = lambda k: sum(w for m, x, w in rows if m == n and x <= k)
            assert upto(c) >= t > upto(c - 1)


def test_tree_splits_the_widest_dimension(spark):
    rows = [(i, "x" * (10 + i % 3), "l", f"{chr(65 + i % 40)}zz", 0) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r["shard"] for r in kd.kd_shards(df, shards=2).collect()}
    # All dimensions are spread over their whole range at the root, so the first is taken: short texts go low.
    low = {i % 3 for i, s in got.items() if s == 0}
    assert 0 in low and sum(s == 0 for s in got.values()) in range(190, 215)


def test_levels_below_the_driver_split_alike(spark):
    """Prefix sums inside nodes find the same tree as the driver's histograms."""
    rows = sample(500, 40)
    whole = {r["doc_id"]: r["shard"] for r in shards(spark, rows, shards=13)}
    assert len(set(whole.values())) == 13
    for top in (1, 4):
        deep = shards(spark, rows, shards=13, top_nodes=top)
        assert {r["doc_id"]: r["shard"] for r in deep} == whole
        slots = {}
        for r in deep:
            slots.setdefault(r["shard"], []).append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def tree_by_hand(rows, shards):
    """(group, part) to leaf by the rule, in plain code; rows: (key, weight, dimensions, order within equal values)."""
    span = [max(1, max(r[2][d] for r in rows) - min(r[2][d] for r in rows)) for d in range(3)]

    def split(own, leaves, path):
        if leaves == 1 or not own:
            return {r[0]: path for r in own}
        wide = [(max(r[2][d] for r in own) - min(r[2][d] for r in own)) / span[d] for d in range(3)]
        d = wide.index(max(wide))
        own = sorted(own, key=lambda r: (r[2][d], r[3]))
        half = sum(r[1] for r in own) * (leaves // 2) / leaves
        upto, cut = 0, 0
        for r in own:
            upto += r[1]
            cut += upto - r[1] / 2 <= half
        return split(own[:cut], leaves // 2, path + "0") | split(own[cut:], leaves - leaves // 2, path + "1")

    return split(rows, shards, "")


def test_tree_against_brute_force(spark):
    # No document is so heavy that its group would be cut.
    rng = random.Random(9)
    rows = [(i, "x" * rng.randint(0, 200) + str(i), rng.choice("abc"), f"s{rng.randint(0, 9)}", 0) for i in range(1200)]
    df = spark.createDataFrame(rows, SCHEMA)
    tie = F.pmod(F.xxhash64("group", F.lit(0).cast("long")), F.lit(1 << 31))
    known = [
        (r["doc_id"], r["size"], (r["d_length"], r["d_source"], r["d_lang"]), r["tie"])
        for r in kd.sized_rows(df).withColumn("tie", tie).collect()
    ]
    want = tree_by_hand(known, 8)
    got = {r["doc_id"]: r["shard"] for r in shards(spark, rows)}
    leaf = {path: k for k, path in enumerate(sorted(set(want.values())))}
    assert got == {i: leaf[path] for i, path in want.items()}


def test_target_bytes_nulls_repeats_and_empty(spark):
    rows = [(None, None, None, None, None), (1, None, "a", "b", 3), (1, "", "a", "b", 3), (1, "", "a", "b", 3)]
    got = shards(spark, rows, shards=2)
    assert len(got) == 4 and {r["size"] for r in got} == {1}
    assert len({r["shard"] for r in shards(spark, sample(200), target_bytes=60_000)}) > 3
    assert shards(spark, []) == []
    df = spark.createDataFrame([(1, "t", 2, 3, 4)], "doc_id long, text string, uid int, size int, shard int")
    assert [tuple(r)[:2] for r in kd.kd_shards(df).collect()] == [(1, 2)]

"""K-d tree sharding, DataFrame functions only.

Documents with equal text form a group and stay together; a group too heavy for that is cut into even parts by a hash of
its rows. The tree splits groups at the exact weighted median of the metadata dimension that is widest in the node
(length, source and language of the group, spread over their whole range), level by level, until leaves reach the target
number of bytes or shards. All nodes of a level are split by the same distributed jobs. While there are at most
``TOP_NODES`` nodes, the driver sees their extents and histograms of fixed size; below that, each node holds a small part of
the rows and is split by prefix sums of its own, without the driver. Shards are at most ``MOST_SHARDS``. Slots number a shard's rows without gaps by two levels of counting, so no task holds a shard.

Defined cases: null text has no bytes (size 1) and groups with empty text; null metadata sorts first; rows that repeat
are rows of their own; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, text_of, weighted_cuts, with_row_id

SHARDS = 8
#: A group over this part of a shard's bytes is cut.
WHOLE_PART = 1 / 64
DIMENSIONS = ("d_length", "d_source", "d_lang")
#: Nodes of a level that the driver splits, and shards in all.
TOP_NODES = 256
MOST_SHARDS = 1 << 20
#: Rows that one task numbers.
ROWS_PER_BUCKET = 100_000


def _code(column: Column) -> Column:
    """An order-keeping 31-bit number from the first characters of a string; null is 0."""
    text = F.coalesce(column.cast("string"), F.lit(""))
    code = F.lit(0).cast("long")
    for k in range(1, 5):
        code = code * 128 + F.least(F.lit(127), F.ascii(F.substring(text, k, 1))).cast("long")
    # Strings that share their start are told apart by a hash.
    return F.shiftright(code, 7) * 1024 + F.pmod(F.xxhash64(text), F.lit(1024)).cast("long")


def sized_rows(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, size, text_crc32, group, d_length, d_source, d_lang); to be staged."""
    text = text_of(docs)
    have = {c.lower(): c for c in docs.columns}

    def meta(name: str) -> Column:
        return docs[have[name]] if name in have else F.lit(None).cast("string")

    return with_row_id(
        docs.select(
            docs["doc_id"],
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.md5(F.encode(text, "UTF-8")).alias("group"),
            F.length(text).cast("long").alias("d_length"),
            _code(meta("source")).alias("d_source"),
            _code(meta("lang")).alias("d_lang"),
        ),
        "uid",
    )


def _place(dimension: str) -> Column:
    """A 62-bit key that orders a node along a dimension; equal values are ordered by the group's digest and part."""
    value = F.least(F.col(dimension), F.lit((1 << 31) - 1))
    tie = F.pmod(F.xxhash64("group", "part"), F.lit(1 << 31))
    return value * F.lit(1 << 31) + tie


def grow_tree(parts: DataFrame, shards: int, most: int = TOP_NODES) -> list[dict]:
    """Splits as dicts: node, low and high child, dimension, cut (a row goes high when its key is over it), leaves.

    ``parts`` is staged: group, part, weight and the dimensions. Nodes are numbered as in a heap; a node that is to have
    one shard is a leaf. Nodes beyond ``most`` a level are left to ``finish_tree``.
    """
    splits: list[dict] = []
    level = {1: shards}
    extent = parts.agg(*[F.max(d).alias(f"max_{d}") for d in DIMENSIONS], *[F.min(d).alias(f"min_{d}") for d in DIMENSIONS])
    whole = extent.first()
    while any(n > 1 for n in level.values()) and len(level) <= most:
        node = node_column(splits)
        rows = parts.withColumn("node", node)
        totals = rows.groupBy("node").agg(
            F.sum("weight").alias("weight"),
            *[F.max(d).alias(f"max_{d}") for d in DIMENSIONS],
            *[F.min(d).alias(f"min_{d}") for d in DIMENSIONS],
        )
        chosen: dict[int, tuple[str, float]] = {}
        for r in totals.collect():  # one row for each node of the level
            leaves = level.get(r["node"], 1)
            if leaves > 1:
                spread = {
                    d: (r[f"max_{d}"] - r[f"min_{d}"]) / max(1, whole[f"max_{d}"] - whole[f"min_{d}"]) for d in DIMENSIONS
                }
                widest = max(DIMENSIONS, key=lambda d: (spread[d], -DIMENSIONS.index(d)))
                chosen[r["node"]] = (widest, r["weight"] * (leaves // 2) / leaves)
        if not chosen:
            break
        key = F.lit(None).cast("long")
        for n, (d, _) in chosen.items():
            key = F.when(F.col("node") == n, _place(d)).otherwise(key)
        keyed = rows.filter(F.col("node").isin(*chosen)).select("node", key.alias("key"), "weight")
        cuts = weighted_cuts(keyed, "node", "key", "weight", {n: [half] for n, (_, half) in chosen.items()})
        # The row on the median goes to the side that it leaves more even.
        below = {
            r["node"]: r
            for r in keyed.groupBy("node")
            .agg(
                F.sum(F.when(_at_most(cuts), F.col("weight")).otherwise(0)).alias("upto"),
                F.sum(F.when(_at_most(cuts, strict=True), F.col("weight")).otherwise(0)).alias("under"),
            )
            .collect()
        }
        level = {n: k for n, k in level.items() if n not in chosen} | {
            c: k for n in chosen for c, k in ((2 * n, level[n] // 2), (2 * n + 1, level[n] - level[n] // 2))
        }
        for n, (d, half) in chosen.items():
            over, under = below[n]["upto"] - half, half - below[n]["under"]
            splits.append({"node": n, "dimension": d, "cut": cuts[n][0] - (1 if over > under else 0)})
    return splits


def _at_most(cuts: dict[int, list[int]], strict: bool = False) -> Column:
    out = F.lit(False)
    for n, (c,) in cuts.items():
        out = out | ((F.col("node") == n) & ((F.col("key") < c) if strict else (F.col("key") <= c)))
    return out


def node_column(splits: list[dict]) -> Column:
    """The node of a row after the splits so far, from its dimensions, group and part."""
    by_node = {s["node"]: s for s in splits}

    def walk(n: int) -> Column:
        if n not in by_node:
            return F.lit(n)
        s = by_node[n]
        return F.when(_place(s["dimension"]) <= F.lit(s["cut"]), walk(2 * n)).otherwise(walk(2 * n + 1))

    return walk(1)


def leaves_column(shards: int, depth: int) -> Column:
    """Shards of the node that a row is in, from the path that the node's number spells."""
    out = F.lit(shards).cast("long")
    own = F.bin(F.col("node"))
    for k in range(2, depth + 2):
        step = F.substring(own, k, 1)
        low = F.floor(out / 2).cast("long")
        out = F.when(step == "0", low).when(step == "1", out - low).otherwise(out)
    return out


def finish_tree(rows: DataFrame, shards: int, splits: list[dict]) -> DataFrame:
    """``rows`` of parts with their leaf as ``node``: levels below those of ``splits``, each one sort by node and key."""
    whole = rows.agg(*[(F.max(d) - F.min(d)).alias(d) for d in DIMENSIONS]).first()
    depth = max((s["node"].bit_length() for s in splits), default=0)
    now = stage(rows.withColumn("node", node_column(splits).cast("long")).withColumn("leaves", leaves_column(shards, depth)), "tree")
    while not now.filter("leaves > 1").isEmpty():
        node = Window.partitionBy("node")
        spread = [((F.max(d).over(node) - F.min(d).over(node)) / F.lit(max(1, whole[d] or 0))) for d in DIMENSIONS]
        widest = F.greatest(*spread)
        key = F.lit(None).cast("long")
        for d, x in reversed(list(zip(DIMENSIONS, spread))):
            key = F.when(x == widest, _place(d)).otherwise(key)
        keyed = now.withColumn("key", key)
        upto = F.sum("weight").over(node.orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        low_leaves = F.floor(F.col("leaves") / 2).cast("long")
        half = F.sum("weight").over(node) * low_leaves / F.col("leaves")
        # The row on the median goes to the side that it leaves more even.
        low = upto - F.col("weight") / 2 <= half
        split = F.col("leaves") > 1
        now = stage(
            keyed.withColumn("low", low).select(
                *[c for c in rows.columns],
                F.when(~split, F.col("node")).when(F.col("low"), F.col("node") * 2).otherwise(F.col("node") * 2 + 1).alias("node"),
                F.when(~split, F.col("leaves")).when(F.col("low"), low_leaves).otherwise(F.col("leaves") - low_leaves).alias("leaves"),
            ),
            "tree",
        )
    return now.drop("leaves")


def kd_shards(
    docs: DataFrame, shards: int = SHARDS, target_bytes: int | None = None, top_nodes: int = TOP_NODES
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot. With ``target_bytes`` the number of shards follows
    from the bytes of all documents."""
    rows = stage(sized_rows(docs), "sized")
    total = rows.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    if target_bytes is not None:
        shards = max(1, min(MOST_SHARDS, math.ceil((total["bytes"] or 0) / target_bytes)))
    most = max(1.0, (total["bytes"] or 0) / shards * WHOLE_PART)
    groups = stage(
        rows.groupBy("group").agg(
            F.sum("size").alias("group_bytes"),
            F.min("d_length").alias("d_length"),
            F.min("d_source").alias("d_source"),
            F.min("d_lang").alias("d_lang"),
        ).withColumn("parts", F.ceil(F.col("group_bytes") / F.lit(most)).cast("long")),
        "groups",
    )
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("uid"), F.col("parts"))).otherwise(F.lit(0)).cast("long")
    placed = stage(
        rows.drop(*DIMENSIONS).join(groups.drop("group_bytes"), "group").withColumn("part", part).drop("parts"), "grouped"
    )
    parts = stage(
        placed.groupBy("group", "part").agg(
            F.sum("size").alias("weight"), *[F.first(d).alias(d) for d in DIMENSIONS]
        ),
        "parts",
    )
    splits = grow_tree(parts, shards, top_nodes)
    if shards <= top_nodes:
        leaves = sorted(_leaves(splits), key=_path)
        number = F.create_map(*[F.lit(x) for k, n in enumerate(leaves) for x in (n, k)])
        numbered = placed.withColumn("shard", number[node_column(splits)])
    else:
        tree = finish_tree(parts, shards, splits)
        # At most MOST_SHARDS leaves, in the order of their paths.
        path = Window.orderBy(F.substring(F.bin("node"), 2, 64))
        ids = tree.select("node").distinct().select("node", (F.row_number().over(path) - 1).alias("shard"))
        numbered = placed.join(tree.select("group", "part", "node"), ["group", "part"]).join(ids, "node")
    buckets = max(1, -(-total["rows"] // (shards * ROWS_PER_BUCKET))) * 4
    sharded = numbered.select(
        "uid", "doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("uid", F.lit(7)), F.lit(buckets)).alias("bucket")
    )
    return with_slots(sharded)


def with_slots(sharded: DataFrame) -> DataFrame:
    """Gapless numbers from 0 in each shard: rows are numbered in (shard, bucket), after the counts of buckets before."""
    counts = sharded.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "bucket").orderBy("uid")
    numbered = sharded.withColumn("k", F.row_number().over(inside) - 1)
    return numbered.join(offsets, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("k")).cast("long").alias("slot")
    )


def _leaves(splits: list[dict]) -> list[int]:
    inner = {s["node"] for s in splits}
    return [c for n in inner for c in (2 * n, 2 * n + 1) if c not in inner] or [1]


def _path(n: int) -> str:
    return bin(n)[3:]

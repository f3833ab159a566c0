"""What the training-data operators share: staged tables, row ids, text normal forms, distributed cut points and
connected components.

Everything that outlives one job is a Parquet table in the shared folder named by ``spark.checkpoint.dir``: an executor
that is lost takes no intermediate result with it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listloom.session import ship

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"

_own_roots: dict[str, str] = {}


def stage_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables of this application.

    ``spark.checkpoint.dir`` names it. Where it is unset, a local session (tests) gets a temporary folder and any other
    session is refused, since no folder is known to be shared there.
    """
    app = spark.sparkContext.applicationId
    if app not in _own_roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="listloom-")
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/listloom-{app}")
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        # Qualified, since a bare path means another place to Python than to Spark; a local one is written out in full.
        root = fs.makeQualified(path).toString()
        _own_roots[app] = "file://" + root[5:] if root.startswith("file:/") and root[6:7] != "/" else root
        ship(spark)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return _own_roots[app]


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system; one that is not there is no error."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back; this cuts the lineage."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Staged tables that an iteration replaces: ``keep`` stages one, ``drop`` deletes those that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = stage_path(self.spark, self.name)
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = (path, table)
        return table

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path, _ = self.paths.pop(id(t))
            drop_path(self.spark, path)


def broadcast_if_small(staged: DataFrame, most_rows: int = 500_000) -> DataFrame:
    """A staged table of narrow rows, to be broadcast where it has at most ``most_rows``; else the join stays Spark's."""
    return F.broadcast(staged) if staged.count() <= most_rows else staged


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """A 64-bit id per row; stage the result before using it twice."""
    return df.withColumn(name, F.monotonically_increasing_id())


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it where ``df`` already has such a column (case is ignored)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text column as string, null read as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does that for pure ASCII, and faster; other text goes through ``translate``."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, ASCII_UPPER, ASCII_LOWER)
    )


def returning_memory(run: Callable) -> Callable:
    """A task function over Arrow batches that gives freed memory back to the system when it ends: Python workers live on
    between tasks, and what they keep counts against the executor."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def slices(batch: pa.RecordBatch, column: str, most_bytes: int, most_rows: int = 1 << 31) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``most_bytes`` of one column; a longer row stands alone."""
    sizes = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
    low = 0
    while low < batch.num_rows:
        before = sizes[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(sizes, before + most_bytes, side="right")))
        high = min(high, low + most_rows)
        yield batch.slice(low, high - low)
        low = high


def give_back() -> None:
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim is not None:
        trim(0)


# --------------------------------------------------------------------------------------------------------------------
# exact weighted cut points


#: Sums that the driver takes a round, and cut points that one call may look for.
SUMS = 1 << 18
MOST_CUTS = 1024


def weighted_cuts(
    df: DataFrame,
    node: str,
    key: str,
    weight: str,
    targets: dict[int, list[float]],
    bits: int = 62,
    digit: int = 12,
) -> dict[int, list[int]]:
    """For each node, the smallest keys whose cumulative weight reaches each target: exact distributed quantiles.

    Radix descent: every round sums the weights per node and next digit of the non-negative ``bits``-wide integer
    ``key`` (one partially aggregated job over all nodes), and the driver picks the digit in which each target falls.
    There are at most ``MOST_CUTS`` targets, and digits are the shorter the more there are, so the driver never sees more
    than ``SUMS`` sums a round, however large the table.
    """
    state = {(n, i): (0, 0.0) for n, ts in targets.items() for i in range(len(ts))}  # prefix, weight before it
    if len(state) > MOST_CUTS:
        raise ValueError(f"{len(state)} cut points at once; split them over nodes that are worked on apart")
    digit = max(1, min(digit, (SUMS // max(1, len(state))).bit_length() - 1))
    left = bits
    while left > 0 and state:
        step = min(digit, left)
        left -= step
        prefixes = sorted({(n, p) for (n, _), (p, _) in state.items()})
        wanted = df.sparkSession.sql(
            "SELECT cast(n AS bigint) AS _n, cast(p AS bigint) AS _p FROM VALUES "
            + ", ".join(f"({n}, {p})" for n, p in prefixes) + " AS v(n, p)"
        )
        upper = F.shiftright(F.col(key), left + step)
        rows = (
            df.select(F.col(node).cast("long").alias("n"), upper.alias("p"), F.col(key).alias("k"), F.col(weight).alias("w"))
            .join(F.broadcast(wanted), (F.col("n") == F.col("_n")) & (F.col("p") == F.col("_p")))
            .groupBy("n", "p", F.shiftright("k", left).bitwiseAND(F.lit((1 << step) - 1).cast("long")).alias("d"))
            .agg(F.sum(F.col("w").cast("double")).alias("w"))
            .collect()
        )
        sums: dict[tuple[int, int], list[tuple[int, float]]] = {}
        for r in rows:
            sums.setdefault((r["n"], r["p"]), []).append((r["d"], r["w"]))
        for (n, i), (p, before) in list(state.items()):
            digits = sorted(sums.get((n, p), [(0, 0.0)]))
            for d, w in digits:
                chosen, base = d, before
                before += w
                if before >= targets[n][i]:
                    break
            state[n, i] = ((p << step) | chosen, base)
    return {n: [state[n, i][0] for i in range(len(ts))] for n, ts in targets.items()}


# --------------------------------------------------------------------------------------------------------------------
# connected components


def connected_components(edges: DataFrame, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` to ``(node, root)`` for every node with an edge; root is the smallest node of the component.

    Contraction: each node points at its smallest neighbour, pointers are followed to their ends, edges are rewritten
    between those and loops go. A node that neither points nor is pointed to has neighbours that point below it, so it
    points in the next round: two rounds at least halve the nodes, and the rounds are logarithmic. Every round is staged,
    nothing is collected. At the end the pointers are followed back, also level by level.
    """
    spark = edges.sparkSession
    kept = Scratch(spark, name)
    now = kept.keep(
        edges.filter("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    levels: list[DataFrame] = []
    for _ in range(max_rounds):
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = kept.keep(
            both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
            .select("node", F.least("node", "m").alias("root"), F.lit(True).alias("moved"))
        )
        while True:  # each step doubles how far the pointers reach
            onward = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
            further = kept.keep(
                up.join(onward, "root").select(
                    "node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")
                )
            )
            kept.drop(up)
            up = further
            if up.filter("moved").isEmpty():
                break
        levels.append(up)
        smaller = kept.keep(
            now.join(up.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
            .join(up.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
            .filter("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct()
        )
        kept.drop(now)
        now = smaller
        if now.isEmpty():
            break
    else:
        raise RuntimeError("components did not contract")
    result = levels[-1].select("node", "root")
    for up in reversed(levels[:-1]):
        result = kept.keep(
            up.join(result.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select(
                "node", F.coalesce("top", "root").alias("root")
            )
        )
    return result

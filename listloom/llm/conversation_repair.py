"""Conversation repair by weighted finite-state composition.

The turns of a conversation are an input acceptor (a chain), edits are a transducer (keep, rerole, delete, insert, each
with a cost and a label), and the role grammar ``(s?(ua)+)?`` is an acceptor over role initials. Their composition is
explored lazily: ``arcs`` makes the arcs that leave a grammar state under one kind of turn when a conversation first
meets them. The repair is the shortest path over weights (cost, labels), compared in this order.

Labels of an insertion stand before the turn that follows them, and only at the end by themselves. So two label strings
over the same turns never are one another's beginning, and no two paths between the same states have the same labels;
of the strings that lead from one state to the four others, only their *order* matters for what follows. A stretch of
turns therefore acts as a 4 by 4 matrix of (cost, rank), and such matrices multiply: (cost, rank) pairs add and order as
the strings would. That is what makes any length of conversation work: turns are cut into chunks of ``CHUNK`` by place,
every chunk gives its matrix, matrices of a long conversation are multiplied ``CHUNK`` at a time, level by level, the
best end is chosen at the top, and the states between are handed back down, until each chunk can follow its own best
path. A task holds ``CHUNK`` turns' kinds or as many matrices, never a conversation; texts are joined by place.

Two columns are one value over a whole conversation: ``audit`` (a letter for each edit) is put together in one row, and
``repaired_sha256`` is taken over the rows in order, as a stream.

Defined cases: a null role or text is one space; turns go by number (null first), then role, then text; repeated rows
are turns of their own; rows of null conv_id form one conversation; a conversation without rows costs nothing and has
the digest of the empty string; texts of any length stay rows of their own; an empty table gives an empty result; other
columns are left alone.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .chat_format import with_chunks
from .common import broadcast_if_small, stage, stage_root

#: Turns, or matrices, that one row of a task holds.
CHUNK = 4096
KEEP, REROLE, DELETE, INSERT = 0, 1, 2, 5
TRUNCATED = 5
OK, CUT, BAD = 0, 1, 2
#: The grammar: state to role initial to next state. 0 nothing yet, 1 after "s", 2 after "u", 3 after a whole pair.
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
STATES = range(4)
#: Ends: state to cost and labels of the insertions that complete the last pair.
ENDS = {0: (0, ""), 3: (0, ""), 2: (INSERT, "I"), 1: (2 * INSERT, "II")}
ROLES = {"u": "user", "a": "assistant"}
INFINITE = 1 << 60
NOT_BLANK = r"[^\x20\x09-\x0D]"


# --------------------------------------------------------------------------------------------------------------------
# the composition


@functools.cache
def arcs(state: int, initial: str, fault: int) -> dict[int, tuple[int, str]]:
    """Arcs of the composition that read one turn: next state to (cost, labels), with insertions before the turn."""
    out: dict[int, tuple[int, str]] = {}

    def offer(to: int, cost: int, labels: str) -> None:
        out[to] = min(out.get(to, (INFINITE, "")), (cost, labels))

    cost, labels, at, seen = 0, "", state, set()
    while at not in seen:  # insertions walk through the grammar; coming back to a state never pays
        seen.add(at)
        offer(at, cost + DELETE, labels + "D")
        if fault != BAD:
            extra = TRUNCATED if fault == CUT else 0
            if initial in GRAMMAR[at]:
                offer(GRAMMAR[at][initial], cost + KEEP + extra, labels + "K")
            for role in ROLES:
                if role in GRAMMAR[at]:
                    offer(GRAMMAR[at][role], cost + REROLE + extra, labels + "R")
        at = next(GRAMMAR[at][r] for r in ROLES if r in GRAMMAR[at])
        cost, labels = cost + INSERT, labels + "I"
    return out


@functools.cache
def turn_row(state: int, initial: str, fault: int) -> tuple:
    """The row of one turn's matrix: next states with cost and rank of their labels."""
    found = arcs(state, initial, fault)
    order = {h: k for k, h in enumerate(sorted(found, key=lambda h: found[h][1]))}
    return tuple((h, found[h][0], order[h]) for h in found)


class Turn:
    """The matrix of one turn, whose rows are composed when a path first reaches their state."""

    def __init__(self, initial: str, fault: int):
        self.kind = (initial, fault)

    def __getitem__(self, state: int) -> tuple:
        return turn_row(state, *self.kind)


def step(now: dict[int, tuple[int, int]], matrix: Turn | tuple) -> tuple[dict[int, tuple[int, int]], dict[int, int]]:
    """One state's reach, {state: (cost, rank)}, carried over a matrix, and the state that each best path came through."""
    best: dict[int, tuple] = {}
    for h, (cost, rank) in now.items():
        for to, more, behind in matrix[h]:
            way = (cost + more, rank, behind, h)
            if to not in best or way < best[to]:
                best[to] = way
    order = {to: k for k, to in enumerate(sorted(best, key=lambda to: best[to][1:3]))}
    return {to: (w[0], order[to]) for to, w in best.items()}, {to: w[3] for to, w in best.items()}


def product(matrices: list, begins=STATES) -> tuple:
    """The product of matrices, only from the states ``begins``."""
    rows: list[tuple] = [() for _ in STATES]
    for g in begins:
        now = {g: (0, 0)}
        for m in matrices:
            now, _ = step(now, m)
        rows[g] = tuple((h, c, r) for h, (c, r) in now.items())
    return tuple(rows)


def states_between(matrices: list, begin: int, end: int) -> list[int]:
    """The states before each matrix, and at last ``end``, along the best path from ``begin`` to ``end``."""
    now, back = {begin: (0, 0)}, []
    for m in matrices:
        now, came = step(now, m)
        back.append(came)
    path = [end]
    for came in reversed(back):
        path.append(came[path[-1]])
    return path[::-1]


def best_end(row: tuple) -> tuple[int, int]:
    """(state, cost) of the cheapest end, the least labels among equals."""
    cost, _, state = min((c + ENDS[h][0], r, h) for h, c, r in row)
    return state, cost


# --------------------------------------------------------------------------------------------------------------------
# rows


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, key) after the damage that the crc32 of ``conv_id:turn`` modulo 20 chooses."""
    blank = F.lit(" ")
    name = F.concat_ws(":", *[F.coalesce(turns[c].cast("string"), blank) for c in ("conv_id", "turn")])
    rows = turns.select(
        turns["conv_id"],
        turns["turn"].cast("long").alias("turn"),
        F.coalesce(turns["role"].cast("string"), blank).alias("role"),
        F.coalesce(turns["text"].cast("string"), blank).alias("text"),
        F.pmod(F.crc32(name), F.lit(20)).alias("damage"),
    ).filter("damage <> 0")
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.struct("conv_id").alias("key"),  # a structure, in which unknown ids are equal
        F.explode(F.when(F.col("damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def placed_rows(rows: DataFrame, chunk: int) -> DataFrame:
    """Rows with chunk and at (place in the chunk); staged."""
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("key", "chunk").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return stage(with_chunks(rows, counts, chunk).withColumn("at", F.row_number().over(order) - 1), "turns")


def with_faults(placed: DataFrame) -> DataFrame:
    """(key, chunk, at, initial, fault, kind) of every row; kind is blank, duplicate, truncated or null.

    The first of equal rows is found by one partially aggregated minimum of the place, and joined by place: a text that
    a conversation says a million times is no hot key.
    """
    said = F.regexp_replace("text", r"[\x20\x09-\x0D]+$", "")
    narrow = placed.select(
        "key",
        "chunk",
        "at",
        "role",
        F.sha2("text", 256).alias("digest"),
        F.when(~F.col("text").rlike(NOT_BLANK), "blank").alias("blank"),
        F.when(~said.rlike(r"[.!?]\z"), "truncated").alias("truncated"),
    )
    firsts = (
        narrow.groupBy("key", "role", "digest").agg(F.min(F.struct("chunk", "at")).alias("place"))
        .select(F.col("key").alias("k"), F.col("place.chunk").alias("c"), F.col("place.at").alias("a"))
    )
    on = (F.col("key") == F.col("k")) & (F.col("chunk") == F.col("c")) & (F.col("at") == F.col("a"))
    duplicate = F.when(F.col("k").isNull(), "duplicate")
    kind = F.coalesce("blank", duplicate, "truncated")
    fault = F.when(kind.isin("blank", "duplicate"), BAD).when(kind == "truncated", CUT).otherwise(OK)
    initial = F.substring("role", 1, 1)
    return narrow.join(firsts, on, "left").select(
        "key", "chunk", "at", F.when(initial.isin("s", "u", "a"), initial).otherwise("").alias("initial"), fault.alias("fault"), kind.alias("kind")
    )


_MATRIX = "array<array<struct<to:int,cost:bigint,rank:int>>>"
_KEYS = ("key", "chunk")


def _arrow(df: DataFrame, f, columns: str) -> DataFrame:
    """``f(row) -> row`` over the rows of ``df`` as dictionaries, Arrow batch by batch."""
    stage_root(df.sparkSession)  # sends the package before a function of it is made
    empty = df.sparkSession.createDataFrame([], columns).schema
    schema = to_arrow_schema(empty)

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 16):
                yield pa.RecordBatch.from_pylist([f(r) for r in batch.slice(k, 16).to_pylist()], schema=schema)

    return df.mapInArrow(run, empty)


def _written(matrix: tuple) -> list[list[dict]]:
    return [[{"to": h, "cost": c, "rank": r} for h, c, r in row] for row in matrix]


def _read(matrix: list[list[dict]]) -> tuple:
    return tuple(tuple((e["to"], e["cost"], e["rank"]) for e in row) for row in matrix)


def chunk_matrices(faults: DataFrame, key_type: str) -> tuple[DataFrame, DataFrame]:
    """Per chunk: its turns' kinds in order; and its matrix (of a conversation's only chunk just the row of state 0)."""
    turns = faults.groupBy("key", "chunk").agg(
        F.array_sort(F.collect_list(F.struct("at", "initial", "fault"))).alias("turns"),
        *[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in ("blank", "duplicate", "truncated")],
    )
    turns = stage(turns, "chunks")
    chunks = turns.groupBy("key").agg(F.count(F.lit(1)).alias("chunks"), F.max("chunk").alias("last"))
    long = broadcast_if_small(stage(chunks.filter("chunks > 1").select(F.col("key").alias("long")), "long"))
    marked = turns.join(long, turns["key"] == F.col("long"), "left").select("key", "chunk", "turns", F.col("long").isNotNull().alias("many"))

    def build(row):
        kinds = [Turn(t["initial"], t["fault"]) for t in row["turns"]]
        whole = product(kinds, STATES if row["many"] else (0,))
        return {"key": row["key"], "chunk": row["chunk"], "many": row["many"], "matrix": _written(whole)}

    return turns, stage(_arrow(marked, build, f"key {key_type}, chunk long, many boolean, matrix {_MATRIX}"), "matrices")


def boundary_states(matrices: DataFrame, key_type: str, chunk: int) -> tuple[DataFrame, DataFrame]:
    """(costs, bounds): key, cost, end of every conversation, and key, chunk, begin, end of every chunk.

    Up: ``chunk`` neighbours are multiplied at a time until each conversation has one matrix. Down: a product's begin and
    end fix the states between its factors.
    """
    levels, now = [], matrices.filter("many").drop("many")
    while not now.filter("chunk > 0").isEmpty():
        grouped = stage(
            now.groupBy("key", F.floor(F.col("chunk") / chunk).cast("long").alias("group"))
            .agg(F.array_sort(F.collect_list(F.struct("chunk", "matrix"))).alias("parts")),
            "products",
        )

        def build(row):
            parts = [_read(p["matrix"]) for p in row["parts"]]
            whole = parts[0] if len(parts) == 1 else product(parts, [g for g in STATES if parts[0][g]])
            return {"key": row["key"], "chunk": row["group"], "matrix": _written(whole)}

        levels.append(grouped)
        now = stage(_arrow(grouped, build, f"key {key_type}, chunk long, matrix {_MATRIX}"), "matrices")

    def finish(row):
        end, cost = best_end(_read(row["matrix"])[0])
        return {"key": row["key"], "chunk": 0, "many": row["many"], "begin": 0, "end": end, "cost": cost}

    tops = matrices.filter("not many").unionByName(now.withColumn("many", F.lit(True)))
    done = stage(_arrow(tops, finish, f"key {key_type}, chunk long, many boolean, begin int, end int, cost long"), "ends")
    single, bounds = (done.filter(c).select("key", "chunk", "begin", "end") for c in ("not many", "many"))
    for grouped in reversed(levels):

        def spread(row):
            states = states_between([_read(p["matrix"]) for p in row["parts"]], row["begin"], row["end"])
            inner = [{"chunk": p["chunk"], "begin": b, "end": e} for p, b, e in zip(row["parts"], states, states[1:])]
            return {"key": row["key"], "inner": inner}

        up = bounds.select(F.col("key").alias("k"), F.col("chunk").alias("group"), "begin", "end")
        joined = grouped.join(up, (grouped["key"] == F.col("k")) & (grouped["group"] == up["group"])).select("key", "parts", "begin", "end")
        inner = _arrow(joined, spread, f"key {key_type}, inner array<struct<chunk:bigint,begin:int,end:int>>")
        bounds = stage(inner.select("key", F.explode("inner").alias("x")).select("key", "x.*"), "bounds")
    return done.select("key", "cost", F.col("end").alias("last_state")), bounds.unionByName(single)


def chunk_edits(turns: DataFrame, bounds: DataFrame, key_type: str) -> DataFrame:
    """Per chunk: labels; edits as at, before (roles inserted before the turn) and role (null: deleted, '': as it is);
    first and last initial and the number of illegal neighbours inside."""
    b = bounds.select(F.col("key").alias("k"), F.col("chunk").alias("c"), "begin", "end")
    joined = turns.join(b, (turns["key"] == F.col("k")) & (turns["chunk"] == F.col("c"))).select("key", "chunk", "turns", "begin", "end")

    def build(row):
        kinds = [(t["initial"], t["fault"]) for t in row["turns"]]
        states = states_between([Turn(*k) for k in kinds], row["begin"], row["end"])
        labels, edits = [], []
        for t, kind, g, h in zip(row["turns"], kinds, states, states[1:]):
            said = arcs(g, *kind)[h][1]
            before, at = [], g
            for _ in said[:-1]:
                role = next(r for r in ROLES if r in GRAMMAR[at])
                before.append(ROLES[role])
                at = GRAMMAR[at][role]
            new = {"D": None, "K": ""}.get(said[-1], "") if said[-1] != "R" else next(ROLES[r] for r in ROLES if GRAMMAR[at].get(r) == h)
            labels.append(said)
            edits.append({"at": t["at"], "before": before, "role": new})
        initials = [k[0] for k in kinds]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        return {
            "key": row["key"], "chunk": row["chunk"], "labels": "".join(labels), "edits": edits,
            "first": initials[0], "last": initials[-1], "illegal": illegal,
        }

    columns = (
        f"key {key_type}, chunk long, labels string, edits array<struct<at:int,before:array<string>,role:string>>, "
        "first string, last string, illegal long"
    )
    return stage(_arrow(joined, build, columns), "edits")


def repaired_turns(placed: DataFrame, edits: DataFrame, costs: DataFrame) -> DataFrame:
    """(key, chunk, at, turns): what stands in the repaired conversation at each place, an array of (role, text); the
    turns that complete the last pair come behind, with a null chunk's place after all others."""
    each = edits.select(F.col("key").alias("k"), F.col("chunk").alias("c"), F.explode("edits").alias("e"))
    on = (placed["key"] == F.col("k")) & (placed["chunk"] == F.col("c")) & (placed["at"] == F.col("e.at"))
    own = F.when(F.col("e.role").isNotNull(), F.struct(F.when(F.col("e.role") == "", F.col("role")).otherwise(F.col("e.role")).alias("role"), "text"))
    before = F.transform("e.before", lambda r: F.struct(r.alias("role"), F.lit("").alias("text")))
    rows = placed.join(each, on).select("key", "chunk", "at", F.concat(before, F.array_compact(F.array(own))).alias("turns"))
    late = {2: ["assistant"], 1: ["user", "assistant"]}
    for state, roles in late.items():
        turns = F.array(*[F.struct(F.lit(r).alias("role"), F.lit("").alias("text")) for r in roles])
        rows = rows.unionByName(
            costs.filter(F.col("last_state") == state)
            .select("key", F.lit(INFINITE).cast("long").alias("chunk"), F.lit(0).alias("at"), turns.alias("turns"))
        )
    return rows


def streamed_digests(rows: DataFrame, key_type: str) -> DataFrame:
    """(key, repaired_sha256) of ``role:text`` lines in order. Rows pass as a sorted stream: a task holds one digest, not
    a conversation. Conversations of which nothing is left have no row."""
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    lines = rows.filter(F.size("turns") > 0).select("key", "chunk", "at", F.array_join(line, "\n").alias("line"))
    stream = lines.repartition("key").sortWithinPartitions("key", "chunk", "at").select("key", "line")
    stage_root(rows.sparkSession)
    empty = rows.sparkSession.createDataFrame([], f"key {key_type}, repaired_sha256 string").schema
    schema = to_arrow_schema(empty)

    def run(batches):
        key, digest = None, None
        for batch in batches:
            done = []
            for k, text in zip(batch.column("key").to_pylist(), batch.column("line").to_pylist()):
                if digest is not None and k == key:
                    digest.update(b"\n")
                else:
                    if digest is not None:
                        done.append({"key": key, "repaired_sha256": digest.hexdigest()})
                    key, digest = k, hashlib.sha256()
                digest.update(text.encode())
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
        if digest is not None:
            yield pa.RecordBatch.from_pylist([{"key": key, "repaired_sha256": digest.hexdigest()}], schema=schema)

    return stream.mapInArrow(run, empty)


def gaps_of(rows: DataFrame) -> DataFrame:
    """(key, gaps): numbers missing between the first and last turn; counted by (conversation, turn) first."""
    turns = rows.filter("turn is not null").select("key", "turn").distinct()
    return turns.groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))


def repair(turns: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(report, repaired) of conversations as they are: the report has one row for each conversation, with blank,
    duplicate, truncated, illegal, cost and audit; ``repaired`` the turns of ``repaired_turns``."""
    rows = turns.select("conv_id", "turn", "role", "text", F.struct("conv_id").alias("key"))
    key_type = rows.schema["key"].dataType.simpleString()
    placed = placed_rows(rows, chunk)
    by_chunk, matrices = chunk_matrices(with_faults(placed), key_type)
    costs, bounds = boundary_states(matrices, key_type, chunk)
    edits = chunk_edits(by_chunk, bounds, key_type)
    # Neighbours in two chunks: one row for each chunk.
    before = F.lag("last").over(Window.partitionBy("key").orderBy("chunk"))
    meets = F.concat(before, F.col("first"))
    borders = edits.withColumn("border", (before.isNotNull() & ~meets.isin("su", "ua", "au")).cast("long"))
    per_key = borders.groupBy("key").agg(
        F.sum(F.col("illegal") + F.col("border")).alias("illegal"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "labels"))), lambda x: x["labels"]), "").alias("labels"),
    )
    faults = by_chunk.groupBy("key").agg(*[F.sum(k).alias(k) for k in ("blank", "duplicate", "truncated")])
    late = F.when(F.col("last_state") == 1, "II").when(F.col("last_state") == 2, "I").otherwise("")
    report = costs.join(per_key, "key").join(faults, "key").select(
        "key", "blank", "duplicate", "truncated", "illegal", "cost", F.concat("labels", late).alias("audit")
    )
    return report, repaired_turns(placed, edits, costs)


def repair_report(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Conversations after damage, one row for each of the table: conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256."""
    rows = stage(damaged(turns).drop("key"), "damaged")
    report, repaired = repair(rows, chunk)
    key_type = report.schema["key"].dataType.simpleString()
    digests = streamed_digests(repaired, key_type)
    every = turns.select(F.struct(turns["conv_id"]).alias("key")).distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    whole = every.join(report, "key", "left").join(gaps_of(rows.select(F.struct("conv_id").alias("key"), "turn")), "key", "left")
    return whole.join(digests, "key", "left").select(
        F.col("key.conv_id").alias("conv_id"),
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )

"""Chat formatting in budgeted windows, DataFrame functions only.

Turns get a token cost, and prefix sums over a conversation choose the windows: a window is a run of turns whose prefix
sums begin in the same cell of ``budget - history - share - system`` tokens, cut also before and after every turn that
costs more than ``share``. So windows are turn-aligned, need no sequential scan, and keep to the budget unless a single
turn (or the system turn) alone exceeds it; such windows say ``over_budget``. Every window starts with the system turn
and repeats the last turns before it that fit the history allowance. Repeated turns are masked, so each assistant turn
carries loss exactly once. A text costs at least a token for every ``BYTES`` bytes, so what is repeated is bounded in
bytes as well.

A conversation is worked on in chunks of ``CHUNK`` turns by their place in it, however long it is and whatever numbers
its turns have; a window does not cross chunks, and history begins anew with a chunk. Only conversations of more than
one chunk need places: they are sorted over range partitions, and counts of partitions give each its offset, so no task
holds a whole conversation. The system turn is joined by conversation and chunk: its cost to turns, its text to windows.

The template puts ``<|turn|>role`` and a line break before a text and ``<|end|>`` and a line break after it. Inside a
role or text a backslash is doubled, and a backslash is put behind the first character of every control string (those of
this template and of other common ones), so no control string remains; ``unescape`` takes that back exactly.

Defined cases: null text or role is empty; turns are ordered by number (null first), then role, then text; repeated
rows are turns of their own; rows of null conv_id form one conversation; a very long text is a window of its own and is
never repeated; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, stage

BUDGET = 1024
HISTORY = 256
SHARE = 256
#: Turns that one task of the prefix sums handles of one conversation at a time.
CHUNK = 4096
#: Bytes of text that cost a token at least.
BYTES = 16
OPEN, CLOSE = "<|turn|>", "<|end|>\n"
#: Control strings that no text may keep: what follows "<" or "[" in them. Fixed values.
CONTROL = r"(?:<(?=\||/?s>|</?SYS>|/?SYS>|bos>|eos>|pad>|start_of_turn>|end_of_turn>)|\[(?=/?INST\]|/?SYS\]))"
#: Tokens of a text: words, or single other marks.
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"
OVERHEAD = 4


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, f"({CONTROL})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def turn_cost(text: Column) -> Column:
    tokens = F.regexp_count(text, F.lit(TOKEN)).cast("long")
    return F.greatest(tokens, F.ceil(F.octet_length(text) / BYTES)) + F.lit(OVERHEAD)


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def with_chunks(base: DataFrame, per_conversation: DataFrame, chunk: int) -> DataFrame:
    """``base`` with the chunk of each turn: its place in the conversation over ``chunk``."""
    long = per_conversation.filter(F.col("n") > chunk).select(F.col("key").alias("long_key"))
    count = long.count()
    if count == 0:
        return base.withColumn("chunk", F.lit(0).cast("long"))
    # At most one conversation for every ``chunk`` turns.
    long = broadcast_if_small(long)
    of_long = base["key"] == F.col("long_key")
    short = base.join(long, of_long, "left_anti").withColumn("chunk", F.lit(0).cast("long"))
    many = base.join(long, of_long, "left_semi")
    # Ids of a range partition are its number and the row's place in it.
    placed = stage(
        many.repartitionByRange("conv_id", *_order()).sortWithinPartitions("conv_id", *_order())
        .withColumn("id", F.monotonically_increasing_id()),
        "long-conversations",
    )
    runs = placed.groupBy("key", F.shiftright("id", 33).alias("part")).agg(F.min("id").alias("begin"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("key", "part", "begin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    run_key = runs.select(F.col("key").alias("run_key"), "part", "begin", "offset")
    at = F.col("offset") + F.col("id") - F.col("begin")
    on = (placed["key"] == F.col("run_key")) & (F.shiftright(placed["id"], 33) == F.col("part"))
    chunked = placed.join(run_key, on).withColumn("chunk", F.floor(at / chunk).cast("long"))
    return short.unionByName(chunked.drop("id", "run_key", "part", "begin", "offset"))


def placed_turns(
    turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, share: int = SHARE, chunk: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(turns, systems). Turns with chunk, at (place in the chunk), cost, start (cost before it in the chunk), window
    (number in the chunk), the cost of the conversation's system turn, and, on a window's first turn, past: the turns
    before it within the history allowance. Systems: the system turn of each chunk; its text meets windows, not turns."""
    chunk = chunk or CHUNK
    text = F.coalesce(turns["text"].cast("string"), F.lit(""))
    base = turns.select(
        turns["conv_id"],
        turns["turn"].cast("long").alias("turn"),
        F.coalesce(turns["role"].cast("string"), F.lit("")).alias("role"),
        text.alias("text"),
        turn_cost(text).alias("cost"),
        # A structure, in which unknown ids are equal.
        F.struct(turns["conv_id"]).alias("key"),
    )
    # The first turn of each conversation; partial aggregation leaves one candidate a task.
    head = F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", "text", "cost"))
    per_conversation = stage(
        base.groupBy("key").agg(head.alias("head"), F.count(F.lit(1)).alias("n"))
        .withColumn("system", F.when(F.col("head.role") == "system", F.struct("head.role", "head.text", "head.cost")))
        .filter((F.col("n") > chunk) | F.col("system").isNotNull()).select("key", "n", "system"),
        "conversations",
    )
    chunks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / chunk))
    systems = per_conversation.filter("system is not null").select(
        F.col("key").alias("system_key"), "system", F.explode(chunks).alias("system_chunk")
    )
    rows = with_chunks(base, per_conversation, chunk)
    costs = systems.select("system_key", "system_chunk", F.struct("system.cost").alias("system"))
    on = (rows["key"] == costs["system_key"]) & (rows["chunk"] == costs["system_chunk"])
    rows = rows.join(costs, on, "left").drop("system_key", "system_chunk")
    inside = Window.partitionBy("key", "chunk").orderBy(*_order())
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.row_number().over(inside) - 1).withColumn(
        "start", F.coalesce(F.sum("cost").over(before), F.lit(0))
    )
    system_cost = F.coalesce(F.col("system.cost"), F.lit(0))
    room = F.greatest(F.lit(share), F.lit(budget - history - share) - system_cost)
    rows = rows.withColumn(
        "is_system", F.col("system").isNotNull() & (F.col("at") == 0) & (F.col("chunk") == 0)
    ).withColumn("cell", F.floor(F.col("start") / room))
    # Costs are positive, so starts increase and order the turns of a chunk.
    by_start = Window.partitionBy("key", "chunk").orderBy("start")
    cut = (F.col("cell") != F.lag("cell").over(by_start)) | (F.col("cost") > share) | (F.lag("cost").over(by_start) > share)
    rows = rows.withColumn("cut", F.coalesce(cut, F.lit(False)).cast("int"))
    turn = F.struct("at", "role", "text", "cost", "start", "is_system")
    rows = rows.withColumn(
        "window", F.sum("cut").over(by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ).withColumn("past", F.collect_list(turn).over(by_start.rangeBetween(-history, -1)))
    return rows.withColumn("past", F.when((F.col("cut") == 1) | (F.col("at") == 0), F.col("past"))), systems


def format_windows(
    turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, share: int = SHARE, chunk: int | None = None
) -> DataFrame:
    """One row per window: conv_id, chunk, window, tokens, over_budget, formatted, and spans in order of place: at (the
    turn's place in the chunk, -1 for a repeated system turn), role_at, role_length, text_at, text_length (code points
    in ``formatted``), repeated, loss."""
    placed, systems = placed_turns(turns, budget, history, share, chunk)
    turn = F.struct("at", "role", "text", "cost", "start", "is_system")
    windows = placed.groupBy("key", "chunk", "window").agg(
        F.array_sort(F.collect_list(turn)).alias("own"),
        F.first("past", ignorenulls=True).alias("past"),
        F.sum("cost").alias("own_cost"),
    ).withColumn("conv_id", F.col("key.conv_id"))
    on = (windows["key"] == systems["system_key"]) & (windows["chunk"] == systems["system_chunk"])
    windows = windows.join(systems, on, "left").drop("system_key", "system_chunk")
    has_own_system = F.exists("own", lambda t: t["is_system"])
    repeats_system = F.col("system").isNotNull() & ~has_own_system
    system_cost = F.when(repeats_system, F.col("system.cost")).otherwise(0)
    allowance = F.least(F.lit(history), F.greatest(F.lit(0), F.lit(budget) - system_cost - F.col("own_cost")))
    windows = windows.withColumn("system_part", system_cost).withColumn("allowance", allowance)
    begins = F.col("own")[0]["start"]
    past = F.filter("past", lambda t: ~t["is_system"] & (t["start"] >= begins - F.col("allowance")))
    windows = windows.withColumn("past", F.array_sort(past))

    def segment(at, role, text, repeated):
        r, t = escape(role), escape(text)
        return F.struct(
            at.cast("int").alias("at"),
            F.concat(F.lit(OPEN), r, F.lit("\n"), t, F.lit(CLOSE)).alias("written"),
            F.length(r).alias("role_length"),
            F.length(t).alias("text_length"),
            repeated.alias("repeated"),
            (~repeated & (role == "assistant")).alias("loss"),
        )

    # Without a system turn to repeat, the one entry is null and goes.
    head = F.array_compact(
        F.array(F.when(repeats_system, segment(F.lit(-1), F.col("system.role"), F.col("system.text"), F.lit(True))))
    )
    windows = windows.withColumn(
        "segments",
        F.concat(
            head.cast(_SEGMENTS),
            F.transform("past", lambda t: segment(t["at"], t["role"], t["text"], F.lit(True))).cast(_SEGMENTS),
            F.transform("own", lambda t: segment(t["at"], t["role"], t["text"], F.lit(False))).cast(_SEGMENTS),
        ),
    )
    begin = F.transform(
        "segments",
        lambda s, i: F.aggregate(
            F.slice("segments", F.lit(1), i), F.lit(0), lambda n, x: n + F.length(x["written"])
        ),
    )
    spans = F.transform(
        F.arrays_zip(F.col("segments").alias("s"), begin.alias("b")),
        lambda z: F.struct(
            z["s"]["at"].alias("at"),
            (z["b"] + len(OPEN)).alias("role_at"),
            z["s"]["role_length"].alias("role_length"),
            (z["b"] + len(OPEN) + z["s"]["role_length"] + 1).alias("text_at"),
            z["s"]["text_length"].alias("text_length"),
            z["s"]["repeated"].alias("repeated"),
            z["s"]["loss"].alias("loss"),
        ),
    )
    tokens = (
        F.col("own_cost") + F.col("system_part") + F.aggregate("past", F.lit(0).cast("long"), lambda n, t: n + t["cost"])
    )
    return windows.select(
        "conv_id",
        "chunk",
        "window",
        tokens.alias("tokens"),
        (tokens > budget).alias("over_budget"),
        F.array_join(F.transform("segments", lambda s: s["written"]), "").alias("formatted"),
        spans.alias("spans"),
    )


_SEGMENTS = (
    "array<struct<at:int,written:string,role_length:int,text_length:int,repeated:boolean,loss:boolean>>"
)


def read_turns(windows: DataFrame) -> DataFrame:
    """Each turn once, read back from the formatted text: conv_id, chunk, at, role, text, loss, formatted_chars (of its
    window, on the window's first own turn; else 0)."""
    own = F.filter("spans", lambda s: ~s["repeated"])
    each = windows.select("conv_id", "chunk", "formatted", F.posexplode(own).alias("k", "s"))

    def part(at, length):
        return unescape(F.substring(F.col("formatted"), F.col(at) + 1, F.col(length)))

    return each.select(
        "conv_id",
        "chunk",
        F.col("s.at").alias("at"),
        part("s.role_at", "s.role_length").alias("role"),
        part("s.text_at", "s.text_length").alias("text"),
        F.col("s.loss").alias("loss"),
        F.when(F.col("k") == 0, F.length("formatted")).otherwise(0).cast("long").alias("formatted_chars"),
    )


def conversation_digests(windows: DataFrame) -> DataFrame:
    """Per conversation, from the formatted windows: turn and loss digests. A digest is taken over a whole conversation
    in order, so a conversation's texts meet in one row here, and only here."""
    turns = read_turns(windows)
    whole = turns.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("chunk", "at", "role", "text", "loss"))).alias("turns"),
        F.sum("formatted_chars").alias("formatted_chars"),
    )
    line = F.lit("\n")
    said = F.transform("turns", lambda t: F.concat(t["role"], line, t["text"], line))
    lost = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"])
    lost_text = F.array_join(lost, "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length(lost_text).cast("long").alias("loss_chars"),
        F.sha2(lost_text, 256).alias("loss_sha256"),
        "formatted_chars",
    )

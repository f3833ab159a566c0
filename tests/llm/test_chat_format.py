import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from listloom.llm import chat_format as cf

SCHEMA = "conv_id long, turn long, role string, text string"
CONTROLS = ["<|turn|>", "<|end|>", "</s>", "<s>", "[INST]", "[/INST]", "<</SYS>>", "<<SYS>>"]


def brute(rows):
    """Digests per conversation, straight from the rows."""
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def digests(windows):
    keep = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    return {r["conv_id"]: tuple(r[k] for k in keep) for r in cf.conversation_digests(windows).collect()}


def conversation(rng, c, n, system):
    rows = [(c, 0, "system", "be kind " * rng.randint(1, 20))] if system else []
    for t in range(len(rows), n):
        text = " ".join(rng.choice(["ab", "c.d", "é", "<|end|>", "\\", "[INST]"]) for _ in range(rng.choice([1, 5, 40, 90])))
        rows.append((c, t, "user" if t % 2 else "assistant", text))
    return rows


def test_windows_budget_order_and_masks(spark):
    rng = random.Random(8)
    rows = [x for c in range(12) for x in conversation(rng, c, rng.randint(1, 60), c % 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    windows = cf.format_windows(df, budget=200, history=40, share=60).cache()
    assert digests(windows) == brute(rows)
    for w in windows.collect():
        own = [s for s in w["spans"] if not s["repeated"]]
        # Only a turn that is too long by itself goes over the budget.
        assert w["over_budget"] == (w["tokens"] > 200) and (len(own) == 1 or not w["over_budget"])
        assert [s["at"] for s in own] == list(range(own[0]["at"], own[0]["at"] + len(own)))
        assert not any(s["loss"] for s in w["spans"] if s["repeated"])
        assert w["formatted"].count(cf.OPEN) == w["formatted"].count(cf.CLOSE) == len(w["spans"])
        if w["conv_id"] % 2:
            assert w["formatted"].startswith(f"{cf.OPEN}system\n")
    assert windows.filter("exists(spans, s -> s.repeated and s.at > 0)").count() > 0


def test_chunks_of_a_long_conversation_go_by_place(spark):
    # Turn numbers far apart, and rows that share their number.
    rows = [(c, t if c == 7 else t * 1_000_003, r, x) for c, t, r, x in conversation(random.Random(1), 5, 100, True)]
    rows += [(6, 1 if t else 0, r, f"{t} {x}") for _, t, r, x in conversation(random.Random(2), 6, 60, True)]
    rows += conversation(random.Random(3), 7, 10, True)
    rows += [(None, t, r, x) for _, t, r, x in conversation(random.Random(4), 8, 40, False)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    windows = cf.format_windows(df, budget=300, history=50, share=60, chunk=16).cache()
    assert digests(windows) == brute(rows)
    chunks = {}
    for w in windows.collect():
        own = sum(not s["repeated"] for s in w["spans"])
        chunks.setdefault(w["conv_id"], {}).setdefault(w["chunk"], []).append(own)
        assert w["conv_id"] in (None, 7) or w["formatted"].startswith(f"{cf.OPEN}system\n")
    sizes = {c: [sum(own[k]) for k in sorted(own)] for c, own in chunks.items()}
    assert sizes == {5: [16] * 6 + [4], 6: [16] * 3 + [12], 7: [10], None: [16, 16, 8]}
    assert windows.filter("exists(spans, s -> s.repeated and s.at > 0)").count() > 5


def test_a_very_long_word_stands_alone(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "w" * 10_000_000), *[(1, t, "user", f"b{t}") for t in range(2, 60)]]
    windows = cf.format_windows(spark.createDataFrame(rows, SCHEMA))
    assert digests(windows) == brute(rows)
    sizes = sorted(r["n"] for r in windows.select(F.length("formatted").alias("n")).collect())
    assert sizes[-1] > 10_000_000 and sizes[-2] < 20_000


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*CONTROLS, "\\", "<", "[", "|", "s>", "a", "\n"]), max_size=8).map("".join), min_size=1, max_size=20))
def test_escape_is_reversible_and_leaves_no_control(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", cf.escape(F.col("t")))
    for r in df.withColumn("u", cf.unescape(F.col("e"))).collect():
        assert r["u"] == r["t"] and not any(c in r["e"] for c in CONTROLS)


def test_nulls_repeats_empty_and_clashing_columns(spark):
    rows = [(None, 1, "user", "x"), (1, None, None, None), (1, None, None, None), (1, 3, "assistant", None), (2, 0, "system", "only")]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("chunk", "start", "system", "past", "spans")})
    assert digests(cf.format_windows(df)) == brute(rows)
    assert cf.format_windows(df.limit(0)).count() == 0


def test_a_long_system_turn_meets_windows_only(spark):
    rows = [(1, 0, "system", "rule " * 20_000)] + [(1, k, "user" if k % 2 else "assistant", f"word{k} " * 30) for k in range(1, 41)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    placed, systems = cf.placed_turns(df)
    assert placed.schema["system"].dataType.fieldNames() == ["cost"] and systems.count() == 1
    windows = cf.format_windows(df).collect()
    assert len(windows) > 2 and all(w["formatted"].count("rule ") == 20_000 and w["over_budget"] for w in windows)
    turns = sorted(cf.read_turns(cf.format_windows(df)).collect(), key=lambda r: (r["chunk"], r["at"]))
    assert [(r["role"], r["text"]) for r in turns] == [r[2:] for r in rows]

import functools
import hashlib
import random
import re
import zlib

import pytest

from listloom.llm import conversation_repair as cr

SPACE = "[\x20\x09-\x0d]"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(name.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(initials, faults):
    """Edits from the last turn backwards, so that a label only ever goes before a string."""
    grammar = {("0", "s"): "1", ("0", "u"): "2", ("1", "u"): "2", ("2", "a"): "3", ("3", "u"): "2"}

    @functools.cache
    def best(i, g, inserted=0):
        ways = [(0, "")] if i == len(initials) and g in "03" else []
        arcs = [("I", 5, grammar[g, r], i, inserted + 1) for r in "ua" if (g, r) in grammar and inserted < 4]
        if i < len(initials):
            arcs.append(("D", 2, g, i + 1, 0))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] == "truncated" else 0
                arcs += [("R", 1 + more, grammar[g, r], i + 1, 0) for r in "ua" if (g, r) in grammar]
                if (g, initials[i]) in grammar:
                    arcs.append(("K", more, grammar[g, initials[i]], i + 1, 0))
        for label, cost, h, j, k in arcs:
            rest = best(j, h, k)
            if rest is not None:
                ways.append((cost + rest[0], label + rest[1]))
        return min(ways, default=None)

    return best(0, "0")


def brute(rows):
    """Each conversation's report by plain code."""
    out = {}
    for conv in {r[0] for r in rows}:
        after = sorted((r for r in damage(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, faults = set(), []
        for _, _, role, text in after:
            last = re.sub(f"{SPACE}+\\Z", "", text)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last in ".!?" else "truncated")
            seen.add((role, text))
        initials = [r[2][:1] for r in after]
        cost, audit = cheapest(tuple(initials), tuple(faults))
        said, i, at = [], 0, "s"
        for x in audit:
            role = "assistant" if at == "user" else "user"
            if x == "I":
                said.append(f"{role}:")
                at = role
            else:
                if x in "KR":
                    at = after[i][2] if x == "K" else role
                    said.append(f"{at}:{after[i][3]}")
                    at = {"s": "s", "u": "user", "a": "assistant"}[at[:1]]
                i += 1
        turns = [r[1] for r in after if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        counts = [faults.count(k) for k in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def conversations(seed, count=60, longest=9):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "well", "é?", "", " \t", "ok. \n", None, "a.b", "¿"]
    rows = []
    for conv in [None, *range(count)]:
        for k in range(rng.randint(1, longest)):
            turn = None if rng.random() < 0.05 else rng.choice([k, k, k, k + 1])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool", "uncle"])
            rows.append((conv, turn, role, rng.choice(texts)))
    return rows


def report(spark, rows, extra=(), **options):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for c in extra:
        df = df.withColumn(c, df["turn"])
    return {r["conv_id"]: tuple(r)[1:] for r in cr.repair_report(df, **options).collect()}


def test_against_brute_force(spark):
    rows = conversations(5)
    assert report(spark, rows) == brute(rows)


def test_chunks_and_products_of_matrices_change_nothing(spark):
    rows = conversations(8, count=12, longest=40)
    expected = brute(rows)
    for chunk in (2, 3):  # up to five levels of products
        assert report(spark, rows, chunk=chunk) == expected


def test_matrix_products_are_the_paths_of_the_whole():
    rng = random.Random(1)
    for _ in range(300):
        kinds = [(rng.choice("sua"), rng.choice([cr.OK, cr.CUT, cr.BAD])) for _ in range(rng.randint(1, 9))]
        turns = [cr.Turn(*k) for k in kinds]
        cut = rng.randint(0, len(turns))
        parts = [cr.product(p) for p in (turns[:cut], turns[cut:]) if p]
        assert [sorted(r) for r in cr.product(parts)] == [sorted(r) for r in cr.product(turns)]
        end, cost = cr.best_end(cr.product(turns)[0])
        states = cr.states_between(turns, 0, end)
        audit = "".join(cr.arcs(g, *k)[h][1] for k, g, h in zip(kinds, states, states[1:])) + cr.ENDS[end][1]
        names = {cr.OK: "", cr.CUT: "truncated", cr.BAD: "blank"}
        assert (cost, audit) == cheapest(tuple(k[0] for k in kinds), tuple(names[k[1]] for k in kinds))


def test_no_labels_begin_other_labels_over_the_same_turn():
    for g in cr.STATES:
        for initial in ("s", "u", "a", ""):
            for fault in (cr.OK, cr.CUT, cr.BAD):
                labels = [x[1] for x in cr.arcs(g, initial, fault).values()]
                assert len(set(labels)) == len(labels)
                assert not any(a != b and b.startswith(a) for a in labels for b in labels)


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)], [(None, 3, "user", "")]])
def test_empty_and_lonely_rows(spark, rows):
    assert report(spark, rows) == brute(rows)


def test_repeated_rows_long_text_and_clashing_columns(spark):
    rows = [(1, 4, "user", "x " * 300_000 + "?")] * 3 + [(1, 5, "assistant", "y.")] * 2 + [(2, k, "user", "same.") for k in range(30)]
    extra = ("key", "chunk", "at", "n", "labels", "k", "c", "fault")
    assert report(spark, rows, extra) == report(spark, rows, chunk=4) == brute(rows)

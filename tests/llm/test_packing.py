import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from listloom.llm import packing
from listloom.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def words():
    return packing.WordTokenizer(tokenizer_path())


def ids_of(words, texts):
    flat, at = words.encode(pa.array(texts, pa.string()))
    return [flat[at[k] : at[k + 1]].tolist() for k in range(len(texts))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aàB.,!'sñ \n\t1日́ß<|>éÀİΣ\x1c ", max_size=25), min_size=1, max_size=8))
def test_word_ids_equal_whole_text_ids(words, texts):
    w = words
    assert ids_of(w, texts) == [w.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_special_strings_and_edges(words):
    texts = ["x<|endoftext|>y <|startoftext|>", "", " ", "don't I'LL we've", "été, naïve! ¿qué? ...", "\x0b\x0cé É ẞ ﬁ µªº"]
    assert ids_of(words, texts) == [words.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_are_encoded_once_until_there_are_too_many(words):
    met = []

    def encode(new):
        met.extend(new.to_pylist())
        return words._any(new)

    known = packing.KnownWords(encode, most=3)
    for batch in ["ab", "c."], ["c.", "x9"], [], ["x9", "ab"], ["new", "ab", "q"], ["日", "é!", "x9", "ab"], ["ab"]:
        starts, lengths = known.places(pa.array(batch, pa.string()))
        got = [known.ids[a : a + n].tolist() for a, n in zip(starts, lengths)]
        assert got == [words.tokenizer.encode(t, add_special_tokens=False).ids for t in batch]
    assert met == ["ab", "c.", "x9", "new", "ab", "q", "日", "é!", "x9", "ab"]
    # Of a worker's batches and tasks, too.
    assert packing.word_tokenizer(tokenizer_path()) is packing.word_tokenizer(tokenizer_path())
    texts = ["Known words, known! 7x", "déjà (vu) known"]
    first, before = ids_of(words, texts), [len(k.words) for k in (words.known_bare, words.known_any)]
    assert ids_of(words, texts[::-1]) == first[::-1]
    assert [len(k.words) for k in (words.known_bare, words.known_any)] == before
    words.serving("one call"), ids_of(words, texts)
    assert len(words.serving("one call").known_bare.words) > 0 == len(words.serving("another").known_bare.words)


def test_best_fit_decreasing_is_a_packing():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 100, 500)
    bins, offsets = packing.best_fit_decreasing(lengths, 100)
    for b in range(bins.max() + 1):
        own = np.flatnonzero(bins == b)
        order = own[np.argsort(offsets[own])]
        assert offsets[order].tolist() == np.concatenate([[0], np.cumsum(lengths[order])[:-1]]).tolist()
        assert lengths[own].sum() <= 100


def _fewest(lengths, window):
    """Smallest number of sequences, by search."""
    best = len(lengths)
    items = sorted(lengths, reverse=True)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= items[i] and rooms.index(rooms[k]) == k:
                rooms[k] -= items[i]
                go(i + 1, rooms)
                rooms[k] += items[i]
        go(i + 1, [*rooms, window - items[i]])

    go(0, [])
    return best


def test_bound_never_exceeds_the_fewest():
    rng = random.Random(2)
    tight = 0
    for k in range(60):
        lengths = [rng.randint(1, 64) if k % 2 else rng.choice([20, 22, 33, 40]) for _ in range(9)]
        bound, fewest = packing.lower_bound(np.bincount(lengths, minlength=65)), _fewest(lengths, 64)
        assert sum(lengths) / 64 <= bound <= fewest
        tight += bound == fewest
    assert tight > 40
    assert packing.lower_bound(np.zeros(65, np.int64)) == 0
    assert packing.lower_bound(np.bincount([33] * 7, minlength=65)) == 7


def test_rounds_exchange_pieces_and_never_lose_one(spark):
    rng = random.Random(4)
    rows = [(i, 0, rng.choice([33, 34, 20, 46, 10, 7, 3])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, length long")
    report = []
    got = packing.place_pieces(df, 100, per_partition=100, released=20, report=report).collect()
    assert sorted((r["doc_id"], r["length"]) for r in got) == sorted((a, c) for a, _, c in rows)
    fill = {}
    for r in got:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in fill.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
        assert sum(n for _, n in own) <= 100
    assert len(report) > 1 and report[-1]["sequences"] == len(fill) < report[0]["sequences"]
    assert len(fill) >= report[0]["bound"]
    # Certificates: of the whole, and of each partition over the pieces that it packed.
    assert {(r["sequences"], r["sequences_bound"]) for r in got} == {(len(fill), report[0]["bound"])}
    assert all(r["partition_bound"] <= r["partition_sequences"] for r in got)
    assert report[0]["gaps"] > 0 and report[0]["parts"] == 30


def test_only_partitions_with_a_gap_release(spark):
    # Lengths of half a window: every partition is at its bound, whatever its loosest sequence.
    rows = [(i, 0, 50) for i in range(1001)]
    report = []
    df = spark.createDataFrame(rows, "doc_id long, piece int, length long")
    got = packing.place_pieces(df, 100, per_partition=100, released=20, report=report).collect()
    assert len(report) == 1 and report[0]["gaps"] == 0 and report[0]["sequences"] > report[0]["bound"]
    assert all(r["partition_bound"] == r["partition_sequences"] for r in got)
    # The packer itself: a tight partition gives nothing away, a loose one its loosest sequences.
    for lengths, gives in (([50, 50, 50], 0), ([51, 30, 30, 30, 26, 23, 10], None)):
        table = pa.table({"uid": list(range(len(lengths))), "length": lengths})
        out = packing._packer(100, 0, 1, ["uid"])((pa.scalar(0),), table)
        gap = out["partition_sequences"][0].as_py() > out["partition_bound"][0].as_py()
        assert gap == any(out["loose"].to_pylist()) and (gives is None or not gap)


def test_pieces_nulls_long_texts_and_clashing_columns(spark):
    rows = [(1, None, 0), (2, "", 1), (None, "hello world", 2), (4, "word " * 9000, 3), (4, "word " * 9000, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = packing.pack_documents(df, tokenizer_path()).collect()
    assert len(got) == 3 + 2 * 3
    assert sorted(r["length"] for r in got if r["doc_id"] == 4) == [809, 809, 4096, 4096, 4096, 4096]
    assert [r["ids"] for r in got if r["doc_id"] == 1] == [(1).to_bytes(4, "little")]
    assert all(len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) for r in got)
    assert packing.pack_documents(df.limit(0), tokenizer_path()).count() == 0

"""Importance resampling towards a target distribution, on features hashed by CRC combination.

A text's features are its runs of 1 to ``n`` consecutive words, joined by one space; a feature's bucket is the CRC-32 of
its UTF-8 bytes modulo the number of buckets. No feature is ever written out: each word's CRC is computed once, and the
CRC of a run follows from those of its parts. Over GF(2) the CRC register is linear, so appending ``m`` bytes multiplies
it by the ``m``-th power of a 32 by 32 bit matrix: ``crc(a + b) = M^len(b) crc(a) xor crc(b)``. Powers come by repeated
squaring and are applied through four byte tables, for all runs of a slice of text at once.

The bucket sums of corpus and target (tables of fixed size) give each bucket its gain, the documents' floored mean gains
their weights, and Gumbel noise by a hash of the id a draw without replacement: the highest scores of all eligible
documents. The draw is a sort over range partitions whose counts give each row its rank; nothing but bucket sums
and counts of partitions passes through the driver.

Defined cases: null text has no words (no features, weight 0); a null id is hashed as the empty string and comes last
among ties; rows that repeat are drawn as rows of their own; a word or text of any length is read whole, long texts in
pieces; an empty table gives an empty result, an empty target counts 0 in every bucket; other columns are left alone.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import returning_memory, slices, stage, stage_root, text_of

BUCKETS = 10_000
MOST_WORDS = 2
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
#: Bytes of text that a task works on at once, and bytes of a piece of a longer text.
SLICE = 1 << 21
#: Words up to this many bytes get their CRC column by column, longer ones by themselves.
SHORT = 32
POLYNOMIAL = 0xEDB88320
SPACE = 0x20

_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyz", dtype=np.uint8)] = True
_WORD_BYTE[128:] = True  # every byte of a character beyond ASCII
_NO_WORD = re.compile(rb"[^0-9a-z\x80-\xff]")


# --------------------------------------------------------------------------------------------------------------------
# the algebra


def _times(matrix: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Products of a matrix, given as the images of the 32 single bits, with many vectors."""
    out = np.zeros_like(vectors)
    for bit in range(32):
        out ^= np.where(vectors >> np.uint32(bit) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


@functools.cache
def _doubling(k: int) -> np.ndarray:
    """The matrix that appends 2^k zero bytes to a CRC."""
    if k > 0:
        half = _doubling(k - 1)
        return _times(half, half)
    one_bit = np.array([POLYNOMIAL] + [1 << b for b in range(31)], dtype=np.uint32)
    two = _times(one_bit, one_bit)
    four = _times(two, two)
    return _times(four, four)


@functools.cache
def shift_matrix(n: int) -> np.ndarray:
    """The matrix that appends ``n`` zero bytes to a CRC."""
    out = np.array([1 << b for b in range(32)], dtype=np.uint32)
    for k in range(n.bit_length()):
        if n >> k & 1:
            out = _times(_doubling(k), out)
    return out


@functools.cache
def _tables(n: int) -> np.ndarray:
    """``shift_matrix(n)`` as four tables, one for each byte of a CRC."""
    bytes_ = np.arange(256, dtype=np.uint32)
    return np.stack([_times(shift_matrix(n), bytes_ << np.uint32(8 * k)) for k in range(4)])


@functools.cache
def _all_tables(most: int) -> np.ndarray:
    return np.stack([_tables(n) for n in range(most + 1)])


def shift(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each CRC with its own number of zero bytes appended."""
    short = SHORT + 1
    tables = _all_tables(short)
    n = np.minimum(lengths, short)
    out = np.zeros_like(crcs)
    for k in range(4):
        out ^= tables[n, k, crcs >> np.uint32(8 * k) & np.uint32(255)]
    for i in np.flatnonzero(lengths > short):
        left = int(lengths[i]) - short
        for k in range(left.bit_length()):
            if left >> k & 1:
                out[i] = _times(_doubling(k), out[i : i + 1])[0]
    return out


def combine(first: np.ndarray, second: np.ndarray, second_lengths: np.ndarray) -> np.ndarray:
    """CRCs of concatenations, from those of their parts and the lengths of the second ones."""
    return shift(first, second_lengths) ^ second


# --------------------------------------------------------------------------------------------------------------------
# words and runs of a slice


@functools.cache
def _byte_table() -> np.ndarray:
    return np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], dtype=np.uint32)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begins, ends) of the words of lower-case bytes; a byte that is no word byte stands between two texts."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = _WORD_BYTE[data]
    edges = np.flatnonzero(np.diff(inside))
    return edges[0::2], edges[1::2]


def word_crcs(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each word, all short words in step, one byte of each at a time."""
    lengths = ends - begins
    order = np.argsort(-lengths, kind="stable")  # those that are still open come first
    order = order[np.searchsorted(-lengths[order], -SHORT) :]
    state = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    table, open_ = _byte_table(), lengths[order]
    for k in range(int(open_[0]) if len(order) else 0):
        m = int(np.searchsorted(-open_, -k))  # words of more than k bytes
        state[:m] = table[(state[:m] ^ data[begins[order[:m]] + k]) & np.uint32(255)] ^ state[:m] >> np.uint32(8)
    out = np.empty(len(begins), dtype=np.uint32)
    out[order] = ~state
    for i in np.flatnonzero(lengths > SHORT):
        out[i] = zlib.crc32(data[begins[i] : ends[i]])
    return out


def run_crcs(crcs: np.ndarray, lengths: np.ndarray, owners: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, CRCs) of the runs of 1 to ``n`` words that begin at these places; a run stays within one owner."""
    yield np.arange(len(crcs)), crcs
    space = np.full(len(crcs), zlib.crc32(b" "), dtype=np.uint32)
    spaced = combine(space, crcs, lengths)  # of a space and the word
    now = crcs
    for k in range(1, n):
        if len(crcs) <= k:
            return
        now = combine(now[:-1], spaced[k:], lengths[k:] + 1)
        at = np.flatnonzero(owners[k:] == owners[:-k])
        yield at, now[at]


def pieces_of(text: bytes, most: int) -> Iterator[bytes]:
    """A long text in pieces of about ``most`` bytes, none of which cuts a word."""
    low = 0
    while low < len(text):
        end = _NO_WORD.search(text, low + most)
        high = end.end() if end else len(text)
        yield text[low:high]
        low = high


def text_runs(texts: list[bytes], n: int, most: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, int | None]]:
    """(owners, CRCs, words) of all runs of a few texts at a time: the texts' numbers, the CRCs, and the words when the
    owners are those of runs of one word, else null. A text over ``most`` bytes is taken in pieces, each of which begins
    with the last words of the one before."""
    if len(texts) > 1 or sum(map(len, texts)) <= most:
        data = np.frombuffer(b"".join(t.lower() + b"\n" for t in texts), dtype=np.uint8)
        begins, ends = word_spans(data)
        limits = np.cumsum([len(t) + 1 for t in texts])
        owners = np.searchsorted(limits, begins, side="right")
        lengths = ends - begins
        for k, (at, crcs) in enumerate(run_crcs(word_crcs(data, begins, ends), lengths, owners, n)):
            yield owners[at], crcs, len(at) if k == 0 else None
        return
    kept_crcs, kept_lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    for piece in pieces_of(texts[0].lower(), most):
        data = np.frombuffer(piece, dtype=np.uint8)
        begins, ends = word_spans(data)
        old = len(kept_crcs)
        crcs = np.concatenate([kept_crcs, word_crcs(data, begins, ends)])
        lengths = np.concatenate([kept_lengths, ends - begins])
        for k, (at, found) in enumerate(run_crcs(crcs, lengths, np.zeros(len(crcs), np.int8), n)):
            new = at + k >= old  # runs that end in this piece
            yield np.zeros(int(new.sum()), np.int64), found[new], int(new.sum()) if k == 0 else None
        if n > 1:
            kept_crcs, kept_lengths = crcs[-(n - 1) :], lengths[-(n - 1) :]


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


# --------------------------------------------------------------------------------------------------------------------
# Spark


def bucket_counts(texts: DataFrame, n: int = MOST_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of a table of texts: each task sums over all its rows and gives at most one row a bucket."""
    stage_root(texts.sparkSession)  # sends the package before a function of it is made

    def count(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                for _, crcs, _ in text_runs(_bytes(part.column("text")), n):
                    total += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    found = texts.select(text_of(texts).alias("text")).mapInArrow(returning_memory(count), "bucket long, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) of each bucket; at most ``buckets`` rows of either side are collected."""
    table = (
        corpus.withColumn("side", F.lit(0)).unionByName(target.withColumn("side", F.lit(1)))
        .groupBy("bucket").agg(*[F.sum(F.when(F.col("side") == k, F.col("n")).otherwise(0)).alias(c) for k, c in enumerate("st")])
    )
    both = np.zeros((2, buckets))
    for r in table.collect():
        both[:, r["bucket"]] = r["s"], r["t"]
    s, t = both
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def document_weights(docs: DataFrame, gains: np.ndarray, n: int = MOST_WORDS) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document."""
    stage_root(docs.sparkSession)
    buckets = len(gains)

    def weigh(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                rows = part.num_rows
                words, runs, sums = (np.zeros(rows, dtype=np.int64) for _ in range(3))
                for owners, crcs, of_words in text_runs(_bytes(part.column("text")), n):
                    count = np.bincount(owners, minlength=rows)
                    runs += count
                    if of_words is not None:
                        words += count
                    np.add.at(sums, owners, gains[crcs % np.uint32(buckets)])
                weights = np.where(runs > 0, sums // np.maximum(runs, 1), 0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(words), pa.array(runs), pa.array(weights)],
                    names=["doc_id", "n_words", "n_features", "weight"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(docs["doc_id"], text_of(docs).alias("text")).mapInArrow(
        returning_memory(weigh), f"doc_id {kind}, n_words long, n_features long, weight long"
    )


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, by the id alone."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, order: list[Column], rank: str) -> DataFrame:
    """``rows`` with their place (from 1) in a global order: sorted over range partitions, whose counts give each its
    offset. Ids of a range partition are its number and the row's place in it."""
    placed = stage(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()), "ranked"
    )
    part = F.shiftright("id", 33)
    runs = placed.groupBy(part.alias("part")).agg(F.min("id").alias("begin"), F.count(F.lit(1)).alias("n"))
    # One row for each partition of the sort.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), "begin")
    joined = placed.join(F.broadcast(runs), part == F.col("part"))
    return joined.withColumn(rank, F.col("offset") + F.col("id") - F.col("begin") + 1).drop("id", "part", "offset", "begin")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    n: int = MOST_WORDS,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (null where it is not drawn)."""
    gains = bucket_gains(bucket_counts(docs, n, buckets), bucket_counts(target, n, buckets), buckets)
    scored = stage(
        document_weights(docs, gains, n).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "weighed"
    )
    can = F.col("n_words") >= least_words
    drawn = scored.filter(can).count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    # Sorted are only the scores that can be drawn: those from the last one drawn upwards.
    counts = scored.filter(can).groupBy("score").count()  # scores are whole numbers of a few tens of thousands
    above = Window.orderBy(F.col("score").desc())
    last = counts.withColumn("upto", F.sum("count").over(above)).filter(F.col("upto") >= drawn).agg(F.max("score")).first()[0]
    top = can & (F.col("score") >= F.lit(last if drawn else None).cast("long"))
    top = F.coalesce(top, F.lit(False))
    high = ranked(scored.filter(top), order, "place")
    rank = F.when(F.col("place") <= drawn, F.col("place"))
    columns = ["doc_id", "n_features", "weight", "score"]
    return high.select(*columns, rank.cast("long").alias("rank")).unionByName(
        scored.filter(~top).select(*columns, F.lit(None).cast("long").alias("rank"))
    )

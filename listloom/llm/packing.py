"""Best-fit packing with bound-certified repacking.

Documents become token ids, then an end id; only documents longer than the window are cut. Pieces are dealt evenly over
partitions by a hash, and each partition is packed best-fit decreasing. Dual-feasible functions give a lower bound on
the sequences that any packing needs: each partition's own pieces certify its count, and a histogram of all lengths
certifies the whole. A partition at its bound is done. One with a gap releases the pieces of its loosest sequences; what
partitions with gaps release meets in fewer partitions and is packed best-fit decreasing again. Rounds end when the whole
is at its bound, when no partition has a gap, or when one saves nothing (it is not applied then); bounds and counts are
columns of the result, so a gap that is left shows.

Defined cases: null text is empty text and packs as the end id alone; rows that repeat are packed once each; an empty
table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listloom.session import ship

from .common import returning_memory, slices, stage, text_of, with_row_id

WINDOW = 4096
END_ID = 1
#: Pieces a partition of the packing holds; sequences a partition with a gap releases a round; rounds at most.
PIECES_PER_PARTITION = 60_000
RELEASED_PER_PARTITION = 512
ROUNDS = 6
#: Text that one call of the tokenizer takes: more finds more words twice, less needs less memory.
SLICE_BYTES = 8 << 20
#: Words of a kind whose ids a worker remembers; when there are more, it begins anew.
KNOWN_WORDS = 1_000_000


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a byte as the letter itself where it is printable in Latin-1, else as U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(256 + k) for k, b in enumerate(rest)} | {32: " "}


def _gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs pool[start : start + length] one after another, and where each begins (with the end)."""
    at = np.concatenate([[0], np.cumsum(lengths)])
    kind = np.int32 if max(at[-1], len(pool)) < 1 << 31 else np.int64  # half the memory, save for enormous rows
    index = np.repeat((starts - at[:-1]).astype(kind), lengths)
    index += np.arange(at[-1], dtype=kind)
    return pool[index], at


class KnownWords:
    """Ids of words, each encoded when it is met first; ``encode(words)`` gives the ids one after another and where each
    word's begin (with the end)."""

    def __init__(self, encode: Callable, most: int = KNOWN_WORDS):
        self.encode, self.most = encode, most
        self.forget()

    def forget(self) -> None:
        self.words, self.ids, self.at = pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def places(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each of some distinct words begin in ``ids``, and how many they are."""
        k = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        if (k < 0).any() and len(self.words) + (k < 0).sum() > self.most:
            self.forget()
            k[:] = -1
        new = np.flatnonzero(k < 0)
        if len(new):
            k[new] = len(self.words) + np.arange(len(new))
            fresh = words.take(pa.array(new))
            ids, at = self.encode(fresh)
            self.at = np.concatenate([self.at, self.at[-1] + at[1:]])
            self.ids, self.words = np.concatenate([self.ids, ids]), pa.concat_arrays([self.words, fresh])
        return self.at[k], self.at[k + 1] - self.at[k]


class WordTokenizer:
    """Ids of a word-end BPE tokenizer that never joins characters across white space: each distinct word is encoded
    once, and remembered.

    Words of Latin-1 letters, also with one mark of punctuation after them, need neither normalisation nor splitting:
    they go many at a time through the bare BPE model, and the ids that end a word part them. All other words go through
    the tokenizer as it stands, many at a time, parted by their offsets.
    """

    MARKS = ".,;:!?"
    PLAIN = "^[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
    CHUNK = 20_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"].get("end_of_word_suffix") != "</w>":
            raise ValueError("a BPE tokenizer with word ends is needed")
        spec |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "WhitespaceSplit"}}
        self.plain = Tokenizer.from_str(json.dumps(spec))
        vocab = spec["model"]["vocab"]
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.letters = np.arange(256, dtype="<u4")
        for byte, letter in _byte_letters().items():
            self.letters[byte] = ord(letter)
        self.marks = self._any(pa.array([*self.MARKS]))
        self.known_bare, self.known_any, self.call = KnownWords(self._bare), KnownWords(self._any), ""

    def serving(self, call: str, most: int = KNOWN_WORDS) -> WordTokenizer:
        """Itself; words that another call met are forgotten, so that no run owes its time to those before it."""
        if call != self.call:
            self.call = call
            for known in (self.known_bare, self.known_any):
                known.most = most
                known.forget()
        return self

    def _any(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and where each word's begin (with the end)."""
        out, at, total = [], [0], 0
        for low in range(0, len(words), self.CHUNK):
            part = words[low : low + self.CHUNK].to_pylist()
            ends = np.cumsum([len(w) + 1 for w in part])
            got = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            starts = np.array([a for a, _ in got.offsets], dtype=np.int64)
            out.append(np.array(got.ids, dtype="<u4"))
            begin = np.searchsorted(np.searchsorted(ends, starts, side="right"), np.arange(1, len(part) + 1))
            at += (total + begin).tolist()
            total += len(out[-1])
        return np.concatenate([np.zeros(0, "<u4"), *out]), np.array(at, dtype=np.int64)

    def _bare(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``_any``, for lower-case words of Latin-1 letters."""
        out = []
        for low in range(0, len(words), self.CHUNK):
            spelled = " ".join(words[low : low + self.CHUNK].to_pylist())
            if not spelled.isascii():
                spelled = self.letters[np.frombuffer(spelled.encode(), np.uint8)].tobytes().decode("utf-32-le")
            out.append(np.array(self.plain.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, dtype="<u4"))
        ids = np.concatenate([np.zeros(0, "<u4"), *out])
        at = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
        assert len(at) == len(words) + 1
        return ids, at

    def _vocabulary(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        core = pc.utf8_rtrim(words, characters=self.MARKS)
        size = pc.utf8_length(words).to_numpy(zero_copy_only=False)
        mark = size - pc.utf8_length(core).to_numpy(zero_copy_only=False)
        plain = pc.match_substring_regex(core, self.PLAIN).to_numpy(zero_copy_only=False) & (mark <= 1)
        cores = pc.utf8_lower(core.filter(pa.array(plain))).dictionary_encode()
        bare_starts, bare_lengths = self.known_bare.places(cores.dictionary)
        any_starts, any_lengths = self.known_any.places(words.filter(pa.array(~plain)))
        bare_ids, any_ids = self.known_bare.ids, self.known_any.ids
        pool = np.concatenate([bare_ids, any_ids, self.marks[0]])
        starts, lengths = np.zeros(2 * len(words), np.int64), np.zeros(2 * len(words), np.int64)
        k = cores.indices.to_numpy()
        rows = np.flatnonzero(plain)
        starts[2 * rows], lengths[2 * rows] = bare_starts[k], bare_lengths[k]
        rest = np.flatnonzero(~plain)
        starts[2 * rest], lengths[2 * rest] = len(bare_ids) + any_starts, any_lengths
        marked = np.flatnonzero(plain & (mark == 1))
        last = pc.utf8_slice_codeunits(words.take(pa.array(marked)), -1)
        m = pc.index_in(last, value_set=pa.array([*self.MARKS])).to_numpy(zero_copy_only=False).astype(np.int64)
        starts[2 * marked + 1] = len(bare_ids) + len(any_ids) + self.marks[1][m]
        lengths[2 * marked + 1] = np.diff(self.marks[1])[m]
        ids, at = _gather(pool, starts, lengths)
        return ids, at[::2]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin (with the end)."""
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        ids, at = self._vocabulary(words.dictionary)
        which = words.indices.to_numpy()
        out, begins = _gather(ids, at[which], np.diff(at)[which])
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        return out, begins[np.concatenate([[0], ends])]


@lru_cache(maxsize=1)
def word_tokenizer(path: str) -> WordTokenizer:
    """A worker's tokenizer, which lives on between its tasks."""
    return WordTokenizer(path)


def tokenize_pieces(
    docs: DataFrame,
    tokenizer_path: str,
    window: int = WINDOW,
    end_id: int = END_ID,
    slice_bytes: int = SLICE_BYTES,
    known_words: int = KNOWN_WORDS,
) -> DataFrame:
    """(doc_id, piece, start, length, ids) with ``ids`` the little-endian unsigned 32-bit ids of the piece."""
    ship(docs.sparkSession)
    end, call = int(end_id).to_bytes(4, "little"), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokenizer(tokenizer_path).serving(call, known_words)
        for batch in batches:
            for part in slices(batch, "text", slice_bytes):
                rows, piece, length, cuts = [], [], [], []
                flat, begins = words.encode(part.column("text"))
                raw, begins = flat.tobytes(), (4 * begins).tolist()
                for i in range(part.num_rows):
                    ids = raw[begins[i] : begins[i + 1]] + end
                    for k in range(0, len(ids), 4 * window):
                        cuts.append(ids[k : k + 4 * window])
                        rows.append(i)
                        piece.append(k // (4 * window))
                        length.append(len(cuts[-1]) // 4)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(rows)),
                        pa.array(piece, pa.int32()),
                        pa.array([window * k for k in piece], pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(cuts, pa.binary()),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(docs["doc_id"], text_of(docs).alias("text")).mapInArrow(
        returning_memory(run), f"doc_id {kind}, piece int, start long, length long, ids binary"
    )


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each item: longest first, each into the fullest sequence that still holds it."""
    bins = np.empty(len(lengths), dtype=np.int64)
    offsets = np.empty(len(lengths), dtype=np.int64)
    open_by_room: list[list[int]] = [[] for _ in range(window + 1)]
    rooms = 0  # bit r is set when a sequence with room r is open
    count = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            stack = open_by_room[room]
            b = stack.pop()
            if not stack:
                rooms ^= 1 << room
        else:
            room, b = window, count
            count += 1
        bins[i], offsets[i] = b, window - room
        if room > n:
            if not open_by_room[room - n]:
                rooms |= 1 << (room - n)
            open_by_room[room - n].append(b)
    return bins, offsets


def lower_bound(histogram: np.ndarray) -> int:
    """Sequences that any packing needs, from ``histogram[n]``, the number of pieces of each length 0 .. window.

    The best of three families of dual-feasible functions, in exact integers. Identity: x / window. For each threshold t
    up to half a window: items over window - t count 1, items under t count 0, the rest x / window. For k = 1 .. 8:
    floor((k + 1) x / window) / k, and x / window where (k + 1) x is a multiple of the window.
    """
    window = len(histogram) - 1
    count = histogram.astype(np.int64)
    x = np.arange(window + 1, dtype=np.int64)
    number, filled = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * x)])
    t = np.arange(1, window // 2 + 1)
    # Entry n of the running sums stands for lengths under n.
    over = window * (number[-1] - number[window - t + 1])
    sums = [int(filled[-1]), *(over + filled[window - t + 1] - filled[t]).tolist()]
    best = max(-(-v // window) for v in sums)
    for k in range(1, 9):
        scaled = (k + 1) * x
        units = np.where(scaled % window == 0, k * x, window * (scaled // window))
        best = max(best, -(-int(count @ units) // (k * window)))
    return best


def _packer(window: int, round_no: int, released: int, columns: list[str]) -> Callable:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        # Ties are settled by the row id, so that a repeated task packs alike.
        table = table.take(pc.sort_indices(table, [("length", "descending"), ("uid", "ascending")]))
        lengths = table.column("length").to_numpy()
        bins, offsets = best_fit_decreasing(lengths, window)
        fill = np.bincount(bins, weights=lengths).astype(np.int64)
        bound = lower_bound(np.bincount(lengths, minlength=window + 1))
        # A partition at its bound is certified and keeps all it has; one with a gap gives its loosest sequences away.
        loose = np.argsort(fill, kind="stable")[: released if len(fill) > bound else 0]
        loose = loose[fill[loose] < window]
        # A sequence number holds its round, its partition and its place there.
        sequence = (round_no << 56) | (key[0].as_py() << 18) | bins
        whole = lambda n: pa.array(np.full(len(lengths), n), pa.int64())
        return (
            table.select(columns)
            .append_column("sequence_id", pa.array(sequence, pa.int64()))
            .append_column("offset", pa.array(offsets, pa.int64()))
            .append_column("partition_sequences", whole(len(fill)))
            .append_column("partition_bound", whole(bound))
            .append_column("loose", pa.array(np.isin(bins, loose)))
            .append_column("opens", pa.array(offsets == 0))
        )

    return run


def place_pieces(
    pieces: DataFrame,
    window: int = WINDOW,
    per_partition: int = PIECES_PER_PARTITION,
    released: int = RELEASED_PER_PARTITION,
    rounds: int = ROUNDS,
    report: list | None = None,
) -> DataFrame:
    """``pieces(doc_id, piece, length, ...)`` with sequence_id and offset added, and the certificates: partition_sequences
    and partition_bound of the partition that packed the piece last, sequences and sequences_bound of the whole; where
    they differ, that many sequences at most could be saved. Other columns are carried along.

    ``report`` gets one dict a round: sequences and certified lower bound of the whole, partitions, and how many of
    these have a gap.
    """
    columns = pieces.columns
    rows = stage(with_row_id(pieces, "uid"), "pieces")
    # At most ``window`` rows, whatever the table's size.
    lengths = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    histogram = np.zeros(window + 1, np.int64)
    histogram[list(lengths)] = list(lengths.values())
    bound, count = lower_bound(histogram), int(histogram.sum())
    carried = [*columns, "uid"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    schema += ", sequence_id long, offset long, partition_sequences long, partition_bound long, loose boolean, opens boolean"

    def packed(frame: DataFrame, count: int, round_no: int) -> DataFrame:
        parts = max(1, -(-count // per_partition))
        dealt = frame.withColumn("part", F.pmod(F.xxhash64("uid", F.lit(round_no)), F.lit(parts)))
        done = dealt.groupBy("part").applyInArrow(_packer(window, round_no, released, carried), schema)
        return stage(done, f"packed{round_no}")

    settled: list[DataFrame] = []
    now = packed(rows, count, 0)
    kept_sequences = 0
    for round_no in range(1, rounds + 2):
        first = F.col("opens") & (F.col("sequence_id").bitwiseAND((1 << 18) - 1) == 0)
        got = now.agg(
            F.count_if("opens").alias("bins"),
            F.count_if(F.col("opens") & F.col("loose")).alias("loose"),
            F.count_if("loose").alias("pieces"),
            F.count_if(first).alias("parts"),
            F.count_if(first & (F.col("partition_sequences") > F.col("partition_bound"))).alias("gaps"),
        ).first()
        total = kept_sequences + got["bins"]
        if report is not None:
            report.append(
                {"round": round_no - 1, "sequences": total, "bound": bound, "parts": got["parts"], "gaps": got["gaps"]}
            )
        if total <= bound or got["loose"] < 2 or round_no > rounds:
            break
        again = packed(now.filter("loose").select(*carried), got["pieces"], round_no)
        after = again.filter("opens").count()
        if after >= got["loose"]:
            break
        settled.append(now.filter("not loose"))
        kept_sequences += got["bins"] - got["loose"]
        now = again
    for frame in settled:
        now = now.unionByName(frame)
    return now.select(
        *columns, "sequence_id", "offset", "partition_sequences", "partition_bound",
        F.lit(total).cast("long").alias("sequences"), F.lit(bound).cast("long").alias("sequences_bound"),
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, **options) -> DataFrame:
    """Pieces of all documents with their token ids, sequence and offset."""
    return place_pieces(tokenize_pieces(docs, tokenizer_path, window), window, **options)

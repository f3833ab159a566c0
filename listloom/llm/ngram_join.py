"""N-gram Jaccard join as a blocked sparse matrix product of the document by n-gram incidence.

A document's row is its set of n-gram hashes; documents with equal sets are one class and share a row. One pass gives
every document its class, and these rows are staged where they are: no document is ever dealt by its class. A second pass
gives the incidence of the classes, dealt over column blocks (ranges of hashes) as binary runs, so that one task sees all
entries of its columns: columns of one class overlap with nothing and go, the others get their document frequency. Columns
that fill a good part of a block by themselves are found beforehand on a hash sample of the classes; they count as the
most frequent, bypass the column blocks, and so meet nowhere. Dealt back over row blocks, a class whose remaining columns
are fewer than the threshold's share of its set cannot have a partner (size-derived bound) and goes too. For the others,
ordered by frequency, the first |x| - ceil(t |x|) + 1 columns must meet a partner's; classes that share one are
candidates, and candidates are tied by one star for each column, never by all pairs.

Overlaps are then accumulated by products of dense row blocks, one slice of columns after another, inside each group of
candidates: small groups whole, large ones by pairs of row blocks that share a column of a prefix and whose set sizes
allow a link. Rows of a large group are first held against a few hubs, one at a time; what one hub is linked to
needs no comparison among itself. The others are dealt to blocks of bounded size by their rarest column, so that what is
alike lies together and few pairs of blocks meet. A block product returns a spanning forest of its links, not the pairs.
Components follow by contraction. Labels reach the documents by a join on the class; the at most ``HEAVY`` classes with
the most copies are broadcast for it.

Classes are told apart by two 64-bit hashes of their sets: where the first ones collide, the second takes its place.
N-grams are told apart by 64 bits, which two documents of a million n-grams confuse with a chance of 1 in 10^7.

Defined cases: null text is empty text; a document without words has an empty set and no links, not even to its copies;
with fewer words than n the whole sequence is one n-gram; rows that repeat are linked as copies; a null doc_id takes
part but never names a component unless all its members are null; ids keep their type; an empty table gives an empty
result; other columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listloom.session import ship

from .common import broadcast_if_small, connected_components, free_name, returning_memory, slices, stage, text_of

WORDS = 5
#: Linked when DENOMINATOR * overlap >= NUMERATOR * union.
NUMERATOR, DENOMINATOR = 80, 100
#: Input bytes a column block stands for; bytes that one step of a map task reads; entries it holds before it deals them out.
BLOCK_BYTES = 8 << 20
SLICE_BYTES = 2 << 20
FLUSH = 400_000
#: Largest candidate group that is multiplied whole; rows of a block in larger groups; columns of a slice.
GROUP_ROWS = 512
BLOCK_ROWS = 256
SLICE_COLUMNS = 2048
#: Of so many column blocks' worth of classes the sample for frequent columns is made; most frequent columns set aside.
SAMPLE_BLOCKS = 2
SET_ASIDE = 1 << 16
#: Classes with the most copies whose labels are broadcast.
HEAVY = 1000
#: Rounds in which rows of a large group are held against one hub of it.
HUB_ROUNDS = 3

_MUL = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


def _mix(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    h = (h ^ w) * _MUL
    return h ^ (h >> _SHIFT)


def shingle_sets(texts: pa.Array, n: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit n-gram hashes of each text, over words in lower case (A-Z only)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = lists.flatten().dictionary_encode()
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in words.dictionary.to_pylist()], dtype=np.uint64)
    flat = hashes[words.indices.to_numpy()] if len(hashes) else np.zeros(0, np.uint64)
    # Splitting gives empty words at the ends of a text.
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    empty = np.uint64(xxhash.xxh64_intdigest(""))
    real = flat != empty
    ends = np.concatenate([[0], np.cumsum(real)])[ends] if len(ends) else ends
    flat = flat[real]
    rolled = np.zeros(max(0, len(flat) - n + 1), np.uint64)
    for k in range(n):
        rolled = _mix(rolled, flat[k : k + len(rolled)])
    out, begin = [], 0
    for end in ends.tolist():
        if end - begin >= n:
            out.append(np.unique(rolled[begin : end - n + 1]))
        elif end > begin:
            h = np.array([end - begin], np.uint64)
            for k in range(begin, end):
                h = _mix(h, flat[k : k + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
        begin = end
    return out


def _signed(values: list[int]) -> list[int]:
    return [v - (1 << 64) if v >> 63 else v for v in values]


_ROWS = pa.schema(
    [
        ("bucket", pa.int32()),
        ("tokens", pa.binary()),
        ("classes", pa.binary()),
        ("counts", pa.binary()),
        ("dfs", pa.binary()),
    ]
)
#: Rows without tokens tell the classes' sizes: ``counts`` holds these.
ROWS = "bucket int, tokens binary, classes binary, counts binary, dfs binary"
MOST_FREQUENT = np.uint32(0xFFFFFFFF)


def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for low in range(0, len(rows), 64):
        part = rows[low : low + 64]
        yield pa.RecordBatch.from_pydict(dict(zip(_ROWS.names, map(list, zip(*part)))), schema=_ROWS)


def _runs(sorted_values: np.ndarray) -> Iterator[tuple[int, int]]:
    if len(sorted_values):
        cuts = (np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1).tolist()
        yield from zip([0, *cuts], [*cuts, len(sorted_values)])


def _dealt(
    bucket: np.ndarray, tokens: np.ndarray, classes: np.ndarray, dfs: np.ndarray | None
) -> Iterator[pa.RecordBatch]:
    """Entries as one row a bucket: tokens ordered by class, each class once with its number of tokens."""
    order = np.lexsort((classes, bucket))
    bucket, tokens, classes = bucket[order], tokens[order], classes[order]
    dfs = dfs[order] if dfs is not None else None
    rows = []
    for lo, hi in _runs(bucket):
        own = classes[lo:hi]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        counts = np.diff(np.concatenate([first, [hi - lo]])).astype(np.uint32)
        rows.append(
            (int(bucket[lo]), tokens[lo:hi].tobytes(), own[first].tobytes(), counts.tobytes(),
             None if dfs is None else dfs[lo:hi].tobytes())
        )
    yield from _batches(rows)


def _sized(bucket: np.ndarray, classes: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The sizes of classes as one row a bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, classes, sizes = bucket[order], classes[order], sizes[order].astype(np.uint32)
    yield from _batches(
        [(int(bucket[lo]), None, classes[lo:hi].tobytes(), sizes[lo:hi].tobytes(), None) for lo, hi in _runs(bucket)]
    )


def _class(tokens: np.ndarray, bits: int = 64) -> tuple[int | None, int | None]:
    """Two independent hashes of a set, of ``bits`` and 64 bits; none for the empty one."""
    if not len(tokens):
        return None, None
    both = xxhash.xxh3_128_intdigest(tokens.tobytes())
    return both & ((1 << bits) - 1), both >> 64


def _document_rows(n: int, sampled: int, bits: int) -> Callable:
    """Texts to document rows; classes of the hash sample bring their columns, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES, 20_000):
                found = shingle_sets(part.column("text"), n)
                classes = [_class(x, bits) for x in found]
                sample: list[np.ndarray | None] = []
                for x, (k, _) in zip(found, classes):
                    new = k is not None and k % sampled == 0 and k not in met
                    if new and len(met) < 1_000_000:
                        met.add(k)
                    sample.append(x.view(np.int64) if new else None)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("key"),
                        *(pa.array([None if v is None else _signed([v])[0] for v in c], pa.int64()) for c in zip(*classes)),
                        pa.array([len(x) for x in found], pa.int64()),
                        pa.array(sample, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "key", "klass", "other", "n", "sample"],
                )

    return run


def _incidence(
    n: int, blocks: int, row_blocks: int, aside: np.ndarray, collided: frozenset[int], bits: int
) -> Callable:
    """Texts to entries dealt over column blocks, and classes' sizes; within a task a class gives both once. Columns set
    aside go to the blocks after the last, by class."""

    def deal(sets: list[np.ndarray], names: list[int]) -> Iterator[pa.RecordBatch]:
        tokens = np.concatenate(sets)
        name = np.array(names, np.uint64)
        sizes = np.array([len(s) for s in sets])
        classes = np.repeat(name, sizes)
        bucket = ((tokens >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int32)
        if len(aside):
            at = np.minimum(np.searchsorted(aside, tokens), len(aside) - 1)
            bucket = np.where(aside[at] == tokens, blocks + _row_block(classes, row_blocks), bucket)
        yield from _dealt(bucket, tokens, classes, None)
        yield from _sized(blocks + _row_block(name, row_blocks), name, sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        sets: list[np.ndarray] = []
        names: list[int] = []
        held = 0
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES, 20_000):
                for s in shingle_sets(part.column("text"), n):
                    k, other = _class(s, bits)
                    if k in collided:
                        k = other
                    if k is not None and k not in met:
                        if len(met) > 1_000_000:
                            met.clear()
                        met.add(k)
                        sets.append(s)
                        names.append(k)
                        held += len(s)
                        if held >= FLUSH:
                            yield from deal(sets, names)
                            sets, names, held = [], [], 0
        if sets:
            yield from deal(sets, names)

    return run


def _row_block(classes: np.ndarray, row_blocks: int) -> np.ndarray:
    return (classes % np.uint64(row_blocks)).astype(np.int32)


_KINDS = {"tokens": np.uint64, "classes": np.uint64, "counts": np.uint32, "dfs": np.uint32}


def _gather(batch: pa.RecordBatch, held: dict[str, list[np.ndarray]]) -> None:
    for name, kind in _KINDS.items():
        for raw in batch.column(name).to_pylist():
            if raw is not None:
                held.setdefault(name, []).append(np.frombuffer(raw, kind))


def _frequencies(blocks: int, row_blocks: int) -> Callable:
    """One column block: entries of columns with one class go; the others, with frequencies, are dealt to row blocks. The
    blocks after the last hold what was set aside and the sizes; their rows pass, one batch after another."""

    def passed(batch: pa.RecordBatch) -> pa.RecordBatch:
        bucket = pc.subtract(batch.column("bucket"), pa.scalar(blocks, pa.int32()))
        dfs = [
            None if raw is None else np.full(len(raw) // 8, MOST_FREQUENT).tobytes()
            for raw in batch.column("tokens").to_pylist()
        ]
        return batch.set_column(0, "bucket", bucket).set_column(4, "dfs", pa.array(dfs, pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            extra = pc.greater_equal(batch.column("bucket"), pa.scalar(blocks, pa.int32()))
            beyond = batch.filter(extra)
            if beyond.num_rows:
                yield passed(beyond)
            _gather(batch.filter(pc.invert(extra)), held)
        if not held:
            return
        tokens = np.concatenate(held["tokens"])
        classes = np.repeat(np.concatenate(held["classes"]), np.concatenate(held["counts"]))
        held.clear()
        order = np.argsort(tokens)
        tokens = tokens[order]
        same = tokens[1:] == tokens[:-1]
        met = np.zeros(len(tokens), bool)
        met[1:] |= same
        met[:-1] |= same
        tokens, classes = tokens[met], classes[order[met]]
        order = np.lexsort((classes, tokens))
        tokens, classes = tokens[order], classes[order]
        new = np.ones(len(tokens), bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (classes[1:] != classes[:-1])
        tokens, classes = tokens[new], classes[new]
        if not len(tokens):
            return
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        df = np.diff(np.concatenate([first, [len(tokens)]]))
        df = np.repeat(df, df).astype(np.uint32)
        shared = df > 1
        tokens, classes, df = tokens[shared], classes[shared], df[shared]
        if len(tokens):
            yield from _dealt(_row_block(classes, row_blocks), tokens, classes, df)

    return run


_KEPT = pa.schema(
    [("klass", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary()), ("prefix", pa.list_(pa.int64()))]
)
KEPT = "klass long, n long, tokens binary, prefix array<long>"


def _least(n, numerator: int, denominator: int):
    """Smallest overlap that a set of n can have with a partner."""
    return -(-numerator * n // denominator)


def _rows(numerator: int, denominator: int) -> Callable:
    """One row block: the classes that can have a partner with their shared columns, rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        told: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            entry = batch.column("tokens").is_valid()
            _gather(batch.filter(entry), held)
            _gather(batch.filter(pc.invert(entry)), told)
        if not held:
            return
        size_of, size = np.concatenate(told["classes"]), np.concatenate(told["counts"])
        order = np.argsort(size_of, kind="stable")
        size_of, size = size_of[order], size[order]
        tokens, df = np.concatenate(held["tokens"]), np.concatenate(held["dfs"])
        classes = np.repeat(np.concatenate(held["classes"]), np.concatenate(held["counts"]))
        held.clear()
        order = np.lexsort((tokens, df, classes))
        tokens, classes = tokens[order], classes[order]
        # A class that several tasks met brings what was set aside once from each.
        new = np.ones(len(tokens), bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (classes[1:] != classes[:-1])
        tokens, classes = tokens[new], classes[new]
        out = []
        for lo, hi in _runs(classes):
            k = int(classes[lo])
            n = int(size[np.searchsorted(size_of, classes[lo])])
            least = _least(n, numerator, denominator)
            if hi - lo >= least:
                # The first columns in the order are those of this class alone; they are not stored.
                prefix = n - least + 1 - (n - (hi - lo))
                own = tokens[lo:hi]
                out.append((_signed([k])[0], n, own.tobytes(), own[:prefix].view(np.int64)))
            if len(out) >= 500:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _KEPT)], schema=_KEPT)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _KEPT)], schema=_KEPT)

    return run


def block_overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Overlap counts of all rows of a block, accumulated over slices of columns."""
    m = len(sets)
    flat = np.concatenate(sets)
    rows = np.repeat(np.arange(m), [len(s) for s in sets])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    rows, column = rows[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    total = int(shared.sum())
    out = np.zeros((m, m), np.float32)
    for low in range(0, total, SLICE_COLUMNS):
        lo, hi = np.searchsorted(column, [low, low + SLICE_COLUMNS])
        x = np.zeros((m, min(SLICE_COLUMNS, total - low)), np.float32)
        x[rows[lo:hi], column[lo:hi] - low] = 1
        out += x @ x.T
    return out.astype(np.int64)


def linked(sizes: np.ndarray, overlaps: np.ndarray, numerator: int, denominator: int) -> np.ndarray:
    """Which pairs of a block reach the threshold; the diagonal is cleared."""
    union = sizes[:, None] + sizes[None, :] - overlaps
    out = denominator * overlaps >= numerator * union
    np.fill_diagonal(out, False)
    return out


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric link matrix."""
    left = np.ones(len(links), bool)
    edges = []
    for root in range(len(links)):
        if not left[root]:
            continue
        left[root] = False
        stack = [root]
        while stack:
            i = stack.pop()
            new = np.flatnonzero(links[i] & left)
            left[new] = False
            edges += [(i, int(j)) for j in new]
            stack += new.tolist()
    return edges


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _link_table(names: np.ndarray, edges: list[tuple[int, int]]) -> pa.Table:
    a, b = (names[[e[k] for e in edges]] if edges else names[:0] for k in (0, 1))
    return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_LINKS)


def _small_groups(numerator: int, denominator: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("root", "ascending"), ("klass", "ascending")])
        roots, names = table.column("root").to_numpy(), table.column("klass").to_numpy()
        sizes = table.column("n").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()]
        first = np.flatnonzero(np.concatenate([[True], roots[1:] != roots[:-1]])).tolist()
        edges = []
        for lo, hi in zip(first, [*first[1:], len(roots)]):
            own = linked(sizes[lo:hi], block_overlaps(sets[lo:hi]), numerator, denominator)
            edges += [(lo + a, lo + b) for a, b in forest(own)]
        return _link_table(names, edges)

    return run


def _block_pairs(numerator: int, denominator: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        names, sizes = table.column("klass").to_numpy(), table.column("n").to_numpy()
        side = table.column("side").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()]
        own = linked(sizes, block_overlaps(sets), numerator, denominator)
        if side.any():
            own &= side[:, None] != side[None, :]
        return _link_table(names, forest(own))

    return run


def _hub_links(numerator: int, denominator: int) -> Callable:
    """Rows with their group's hub of this round beside them: those that it links to, and itself, get it as theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = (batch.column(c).to_pylist() for c in ("hub", "n", "tokens", "new_hub", "hub_n", "hub_tokens"))
            out = []
            for hub, n, own, new, m, other in zip(*rows):
                if hub is None and new is not None and denominator * min(n, m) >= numerator * max(n, m):
                    k = len(np.intersect1d(np.frombuffer(own, np.uint64), np.frombuffer(other, np.uint64), assume_unique=True))
                    hub = new if denominator * k >= numerator * (n + m - k) else None
                out.append(hub)
            kept = [batch.column(c) for c in ("root", "klass", "n", "tokens", "prefix")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(out, pa.int64())], names=["root", "klass", "n", "tokens", "prefix", "hub"]
            )

    return run


def with_hubs(large: DataFrame, numerator: int, denominator: int, rounds: int = HUB_ROUNDS) -> DataFrame:
    """Rows of large groups with ``hub``, a class of the group that they are linked to, or null. A round takes one class of
    each group that has no hub yet and holds it against all others without one; so a group of near copies, however
    large, is tied by comparisons in proportion to its rows."""
    rows = large.withColumn("hub", F.lit(None).cast("long"))
    for k in range(rounds):
        free = rows.filter("hub is null")
        pick = free.groupBy("root").agg(F.min(F.struct(F.xxhash64("klass", F.lit(k)).alias("h"), "klass"))["klass"].alias("new_hub"))
        body = large.select(F.col("klass").alias("new_hub"), F.col("n").alias("hub_n"), F.col("tokens").alias("hub_tokens"))
        hubs = stage(body.join(pick, "new_hub"), "hubs")
        beside = rows.join(broadcast_if_small(hubs, 2000), "root", "left")
        rows = stage(
            beside.mapInArrow(
                returning_memory(_hub_links(numerator, denominator)),
                "root long, klass long, n long, tokens binary, prefix array<long>, hub long",
            ),
            "hubbed",
        )
    return rows


def column_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """Column blocks for the input's size, from file statistics where there are any, else from its rows."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > 1 << 50:
        size = docs.count() * 2000
    return max(8, min(1 << 20, -(-size // block_bytes)))


def document_rows(docs: DataFrame, n: int = WORDS, block_bytes: int = BLOCK_BYTES, class_bits: int = 64) -> DataFrame:
    """Staged: doc_id, key (hash of the text), klass and other (two hashes of the set, null without words), n (its size),
    sample (the columns of sampled classes)."""
    ship(docs.sparkSession)
    sampled = max(1, min(4096, column_blocks(docs, block_bytes) // SAMPLE_BLOCKS))
    text = text_of(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(docs["doc_id"], F.xxhash64(text).alias("key"), text.alias("text")).mapInArrow(
        returning_memory(_document_rows(n, sampled, class_bits)),
        f"doc_id {kind}, key long, klass long, other long, n long, sample array<long>",
    )
    return stage(rows, "ngram-documents")


def frequent_columns(documents: DataFrame, blocks: int, most: int = SET_ASIDE) -> np.ndarray:
    """Columns that fill over a quarter of a column block by the sample's estimate, sorted: at most ``most``, the most
    frequent. Which they are changes the work's balance only, never the result."""
    columns = documents.select(F.explode("sample").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("c"))
    entries = documents.agg(F.sum(F.size("sample")).alias("s")).first()["s"] or 0
    least = max(4, entries / blocks / 4)
    found = columns.filter(F.col("c") >= least).orderBy(F.desc("c"), "token").limit(most).select("token").collect()
    return np.sort(np.array([r["token"] for r in found], np.int64).view(np.uint64))


def kept_rows(
    docs: DataFrame,
    n: int = WORDS,
    numerator: int = NUMERATOR,
    denominator: int = DENOMINATOR,
    block_bytes: int = BLOCK_BYTES,
    class_bits: int = 64,
) -> tuple[DataFrame, DataFrame]:
    """Staged: the document rows, and a row per class that may have a partner."""
    blocks = column_blocks(docs, block_bytes)
    row_blocks = max(8, blocks // 2)
    documents = document_rows(docs, n, block_bytes, class_bits)
    aside = frequent_columns(documents, blocks)
    # Two sets with one hash: about one in 10^10 documents.
    twice = documents.groupBy("klass").agg(F.min("other").alias("a"), F.max("other").alias("b")).filter("a <> b")
    collided = [r["klass"] for r in twice.select("klass").collect()]
    if collided:
        documents = documents.withColumn("klass", F.when(F.col("klass").isin(collided), F.col("other")).otherwise(F.col("klass")))
    run = _incidence(n, blocks, row_blocks, aside, frozenset(k & 0xFFFFFFFFFFFFFFFF for k in collided), class_bits)
    entries = docs.select(text_of(docs).alias("text")).mapInArrow(returning_memory(run), ROWS)
    dealt = entries.repartitionById(blocks + row_blocks, F.col("bucket")).mapInArrow(
        returning_memory(_frequencies(blocks, row_blocks)), ROWS
    )
    rows = dealt.repartitionById(row_blocks, F.col("bucket")).mapInArrow(returning_memory(_rows(numerator, denominator)), KEPT)
    return documents.drop("sample", "other"), stage(rows, "ngram-rows")


def class_links(classes: DataFrame, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """Links (a, b) between classes that span every component of the join."""
    prefixes = classes.select("klass", F.explode("prefix").alias("token"))
    stars = prefixes.groupBy("token").agg(F.min("klass").alias("hub"), F.max("klass").alias("far")).filter("hub <> far")
    candidates = prefixes.join(stars.drop("far"), "token").select(F.col("klass").alias("a"), F.col("hub").alias("b"))
    groups = stage(connected_components(candidates, "candidates"), "groups")
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("rows"))
    members = stage(
        classes.select("klass", "n", "tokens", "prefix")
        .join(groups.withColumnRenamed("node", "klass"), "klass")
        .join(sizes, "root"),
        "members",
    )
    small = members.filter(F.col("rows") <= GROUP_ROWS)
    buckets = small.count() // (2 * GROUP_ROWS) + 1
    links = (
        small.select("root", "klass", "n", "tokens", F.pmod(F.xxhash64("root"), F.lit(buckets)).alias("g"))
        .groupBy("g")
        .applyInArrow(_small_groups(numerator, denominator), "a long, b long")
    )
    large = members.filter(F.col("rows") > GROUP_ROWS)
    if large.isEmpty():
        return links
    # What one hub links to needs no comparison among itself.
    large = with_hubs(large.select("root", "klass", "n", "tokens", "prefix"), numerator, denominator)
    links = links.union(large.filter("hub <> klass").select("klass", "hub"))
    # Row blocks of bounded size: a class of sizes (linked sets are at most one apart), then the hub, or else the rarest
    # column, whose rows are split where they are many and share a block with others where they are few.
    step = math.log(denominator / numerator)
    large = large.withColumn("s", F.floor(F.log(F.col("n")) / F.lit(step)).cast("int")).withColumn("rare", F.col("prefix")[0])
    large = large.withColumn("by", F.coalesce("hub", "rare"))
    by_column = large.groupBy("root", "s", "hub", "by").agg(F.count(F.lit(1)).alias("c"))
    by_size = large.groupBy("root", "s").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("salts"))
    split = F.ceil(F.col("c") / BLOCK_ROWS)
    own = F.when(F.col("hub").isNotNull() | (split > 1), F.xxhash64("hub", "by", F.pmod(F.xxhash64("klass"), split)))
    shared = F.pmod(F.xxhash64("by"), F.col("salts")).cast("long")
    sizes = by_column.join(by_size, ["root", "s"]).withColumnsRenamed({c: f"_{c}" for c in ("root", "s", "hub", "by")})
    same = F.col("hub").eqNullSafe(F.col("_hub"))
    for c in ("root", "s", "by"):
        same = same & (F.col(c) == F.col(f"_{c}"))
    large = stage(
        large.join(sizes, same).withColumn("t", F.coalesce(own, shared)).select("root", "s", "t", "hub", "klass", "n", "tokens", "prefix"),
        "blocks",
    )
    # A pair of blocks is wanted once: (s1, t1) up to (s2, t2) of one class of sizes, or of two that follow each other.
    held = stage(large.select(F.explode("prefix").alias("token"), "root", "s", "t", "hub").distinct(), "block-columns")
    one, two = (
        held.select("token", "root", *[F.col(c).alias(f"{c}{k}") for c in ("s", "t", "hub")]) for k in (1, 2)
    )
    # At least one side without a hub; or two hubs, which are told apart before their blocks meet.
    free = one.filter("hub1 is null").join(two.drop("root"), "token")
    apart = held.filter("hub is not null").select("token", "hub").distinct()
    apart = apart.toDF("token", "hub1").join(apart.toDF("token", "hub2"), "token").filter("hub1 <> hub2")
    tied = apart.join(one, ["token", "hub1"]).join(two.drop("root"), ["token", "hub2"])
    ends = ["root", "s1", "t1", "s2", "t2"]
    both = free.select(*ends).union(tied.select(*ends))
    swapped = both.select("root", *[F.col(c).alias(d) for c, d in zip(("s2", "t2", "s1", "t1"), ends[1:])])
    pairs = stage(both.union(swapped).filter("(s1 = s2 and t1 <= t2) or s2 = s1 + 1").distinct(), "pairs")
    body = large.select("root", "s", "t", "klass", "n", "tokens")
    left = pairs.join(body.withColumnsRenamed({"s": "s1", "t": "t1"}), ["root", "s1", "t1"]).withColumn("side", F.lit(0))
    right = (
        pairs.filter("s1 <> s2 or t1 <> t2")
        .join(body.withColumnsRenamed({"s": "s2", "t": "t2"}), ["root", "s2", "t2"])
        .withColumn("side", F.lit(1))
    )
    products = (
        left.unionByName(right)
        .groupBy("root", "s1", "t1", "s2", "t2")
        .applyInArrow(_block_pairs(numerator, denominator), "a long, b long")
    )
    return links.union(products)


def ngram_components(
    docs: DataFrame,
    n: int = WORDS,
    numerator: int = NUMERATOR,
    denominator: int = DENOMINATOR,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links), klass (number
    of its set; null without words), key (hash of its text)."""
    documents, classes = kept_rows(docs, n, numerator, denominator, block_bytes)
    links = stage(class_links(classes, numerator, denominator), "links")
    roots = connected_components(links, "components")
    least = stage(
        documents.filter("klass is not null").groupBy("klass").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("c")),
        "classes",
    )
    tied = least.join(roots.withColumnRenamed("node", "klass"), "klass")
    tops = tied.groupBy("root").agg(F.min("least").alias("top"))
    moved = tied.join(tops, "root").select("klass", "top")
    labels = stage(
        least.join(moved, "klass", "left").select("klass", "c", F.coalesce("top", "least").alias("label")), "labels"
    )
    # Rows of the classes with the most copies stay where they are; each of the others has fewer than one in HEAVY rows.
    whole = labels.agg(F.sum("c")).first()[0] or 0
    much = F.col("c") > max(1, whole // HEAVY)
    heavy = F.broadcast(labels.filter(much).select("klass", "label", F.lit(True).alias("heavy")))
    marked = documents.join(heavy, "klass", "left")
    lone = F.col("heavy").isNull() & F.col("klass").isNotNull()
    light = marked.filter(lone).drop("heavy", "label").join(labels.filter(~much).select("klass", "label"), "klass")
    rest = marked.filter(~lone).drop("heavy")
    return light.unionByName(rest).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("klass").isNull(), F.col("doc_id")).otherwise(F.col("label")).alias("component_id"),
        "klass",
        "key",
    )


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose id names their component, all columns as they are. Documents without words stay, and so
    do rows that repeat the id and text of the one that stays."""
    k, i, t = (free_name(docs, x) for x in ("_key", "_id", "_text"))
    gone = stage(
        ngram_components(docs, **options)
        .filter("klass is not null and not (doc_id <=> component_id)")
        .select(F.col("doc_id").alias(i), F.col("key").alias(t))
        .distinct(),
        "near-copies",
    )
    keyed = docs.withColumn(k, F.xxhash64(text_of(docs)))
    same = F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(k) == F.col(t))
    return keyed.join(broadcast_if_small(gone), same, "left_anti").drop(k)

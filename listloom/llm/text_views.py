"""Numeric views of documents and a small classifier over them, for the quality and mixing operators.

A view is a dense matrix: columns of ``style`` and, where a ``Vocabulary`` is given, log(1 + count) of its entries. An
entry is a word or the start of a word; ``choose_words`` finds, over a bounded sample of labelled rows, those that a
class has far more often than the rest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Columns of ``style``.
STYLE = (
    "log_words", "distinct", "top_share", "again", "again_max", "upper", "upper_max", "marks", "marks_max",
    "mark_runs", "bars", "digits", "word_length", "line_copies", "sentence_marks", "wide",
)
#: Which of them tell of the text as a whole, and which of the page's layout and its worst part; length is metadata.
WORDING = tuple(STYLE.index(c) for c in ("distinct", "top_share", "again", "word_length", "upper", "marks"))
LAYOUT = tuple(
    STYLE.index(c)
    for c in ("again_max", "upper_max", "marks_max", "mark_runs", "bars", "digits", "line_copies", "sentence_marks", "wide")
)
#: Words in a part of a text whose worst values count as features of their own.
PART = 48
#: Lengths of the word starts that a vocabulary may hold; 0 is the whole word.
STARTS = (0, 4, 6)
EDGES = ".,;:!?()\"'"

_CLASS = np.zeros(256, np.int8)
_CLASS[[*range(65, 91)]] = 1
_CLASS[[*range(97, 123)]] = 2
_CLASS[[*range(48, 58)]] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[[*b".,;:?'"]] = 5
_CLASS[_CLASS == 0] = 6
_CLASS[128:] = 7


def _most(values: np.ndarray, part: int) -> float:
    if len(values) <= part:
        return float(values.mean()) if len(values) else 0.0
    sums = np.add.reduceat(values, np.arange(0, len(values) - part + 1, part))
    sums[:-1] /= part
    sums[-1] /= len(values) - part * (len(sums) - 1)
    return float(sums.max())


def style_of(text: str, ids: np.ndarray) -> list[float]:
    """Features of form: repetition, capitals, marks, runs of marks, lines that repeat, and the worst part of each.
    ``ids`` number the text's words."""
    raw = np.frombuffer(text.encode(), np.uint8)
    n = len(ids)
    if not len(raw):
        return [0.0] * len(STYLE)
    kind = _CLASS[raw]
    count = np.bincount(kind, minlength=8)
    letters = max(1, int(count[1] + count[2] + count[7]))
    size = len(raw)
    again = np.zeros(n)
    again[1:] = ids[1:] == ids[:-1]
    tops = np.unique(ids, return_counts=True)[1]
    is_mark = kind == 6
    runs = int(np.count_nonzero(is_mark[1:] & (raw[1:] == raw[:-1]))) if size > 1 else 0
    lines = [x for x in text.split("\n") if x]
    bytes_part = PART * 6
    return [
        float(np.log1p(n)),
        len(tops) / n,
        float(tops.max()) / n,
        float(again.mean()),
        _most(again, PART),
        count[1] / letters,
        _most((kind == 1).astype(float), bytes_part),
        count[6] / size,
        _most(is_mark.astype(float), bytes_part),
        runs / size,
        float(np.count_nonzero(raw == 124)) / n,
        count[3] / size,
        min(30.0, letters / n),
        1 - len(set(lines)) / max(1, len(lines)),
        count[5] / n,
        count[7] / size,
    ]


def style(texts: pa.Array, split: tuple | None = None) -> np.ndarray:
    """``split``: the texts' words as of ``split_words``, where they are at hand."""
    _, which, _, sizes = split or split_words(texts)
    ends = np.cumsum(sizes).tolist()
    rows = [style_of(t, which[lo:hi]) for t, lo, hi in zip(texts.to_pylist(), [0, *ends], ends)]
    return np.array(rows, dtype=np.float64).reshape(len(texts), len(STYLE))


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(row of each word, its number, the numbered words, words of each row), over white space."""
    lists = pc.ascii_split_whitespace(texts)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.flatten().dictionary_encode()
    return np.repeat(np.arange(len(sizes)), sizes), words.indices.to_numpy(), words.dictionary, sizes


def _parts(words: pa.Array) -> list[pa.Array]:
    """For each of ``STARTS``: the lower-case core of every word, or its start."""
    plain = pc.utf8_lower(pc.utf8_trim(words, characters=EDGES))
    return [pc.utf8_slice_codeunits(plain, 0, n) if n else plain for n in STARTS]


class Vocabulary:
    """Entries ``start length:text`` in a fixed order; counts them in texts."""

    def __init__(self, names: list[str]):
        self.names = names
        self.columns, self.values = [], []
        for n in STARTS:
            own = [k for k, name in enumerate(names) if name.startswith(f"{n}:")]
            self.columns.append(np.array(own, np.int64))
            self.values.append([names[k].split(":", 1)[1] for k in own])

    def __len__(self) -> int:
        return len(self.names)

    def counts(self, split: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, column, count) of what occurs, ordered, from the texts' ``split_words``."""
        row, which, words, _ = split
        keys = []
        for part, columns, values in zip(_parts(words), self.columns, self.values):
            if len(values):
                found = pc.index_in(part, value_set=pa.array(values, pa.string()))
                at = found.fill_null(-1).to_numpy(zero_copy_only=False)[which]
                met = at >= 0
                keys.append(row[met] * len(self) + columns[at[met]])
        flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        key, count = np.unique(flat, return_counts=True)
        return key // max(1, len(self)), key % max(1, len(self)), count


def dense(rows: int, width: int, row: np.ndarray, column: np.ndarray, count: np.ndarray) -> np.ndarray:
    out = np.zeros((rows, width))
    out[row, column] = np.log1p(count)
    return out


def full_view(texts: pa.Array, vocabulary: Vocabulary) -> np.ndarray:
    """All of ``style`` and the vocabulary's counts."""
    split = split_words(texts)
    return np.concatenate([style(texts, split), dense(len(texts), len(vocabulary), *vocabulary.counts(split))], axis=1)


def _distinct_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 200):
            part = batch.slice(low, 200)
            row, which, words, _ = split_words(part.column("text"))
            klass = part.column("klass").to_numpy()
            names, classes = [], []
            for n, found in zip(STARTS, _parts(words)):
                coded = found.dictionary_encode()
                if not len(coded.dictionary):
                    continue
                pair = np.unique(row * len(coded.dictionary) + coded.indices.to_numpy()[which])
                entry = coded.dictionary.take(pa.array(pair % len(coded.dictionary)))
                names.append(pc.binary_join_element_wise(pa.scalar(str(n)), entry, ":"))
                classes.append(klass[pair // len(coded.dictionary)])
            if names:
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays(names), pa.array(np.concatenate(classes), pa.int32())], names=["name", "klass"]
                )


def choose_words(sample: DataFrame, classes: int, each: int) -> Vocabulary:
    """Of ``sample(text, klass)``, a bounded set of rows: for each class the ``each`` entries with the highest z-score of
    its share of documents against the others' (ties by name). Counts are aggregated by Spark; only the entries chosen,
    at most ``classes * each``, reach the driver."""
    sizes = {r["klass"]: r["count"] for r in sample.groupBy("klass").count().collect()}
    total = sum(sizes.values())
    have = [F.count_if(F.col("klass") == k).alias(f"c{k}") for k in range(classes)]
    entries = sample.select("text", F.col("klass").cast("int").alias("klass")).mapInArrow(
        _distinct_parts, "name string, klass int"
    )
    counted = stage(
        entries.groupBy("name").agg(F.count(F.lit(1)).alias("c"), *have).filter("c > 1 and length(name) > 3"), "words"
    )
    chosen: set[str] = set()
    for k, n in sorted(sizes.items()):
        if n == total:
            continue
        share = (F.col("c") + 1) / F.lit(total + 2.0)
        apart = (F.col(f"c{k}") + 0.5) / F.lit(n + 1.0) - (F.col("c") - F.col(f"c{k}") + 0.5) / F.lit(total - n + 1.0)
        z = apart / F.sqrt(share * (1 - share) * F.lit(1 / n + 1 / (total - n)))
        best = counted.select("name", F.round(z, 9).alias("z")).filter("z > 2").orderBy(F.desc("z"), "name").limit(each)
        chosen |= {r["name"] for r in best.collect()}
    return Vocabulary(sorted(chosen))


class Softmax:
    """Multinomial regression with a ridge, fitted by accelerated full-gradient steps."""

    def __init__(self, classes: int, columns: int, decay: float = 3e-3):
        self.classes, self.decay, self.temperature = classes, decay, 1.0
        self.mean, self.scale = np.zeros(columns), np.ones(columns)
        self.w = np.zeros((columns + 1, classes))

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self._scaled(x) @ self.w

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        return _softmax(self.scores(x) / self.temperature)

    def calibrate(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Softmax:
        """Set the temperature that rows not fitted on find likeliest."""
        if len(x):
            s = self.scores(x)
            weight = np.full(len(x), 1 / len(x)) if weight is None else weight / weight.sum()
            loss = lambda t: -float(weight @ np.log(np.maximum(1e-300, _softmax(s / t)[np.arange(len(y)), y])))
            self.temperature = float(min(np.geomspace(0.3, 3, 48), key=loss))
        return self

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, steps: int = 150) -> Softmax:
        """Rows weigh as ``weight`` says, evenly by default."""
        n = len(x)
        weight = np.full(n, 1 / n) if weight is None else weight / weight.sum()
        self.mean = weight @ x
        self.scale = np.sqrt(weight @ (x - self.mean) ** 2) + 1e-9
        z, weight = self._scaled(x).astype(np.float32), weight.astype(np.float32)
        goal = np.eye(self.classes, dtype=np.float32)[y]
        # Half the largest eigenvalue of the weighted second moments bounds the curvature.
        v = np.ones(z.shape[1], np.float32)
        for _ in range(30):
            v = z.T @ (weight * (z @ v))
            top = np.linalg.norm(v)
            v /= top
        step = float(1 / (0.55 * top + self.decay))
        at = before = self.w.astype(np.float32)
        pace = 1.0
        for _ in range(steps):
            onward = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
            ahead = at + (pace - 1) / onward * (at - before)
            off = (_softmax(z @ ahead) - goal) * weight[:, None]
            before, at, pace = at, ahead - step * (z.T @ off + self.decay * ahead), onward
        self.w = at.astype(float)
        return self


def _softmax(s: np.ndarray) -> np.ndarray:
    s = np.exp(s - s.max(axis=1, keepdims=True))
    return s / s.sum(axis=1, keepdims=True)

"""Quality classifier by co-training of two views.

One classifier sees the text's content: its words, of a vocabulary chosen on the labelled rows, and how they repeat and
are written on the whole. The other sees the page: source, language, length, and the metadata of its layout (table bars,
runs of marks, digits, repeated lines, the worst part for capitals, marks and repetition). Both start from the labelled rows; in every round each scores all unlabelled documents and
hands the ones it is confident about, a bounded hash sample of each class, to the other as training rows. Then each view
is calibrated on labelled rows that took no part in fitting, the calibrated views are combined, and all documents are
scored. A document is kept at or above a threshold that keeps ``KEEP_GOOD`` of the calibration rows labelled good.

Fitting uses at most ``LABELLED`` labelled rows of a class and ``PSEUDO`` pseudo-labelled rows of a class, teacher and
round; these bounds are parameters. Scores and confident rows come from all documents. Samples and the held-out part
follow a hash of id and text, so the order and partitioning of the rows change nothing.

Defined cases: null text is empty text; null metadata is a value of its own; several labels of a document count as its
worst; labels of unknown documents are ignored; without labelled rows of both classes nothing can be learnt: scores are
null and every document is kept; rows that repeat give a row each and are one training row; an empty table gives an empty
result; ids keep their type; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listloom.session import ship

from .common import free_name, give_back, returning_memory, slices, stage, text_of
from .text_views import LAYOUT, STYLE, WORDING, Softmax, Vocabulary, choose_words, dense, split_words, style

LABELLED = 3000
PSEUDO = 400
ROUNDS = 3
CONFIDENT = 0.97
KEEP_GOOD = 0.995
#: Words and word starts that the content view may use for a class.
WORDS = 200
SOURCES, LANGS = 64, 16
SLICE_BYTES, SLICE_ROWS = 2 << 20, 400


def page_view(source: list, lang: list, chars: np.ndarray, form: np.ndarray) -> np.ndarray:
    """Hashed one-hot source and language, the length with its square, and the layout columns of ``form``."""
    out = np.zeros((len(source), SOURCES + LANGS + 2))
    for k, (s, g) in enumerate(zip(source, lang)):
        out[k, xxhash.xxh32_intdigest(s or "") % SOURCES] = 1
        out[k, SOURCES + xxhash.xxh32_intdigest(g or "") % LANGS] = 1
    size = np.log1p(np.maximum(0, chars.astype(float)))
    out[:, -2], out[:, -1] = size, size * size
    return np.concatenate([out, form[:, LAYOUT]], axis=1)


def text_view(form: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The wording columns of ``form`` and the vocabulary's log counts."""
    return np.concatenate([form[:, WORDING], words], axis=1)


@dataclass
class Combined:
    """Both views with their calibration and the weights of the combination (scale and shift of each log-odds)."""

    vocabulary: Vocabulary
    text: Softmax
    page: Softmax
    text_scale: tuple[float, float]
    page_scale: tuple[float, float]
    weights: tuple[float, float, float]
    threshold: float

    def scores(self, x: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = self.text_scale[0] * _odds(self.text, x) + self.text_scale[1]
        b = self.page_scale[0] * _odds(self.page, p) + self.page_scale[1]
        z = self.weights[0] * a + self.weights[1] * b + self.weights[2]
        return _sigmoid(a), _sigmoid(b), _sigmoid(z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _odds(model: Softmax, x: np.ndarray) -> np.ndarray:
    s = model.scores(x)
    return np.clip(s[:, 1] - s[:, 0], -30, 30)


def _logistic(columns: np.ndarray, y: np.ndarray, start: np.ndarray, weight: np.ndarray, steps: int = 40) -> np.ndarray:
    """Regularised Newton steps for a few coefficients (the last is the shift)."""
    x = np.concatenate([columns, np.ones((len(columns), 1))], axis=1)
    w = start.astype(float)
    keep = np.full(x.shape[1], 0.02)
    for _ in range(steps):
        p = _sigmoid(x @ w)
        g = x.T @ (weight * (p - y)) + keep * (w - start)
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(keep + 1e-9)
        w = w - np.linalg.solve(h, g)
    return w


def _key(docs: DataFrame) -> Column:
    return F.xxhash64(docs["doc_id"], text_of(docs), F.lit(1))


def _metadata(docs: DataFrame) -> list[Column]:
    have = {c.lower(): c for c in docs.columns}
    source, lang = (
        docs[have[c]].cast("string") if c in have else F.lit(None).cast("string") for c in ("source", "lang")
    )
    chars = docs[have["n_chars"]].cast("long") if "n_chars" in have else F.lit(None).cast("long")
    length = F.coalesce(chars, F.length(text_of(docs))).cast("long")
    return [source.alias("source"), lang.alias("lang"), length.alias("chars")]


def quality_marks(labels: DataFrame) -> DataFrame:
    """(_id, good) of every labelled document."""
    marks = labels.filter("quality is not null").groupBy(labels["doc_id"].alias("_id"))
    return marks.agg(F.min(F.col("quality").cast("int")).alias("good")).filter("good in (0, 1)")


def _first(rows: DataFrame, bound: int) -> DataFrame:
    """At most ``bound`` rows of each class, those with the smallest hashes; repeated rows count once."""
    out = [rows.filter(F.col("good") == k).orderBy("key").limit(bound) for k in (0, 1)]
    return out[0].union(out[1])


def labelled_keys(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(key, good) of labelled rows, staged; keys are hashes of id and text."""
    keyed = docs.select(docs["doc_id"].alias("_id"), _key(docs).alias("key"))
    return stage(keyed.join(marks, "_id").select("key", "good").distinct(), "labelled")


def content_vocabulary(docs: DataFrame, known: DataFrame, bound: int = LABELLED, words: int = WORDS) -> Vocabulary:
    """The words of the labelled rows that tell good from bad, from at most ``bound`` rows of a class."""
    ids = _first(known, bound).withColumnRenamed("good", "klass")
    sample = docs.select(text_of(docs).alias("text"), _key(docs).alias("key")).join(F.broadcast(ids), "key")
    return choose_words(stage(sample.dropDuplicates(["key"]), "quality-sample"), 2, words)


def features(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, source, lang, chars, key, form, columns, counts) of every document, in one pass over the texts; form is
    ``style``, columns and counts are the vocabulary's."""
    ship(docs.sparkSession)
    base = docs.select(docs["doc_id"], *_metadata(docs), _key(docs).alias("key"), text_of(docs).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES, SLICE_ROWS):
                texts = part.column("text")
                split = split_words(texts)
                form = style(texts, split).astype(np.float32)
                row, column, count = vocabulary.counts(split)
                ends = np.searchsorted(row, np.arange(part.num_rows + 1)).tolist()
                columns, counts = column.astype(np.uint16), np.minimum(count, 65535).astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in ("doc_id", "source", "lang", "chars", "key")),
                        pa.array([f.tobytes() for f in form], pa.binary()),
                        *(
                            pa.array([v[lo:hi].tobytes() for lo, hi in zip(ends, ends[1:])], pa.binary())
                            for v in (columns, counts)
                        ),
                    ],
                    names=["doc_id", "source", "lang", "chars", "key", "form", "columns", "counts"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(
        returning_memory(run),
        f"doc_id {kind}, source string, lang string, chars long, key long, form binary, columns binary, counts binary",
    )


def _views(pdf: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    form = np.frombuffer(b"".join(pdf["form"]), np.float32).reshape(len(pdf), len(STYLE)).astype(float)
    column = np.frombuffer(b"".join(pdf["columns"]), np.uint16)
    count = np.frombuffer(b"".join(pdf["counts"]), np.uint16)
    row = np.repeat(np.arange(len(pdf)), [len(c) // 2 for c in pdf["columns"]])
    words = dense(len(pdf), width, row, column, count.astype(float))
    return text_view(form, words), page_view(pdf["source"].tolist(), pdf["lang"].tolist(), pdf["chars"].to_numpy(), form)


def labelled(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """``rows`` with ``good`` (0, 1 or null without a label), staged."""
    return stage(rows.join(marks, F.col("doc_id") == F.col("_id"), "left").drop("_id"), "views")


def fit(
    rows: DataFrame,
    known: DataFrame,
    vocabulary: Vocabulary,
    bound: int = LABELLED,
    pseudo: int = PSEUDO,
    rounds: int = ROUNDS,
    confident: float = CONFIDENT,
    keep_good: float = KEEP_GOOD,
    report: list | None = None,
) -> Combined | None:
    """Co-train on the staged ``rows`` of ``labelled`` and ``known`` of ``labelled_keys``; None without labelled rows of
    both classes."""
    counts = {r["good"]: r["count"] for r in known.groupBy("good").count().collect()}
    if len(counts) < 2:
        return None
    width = len(vocabulary)
    ids = F.broadcast(_first(known, bound).select("key"))  # at most 2 * bound rows
    sample = rows.join(ids, "key", "left_semi").dropDuplicates(["key"]).toPandas().sort_values("key")
    held = np.array([xxhash.xxh32_intdigest(str(u)) % 10 < 3 for u in sample["key"]])
    if any(len(set(sample["good"][part])) < 2 for part in (held, ~held)):
        held[:] = False
    x, p = _views(sample, width)
    y = sample["good"].to_numpy(dtype=int)
    real = np.array([counts[0] / max(1, (y == 0).sum()), counts[1] / max(1, (y == 1).sum())])
    sets = {v: (a[~held], y[~held], real[y[~held]]) for v, a in (("text", x), ("page", p))}
    pool = rows.filter("good is null").drop("good")
    models: dict[str, Softmax] = {}

    def fit_views() -> None:
        for v, (data, goal, weight) in sets.items():
            models[v] = Softmax(2, data.shape[1]).fit(data, goal, weight)

    fit_views()
    for round_no in range(rounds):
        sure = pool.mapInArrow(_teachers(models["text"], models["page"], confident, width), _SURE)
        found = {(r["teacher"], r["said"]): r["count"] for r in sure.groupBy("teacher", "said").count().collect()}
        if report is not None:
            report.append({f"{t}:{s}": n for (t, s), n in found.items()})
        if not found:
            break
        # The smallest hashes of each teacher and class: the same rows however the table is dealt.
        order = F.xxhash64("key", F.lit(100 + round_no))
        picked = None
        for teacher, said in sorted(found):
            own = sure.filter((F.col("teacher") == teacher) & (F.col("said") == said)).orderBy(order, "key").limit(pseudo)
            picked = own if picked is None else picked.union(own)
        new = picked.toPandas().drop_duplicates(["teacher", "key"]).sort_values(["teacher", "key"])
        nx, np_ = _views(new, width)
        said = new["said"].to_numpy(dtype=int)
        for teacher, pupil, data in (("text", "page", np_), ("page", "text", nx)):
            own = (new["teacher"] == teacher).to_numpy()
            if own.any():
                # A pseudo-labelled row weighs as many as it stands for, but no more than a labelled one.
                weight = np.array([min(real[s], found[teacher, s] / (said[own] == s).sum()) for s in said[own]])
                sets[pupil] = tuple(np.concatenate([a, b]) for a, b in zip(sets[pupil], (data[own], said[own], weight)))
        fit_views()
    test = held if held.any() else np.ones(len(y), bool)
    weight = real[y[test]]
    a, b = _odds(models["text"], x[test]), _odds(models["page"], p[test])
    ta = _logistic(a[:, None], y[test], np.array([1.0, 0.0]), weight)
    tb = _logistic(b[:, None], y[test], np.array([1.0, 0.0]), weight)
    both = np.stack([ta[0] * a + ta[1], tb[0] * b + tb[1]], axis=1)
    w = _logistic(both, y[test], np.array([1.0, 0.0, 0.0]), weight)
    score = _sigmoid(both @ w[:2] + w[2])
    threshold = min(0.5, float(np.quantile(score[y[test] == 1], 1 - keep_good)))
    return Combined(vocabulary, models["text"], models["page"], tuple(ta), tuple(tb), tuple(w), threshold)


_SURE = (
    "teacher string, said int, source string, lang string, chars long, key long, form binary, columns binary, counts binary"
)
_GIVEN = ["source", "lang", "chars", "key", "form", "columns", "counts"]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(low, SLICE_ROWS)


def _teachers(text: Softmax, page: Softmax, confident: float, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            x, p = _views(batch.to_pandas(), width)
            for name, odds in (("text", _odds(text, x)), ("page", _odds(page, p))):
                good = _sigmoid(odds)
                sure = np.flatnonzero((good >= confident) | (good <= 1 - confident))
                if len(sure):
                    own = batch.take(pa.array(sure))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name] * len(sure)),
                            pa.array((good[sure] > 0.5).astype(np.int32)),
                            *(own.column(c) for c in _GIVEN),
                        ],
                        names=["teacher", "said", *_GIVEN],
                    )

    return run


def score_rows(rows: DataFrame, model: Combined | None) -> DataFrame:
    """doc_id, text_score, page_score, score and keep of every row."""
    if model is None:
        none = F.lit(None).cast("double")
        return rows.select(
            "doc_id", none.alias("text_score"), none.alias("page_score"), none.alias("score"), F.lit(True).alias("keep")
        )
    width = len(model.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            a, b, c = model.scores(*_views(batch.to_pandas(), width))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(a), pa.array(b), pa.array(c), pa.array(c >= model.threshold)],
                names=["doc_id", "text_score", "page_score", "score", "keep"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        returning_memory(run), f"doc_id {kind}, text_score double, page_score double, score double, keep boolean"
    )


def _learn(docs: DataFrame, labels: DataFrame, options: dict) -> tuple[DataFrame, Combined | None]:
    marks = quality_marks(labels)
    known = labelled_keys(docs, marks)
    vocabulary = content_vocabulary(docs, known, options.get("bound", LABELLED))
    rows = labelled(features(docs, vocabulary), marks)
    return rows, fit(rows, known, vocabulary, **options)


def quality_scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, text_score, page_score, score, keep."""
    return score_rows(*_learn(docs, labels, options))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, all columns as they are. The decision is made row by row in the
    scan, so no text is shuffled."""
    _, model = _learn(docs, labels, options)
    if model is None:
        return docs
    said = free_name(docs, "_score")

    def score(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            out = [np.zeros(0)]
            for part in slices(pa.record_batch(list(columns), names=list("tsgc")), "t", SLICE_BYTES, SLICE_ROWS):
                t, s, g, c = part.columns
                split = split_words(t)
                # As the staged features are stored, so that both ways to score a document agree.
                form = style(t, split).astype(np.float32).astype(float)
                row, column, count = model.vocabulary.counts(split)
                words = dense(part.num_rows, len(model.vocabulary), row, column, np.minimum(count, 65535))
                page = page_view(s.to_pylist(), g.to_pylist(), c.to_numpy(zero_copy_only=False), form)
                out.append(model.scores(text_view(form, words), page)[2])
            yield pa.array(np.concatenate(out))
        give_back()

    # Only what the views read goes to Python, and only the score comes back.
    scored = docs.withColumn(said, F.arrow_udf(score, "double").asNondeterministic()(text_of(docs), *_metadata(docs)))
    return scored.filter(F.col(said) >= model.threshold).drop(said)

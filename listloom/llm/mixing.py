"""Soft-membership mixing of sources to target weights.

A classifier fitted on the labelled table predicts for every document the probabilities of its domains. Each document
gets a rate r >= 0, the expected number of times it is used, such that the expected tokens of each domain,
sum of r * tokens * probability, meet the target weights. The rates minimise the plain squared excess of the domains by
accelerated projected gradient steps from r = 1. The step is one over the largest eigenvalue of the documents' second
moments, so no step overshoots; momentum starts anew whenever the excess grows. The fit ends when every domain is within
``TOLERANCE`` of its target, or when the projected gradient vanishes: then the excess that is left is the least that
nonnegative rates allow. A fit that ends otherwise says so (``Fit.converged``).

Probabilities are rounded to multiples of 1 / ``LEVELS``. Documents with equal probabilities have equal rates, so one
partially aggregated pass sums the tokens of each of at most (LEVELS + 1)(LEVELS + 2) / 2 cells, and all iterations are
distributed aggregates over that table, whose size does not grow with the documents. A cell's or document's rate follows
from its probabilities and the list of past steps; no rates are stored, and a lost executor loses nothing.

Fitting uses at most ``LABELLED`` labelled documents of a domain (a parameter); probabilities, sums and rates cover all
documents.

Defined cases: null text is empty text; several labels of a document count as its worst; a domain without labelled
documents has probability 0, and its target is spread over the others; without any label every domain is as likely;
rows that repeat get a rate each; documents without words have 0 tokens and a rate like any other; an empty table gives
an empty result; ids keep their type; other columns are left alone.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listloom.session import ship

from .common import free_name, give_back, returning_memory, slices, stage, text_of
from .text_views import STYLE, Softmax, Vocabulary, choose_words, full_view

#: Domains of the labelled table: low and high quality, and toxic whatever the quality.
DOMAINS = ("low", "high", "toxic")
TARGETS = {"low": 0.06, "high": 0.92, "toxic": 0.02}
LABELLED = 1500
#: Words and word starts that the classifier may use for a domain.
WORDS = 300
LEVELS = 1000
ITERATIONS = 200
TOLERANCE = 1e-4
SALT = 17
SLICE_BYTES, SLICE_ROWS = 2 << 20, 400


@dataclass
class Mixer:
    """The fitted classifier with the domains' shares among the labels, and the past steps with their momentum."""

    model: Softmax | None
    prior: np.ndarray
    vocabulary: Vocabulary | None = None
    steps: list[tuple[np.ndarray, float]] = field(default_factory=list)
    most: float = np.inf
    #: Domain whose documents (no other domain is likelier) keep a rate of 1 at least.
    spared: str | None = None

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        """Multiples of 1 / LEVELS that sum to 1."""
        if self.model is None:
            p = np.tile(self.prior, (len(texts), 1))
        else:
            p = self.model.posteriors(full_view(texts, self.vocabulary)) * (self.prior > 0)
        return rounded(p / p.sum(axis=1, keepdims=True))

    def least(self, p: np.ndarray) -> np.ndarray:
        if self.spared is None:
            return np.zeros(len(p))
        return (p[:, DOMAINS.index(self.spared)] >= p.max(axis=1)).astype(float)

    def path(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rates after all steps, the point they were stepped from, and the point of the next step."""
        least = self.least(p)
        r = here = ahead = np.clip(np.ones(len(p)), least, self.most)
        for step, momentum in self.steps:
            here, before = ahead, r
            r = np.clip(here - p @ step, least, self.most)
            ahead = r + momentum * (r - before)
        return r, here, ahead

    def rates(self, p: np.ndarray) -> np.ndarray:
        return self.path(p)[0]


def rounded(p: np.ndarray, levels: int = LEVELS) -> np.ndarray:
    """Rows of sum 1 to multiples of 1 / levels, the largest remainders up."""
    whole = np.floor(p * levels + 1e-9)
    left = np.rint(levels - whole.sum(axis=1)).astype(int)
    order = np.argsort(np.argsort(-(p * levels - whole), axis=1, kind="stable"), axis=1, kind="stable")
    return (whole + (order < left[:, None])) / levels


def domain_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, domain): 2 toxic, else 0 low or 1 high quality."""
    toxic = F.max(F.coalesce(F.col("toxic"), F.lit(0)).cast("int"))
    quality = F.min(F.col("quality").cast("int"))
    domain = F.when(toxic == 1, 2).otherwise(quality)
    return labels.groupBy("doc_id").agg(domain.alias("domain")).filter("domain in (0, 1, 2)")


def fit_domains(
    docs: DataFrame, marked: DataFrame, bound: int = LABELLED, words: int = WORDS, most: float = np.inf
) -> Mixer:
    """Fit on at most ``bound`` labelled documents of each domain, those with the smallest hashes of id and text: only
    their keys are broadcast, and only their views reach the driver."""
    ship(docs.sparkSession)
    key = F.xxhash64(docs["doc_id"], text_of(docs), F.lit(3))
    known = stage(
        docs.select(docs["doc_id"].alias("doc_id"), key.alias("key")).distinct().join(marked, "doc_id"), "domains"
    )
    counts = {r["domain"]: r["count"] for r in known.groupBy("domain").count().collect()}
    prior = np.array([counts.get(k, 0) for k in range(len(DOMAINS))], dtype=float)
    if not counts:
        return Mixer(None, np.full(len(DOMAINS), 1 / len(DOMAINS)), most=most)
    prior /= prior.sum()
    if len(counts) == 1:
        return Mixer(None, prior, most=most)
    ids = None
    for k in counts:
        own = known.filter(F.col("domain") == k).orderBy("key", "doc_id").limit(bound)
        ids = own if ids is None else ids.union(own)
    ids = ids.select("key", F.col("domain").alias("klass")).distinct()
    sample = stage(
        docs.select(text_of(docs).alias("text"), key.alias("key"))
        .join(F.broadcast(ids), "key")
        .dropDuplicates(["key"]),
        "domain-sample",
    )
    vocabulary = choose_words(sample, len(DOMAINS), words)
    width = len(STYLE) + len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES, SLICE_ROWS):
                view = full_view(part.column("text"), vocabulary).astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("klass"), pa.array([v.tobytes() for v in view], pa.binary())],
                    names=["key", "klass", "view"],
                )

    rows = sample.mapInArrow(run, "key long, klass int, view binary").toPandas().sort_values("key")
    x = np.frombuffer(b"".join(rows["view"]), np.float32).reshape(len(rows), width).astype(float)
    y = rows["klass"].to_numpy(dtype=int)
    weight = np.array([counts.get(k, 0) / max(1, (y == k).sum()) for k in range(len(DOMAINS))])[y]
    # Every fourth document calibrates and takes no part in fitting.
    held = np.arange(len(y)) % 4 == 3 if len(y) >= 40 else np.zeros(len(y), bool)
    model = Softmax(len(DOMAINS), width).fit(x[~held], y[~held], weight[~held])
    model.calibrate(x[held], y[held], weight[held])
    return Mixer(model, prior, vocabulary, most=most)


def posteriors(docs: DataFrame, mixer: Mixer) -> DataFrame:
    """(doc_id, tokens, p) of every document; tokens are words between white space. Staged."""
    ship(docs.sparkSession)
    base = docs.select(docs["doc_id"], text_of(docs).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES, SLICE_ROWS):
                texts = part.column("text")
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(t.split()) for t in texts.to_pylist()], pa.int64()),
                        pa.array(mixer.probabilities(texts).tolist(), pa.list_(pa.float64())),
                    ],
                    names=["doc_id", "tokens", "p"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return stage(base.mapInArrow(returning_memory(run), f"doc_id {kind}, tokens long, p array<double>"), "posteriors")


def cells(rows: DataFrame) -> DataFrame:
    """Tokens of all documents with equal probabilities, staged; the number of rows is bounded by LEVELS."""
    return stage(rows.groupBy("p").agg(F.sum("tokens").alias("tokens")), "cells")


def _totals(table: DataFrame, mixer: Mixer) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected tokens of each domain at the rates and at the next point, the second moments, and the tokens' sum of
    squared moves of the last step."""
    n = len(DOMAINS)
    names = [f"t{k}" for k in range(2 * n + n * n + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(names))
        for batch in batches:
            p, tokens = _matrix(batch), batch.column("tokens").to_numpy()
            r, here, ahead = mixer.path(p)
            total[:n] += (r * tokens) @ p
            total[n : 2 * n] += (ahead * tokens) @ p
            total[2 * n : -1] += ((p * tokens[:, None]).T @ p).ravel()
            total[-1] += tokens @ (r - here) ** 2
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total], names=names)

    sums = table.select("tokens", "p").mapInArrow(run, ", ".join(f"{c} double" for c in names))
    got = np.array([v or 0.0 for v in sums.agg(*[F.sum(c).alias(c) for c in names]).first()])
    return got[:n], got[n : 2 * n], got[2 * n : -1].reshape(n, n), got[-1]


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("p").flatten().to_numpy().reshape(batch.num_rows, len(DOMAINS))


@dataclass
class Fit:
    """What a fit came to: targets and totals as shares of all tokens, the iterations, and whether it converged."""

    wanted: np.ndarray
    reached: np.ndarray
    iterations: int
    converged: bool

    @property
    def excess(self) -> float:
        return float(np.abs(self.reached - self.wanted).max(initial=0.0))


def fit_rates(
    rows: DataFrame,
    mixer: Mixer,
    targets: dict[str, float] = TARGETS,
    scale: float | None = 1.0,
    iterations: int = ITERATIONS,
    tolerance: float = TOLERANCE,
    report: list | None = None,
) -> Fit:
    """Add steps to ``mixer`` until the rates fit; ``rows`` as of ``posteriors``. ``scale`` is the wanted size against the
    input; None keeps the spared domain's expected tokens as they are."""
    table = cells(rows)
    reached, ahead, moments, _ = _totals(table, mixer)
    plain, *_ = _totals(table, Mixer(mixer.model, mixer.prior))
    whole = plain.sum()
    if whole <= 0:
        return Fit(np.zeros(len(DOMAINS)), np.zeros(len(DOMAINS)), 0, True)
    shares = np.array([targets.get(d, 0.0) for d in DOMAINS]) * (plain > 0)
    shares = shares / shares.sum() if shares.sum() > 0 else plain / whole
    if scale is None:
        k = DOMAINS.index(mixer.spared)
        scale = plain[k] / whole / shares[k] if shares[k] > 0 else 1.0
    wanted = scale * shares
    steep = float(np.linalg.eigvalsh(moments / whole).max())
    excess, next_excess = reached / whole - wanted, ahead / whole - wanted
    pace, converged, done = 1.0, bool(np.abs(excess).max() <= tolerance), 0
    while not converged and done < iterations:
        onward = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        mixer.steps.append((next_excess / steep, (pace - 1) / onward))
        pace = onward
        reached, ahead, _, moved = _totals(table, mixer)
        done += 1
        new = reached / whole - wanted
        if report is not None:
            report.append(new)
        # The moves are the projected gradient over ``steep``; without them no change of the rates lowers the excess.
        still = steep * np.sqrt(moved / whole) <= tolerance
        converged = bool(np.abs(new).max() <= tolerance or still)
        if new @ new > excess @ excess:
            mixer.steps[-1] = (mixer.steps[-1][0], 0.0)
            ahead, pace = reached, 1.0
        excess, next_excess = new, ahead / whole - wanted
    return Fit(wanted, reached / whole, done, converged)


def mix_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, **options) -> DataFrame:
    """One row per document: doc_id, tokens, a probability for each domain, rate, copies (the rate, rounded up or down by
    a hash of the document so that the expectation holds), and for the whole fit: excess (the largest difference of a
    domain's share from its target) and converged."""
    mixer = fit_domains(docs, domain_labels(labels))
    rows = posteriors(docs, mixer)
    fit = fit_rates(rows, mixer, targets, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _matrix(batch)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("tokens"),
                    *(pa.array(p[:, k]) for k in range(len(DOMAINS))),
                    pa.array(mixer.rates(p)),
                ],
                names=["doc_id", "tokens", *(f"p_{d}" for d in DOMAINS), "rate"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    shares = ", ".join(f"p_{d} double" for d in DOMAINS)
    out = rows.mapInArrow(run, f"doc_id {kind}, tokens long, {shares}, rate double")
    return out.withColumn("copies", copies(F.col("rate"), F.col("doc_id"))).withColumns(
        {"excess": F.lit(round(fit.excess, 6)), "converged": F.lit(fit.converged)}
    )


def copies(rate, doc_id):
    draw = F.pmod(F.xxhash64(doc_id, F.lit(SALT)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mixed(
    docs: DataFrame,
    labels: DataFrame,
    targets: dict[str, float] = TARGETS,
    most: float = np.inf,
    spared: str | None = None,
    **options,
) -> DataFrame:
    """The rows of ``docs``, each as often as its copies say, all columns as they are. Rates are computed in the scan, so
    no text is shuffled. Documents of the ``spared`` domain are all there at least once; targets that this puts out of
    reach are met as near as it allows. Warns when the fit has not converged."""
    mixer = fit_domains(docs, domain_labels(labels), most=most)
    mixer.spared = spared
    fit = fit_rates(posteriors(docs, mixer), mixer, targets, **options)
    if not fit.converged:
        warnings.warn(f"rates have not converged after {fit.iterations} steps: {fit.reached} for {fit.wanted}", stacklevel=2)

    r, n = free_name(docs, "_rate"), free_name(docs, "_copies")

    def rates(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = [np.zeros(0)]
            for part in slices(pa.record_batch([texts], names=["text"]), "text", SLICE_BYTES, SLICE_ROWS):
                out.append(mixer.rates(mixer.probabilities(part.column("text"))))
            yield pa.array(np.concatenate(out))
        give_back()

    # Only the text goes to Python and only the rate comes back. Not to be evaluated twice, so called nondeterministic.
    rate = F.arrow_udf(rates, "double").asNondeterministic()
    rated = docs.withColumn(r, rate(text_of(docs)))
    counted = rated.withColumn(n, copies(F.col(r), F.col("doc_id"))).drop(r)
    return counted.filter(F.col(n) > 0).select(
        *[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(n))).alias(n)
    ).drop(n)

"""Quality classifier: naive Bayes support vectors over hashed character n-grams.

A text is the set of its byte 2-, 3- and 4-grams, hashed into buckets. Each indicator is scaled
by the log-count ratio of its bucket between the classes, rows are scaled to unit length, and a
linear hinge-loss model is fitted by dual coordinate descent; the margin is mapped to a
probability by a logistic curve fitted to the training margins.

The model is fitted on a bounded sample of labelled rows, `sample_rows` in expectation, chosen
by a hash of the id. Its size is a parameter and doesn't follow the data, so the sampled ids
are broadcast and texts never leave their split; fitting is one small task. Scoring is one
pass over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.tables import fold, table
from ledgerloom.llm.text import utf8

SAMPLE_ROWS = 12_000
_BITS = 18
_ORDERS = (2, 3, 4)
_HASH = np.uint32(0x9E3779B1)


def labelled_sample(labels: DataFrame, label: str, sample_rows: int) -> DataFrame:
    """About `sample_rows` rows (doc_id, label), by a hash of doc_id; of repeated ids the largest label."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    share = min(1.0, sample_rows / max(1, known.count()))
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))


class BucketSets:
    """Distinct n-gram buckets of a text, by one mark per bucket."""

    def __init__(self) -> None:
        self._marks = np.zeros(1 << _BITS, bool)

    def __call__(self, data: np.ndarray) -> np.ndarray:
        codes = data.astype(np.uint32)
        gram = codes
        for order in range(2, max(_ORDERS) + 1):
            if len(data) < order:
                break
            gram = (gram[:-1] << np.uint32(8)) | codes[order - 1 :]
            if order in _ORDERS:
                self._marks[((gram + np.uint32(order)) * _HASH) >> np.uint32(32 - _BITS)] = True
        found = np.flatnonzero(self._marks)
        self._marks[found] = False
        return found


@dataclass
class QualityModel:
    """Weight and log-count ratio of each bucket, bias, and slope and shift of the logistic curve."""

    weights: np.ndarray
    ratio: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, buckets: np.ndarray) -> float:
        norm = float(np.linalg.norm(self.ratio[buckets]))
        margin = self.bias + (float(self.weights[buckets].sum()) / norm if norm else 0.0)
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30))))


def _fit_hinge(rows: list[np.ndarray], values: list[np.ndarray], signs: np.ndarray, cost: float, rounds: int) -> np.ndarray:
    """Dual coordinate descent for the L2-regularised hinge loss; rows have unit length plus the bias term."""
    weights = np.zeros((1 << _BITS) + 1)
    duals = np.zeros(len(rows))
    order = np.random.default_rng(0)
    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i], values[i], signs[i]
            gradient = y * (float(weights[at] @ x) + weights[-1]) - 1
            new = min(max(duals[i] - gradient / 2, 0.0), cost)
            if new != duals[i]:
                step = (new - duals[i]) * y
                weights[at] += step * x
                weights[-1] += step
                duals[i] = new
    return weights


def _fit_logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton's method on smoothed targets."""
    n1, n0 = float(labels.sum()), float((1 - labels).sum())
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones_like(margins)], 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (target - p))
        beta += step
        if abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def train_model(features: list[np.ndarray], labels: np.ndarray, cost: float, rounds: int) -> QualityModel:
    """Fit on bucket sets; with one class or none, the constant that the labels give."""
    size = 1 << _BITS
    if len(set(labels.tolist())) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2)
        return QualityModel(np.zeros(size), np.zeros(size), 0.0, 1.0, float(np.log(share / (1 - share))))
    counts = [np.ones(size), np.ones(size)]
    for found, label in zip(features, labels):
        counts[label][found] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    ratio[(counts[0] + counts[1]) < 4] = 0  # seen once or never: no evidence
    values = [(v := ratio[f]) / (np.linalg.norm(v) or 1.0) for f in features]
    signs = labels * 2.0 - 1
    fitted = _fit_hinge(features, values, signs, cost, rounds)
    # rows are scaled by their own length, so each bucket's ratio goes into its weight
    margins = np.array([float(fitted[f] @ v) for f, v in zip(features, values)]) + fitted[-1]
    slope, shift = _fit_logistic(margins, labels)
    return QualityModel(fitted[:-1] * ratio, ratio, float(fitted[-1]), slope, shift)


def fit_quality(docs: DataFrame, sample: DataFrame, cost: float = 1.0, rounds: int = 12) -> QualityModel:
    """Fit on docs (doc_id, text) that sample (doc_id, label) names; sample must be of bounded size.

    A doc_id counts once, however many rows share it: with the least of their bucket sets.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket_sets = BucketSets()
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            found = [bucket_sets(data[offsets[i] : offsets[i + 1]]).astype(np.int32) for i in range(batch.num_rows)]
            ends = np.cumsum([0, *map(len, found)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found) if found else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([lists, batch.column(1), batch.column(2)], ["buckets", "label", "doc_id"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            offsets, values = batch.column(0).offsets.to_numpy(), batch.column(0).values.to_numpy()
            rows += [(doc_id, label, values[offsets[i] : offsets[i + 1]].copy()) for i, (label, doc_id) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))]
        rows.sort(key=lambda x: x[:2])
        model = train_model([x[2] for x in rows], np.array([x[1] for x in rows], np.int64), cost, rounds)
        used = np.flatnonzero(model.ratio)
        head = np.array([model.bias, model.slope, model.shift])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2, -3], used]), pa.int32()), pa.array(np.concatenate([head, model.weights[used]])), pa.array(np.concatenate([head * 0, model.ratio[used]]))], ["bucket", "weight", "ratio"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("text", "label", "doc_id")
    features = rows.mapInArrow(extract, "buckets array<int>, label int, doc_id long")
    features = features.groupBy("doc_id").agg(F.min("buckets").alias("buckets"), F.min("label").alias("label")).select("buckets", "label", "doc_id").repartition(1)
    fitted = features.mapInArrow(fit, "bucket int, weight double, ratio double").toPandas()  # one row per bucket at most
    model = QualityModel(np.zeros(1 << _BITS), np.zeros(1 << _BITS), 0.0, 1.0, 0.0)
    head = fitted.set_index("bucket").weight
    if len(fitted):
        model.bias, model.slope, model.shift = float(head[-1]), float(head[-2]), float(head[-3])
        own = fitted[fitted.bucket >= 0]
        model.weights[own.bucket] = own.weight
        model.ratio[own.bucket] = own.ratio
    return model


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.5) -> DataFrame:
    """doc_id, score and predicted of each row of docs, from its whole text.

    docs: needs doc_id and text; other columns are ignored. Null texts count as empty, and an
    empty text gets the score of the bias alone. Repeated rows are scored each for itself, an
    empty table gives no rows.
    """
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket_sets = BucketSets()
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            scores = np.empty(batch.num_rows)
            for i in range(batch.num_rows):
                scores[i] = model.score(bucket_sets(data[offsets[i] : offsets[i + 1]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scored, "doc_id long, score double, predicted int")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from the folds other than 0 of 5."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    sample = labelled_sample(labels.where(fold("doc_id", 5) != 0), "quality", SAMPLE_ROWS)
    model = fit_quality(docs, sample)
    return score_quality(docs, model, threshold=0.3).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")

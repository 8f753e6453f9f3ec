"""Toxicity by a factorization machine over hashed terms.

Terms are the lower-cased words of a text and the first letters of its longer words, hashed to
buckets. The score is the logistic of bias + sum of term weights + sum over term pairs of the
inner product of their factors, so a pair can count for more than its parts: an insult next to
the mention of a group weighs more than either alone.

The machine is fitted on a bounded sample of labelled rows (`sample_rows` in expectation, chosen
by a hash of the id; its size is a parameter and doesn't follow the data). The sampled ids are
broadcast, so texts never leave their split. All of the sample's terms take part, in a fixed
number of buckets; none is tested by itself, as a pair may count whose parts don't. Rare terms
are damped and weak ones fall to zero by the penalty of the joint fit. Scoring is one pass over
all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.quality import labelled_sample
from ledgerloom.llm.tables import fold, table
from ledgerloom.llm.text import byte_class, chunks, runs, span_hashes, utf8

SAMPLE_ROWS, FACTORS = 30_000, 8
#: Buckets of hashed terms, as a power of two; and bytes of a word's head.
_BITS, _HEAD = 20, 5
#: Rows of a training batch; occurrences at which a term counts half; penalties of weights and factors, over the root of the sample's size.
_BATCH, _HALF, _PENALTIES = 1024, 20, (0.17, 0.17)
_SEPARATORS = bytes(b for b in range(0x80) if not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A))


@dataclass
class ToxicityModel:
    """Sorted buckets of the terms that count, with their weights and factors, and the bias."""

    buckets: np.ndarray
    weights: np.ndarray
    factors: np.ndarray
    bias: float

    def score(self, present: np.ndarray) -> float:
        """Score of a text that holds the terms at these places of `buckets`."""
        own = self.factors[present]
        total = own.sum(0)
        value = self.bias + self.weights[present].sum() + 0.5 * float(total @ total - (own * own).sum())
        return float(1 / (1 + np.exp(-np.clip(value, -30, 30))))


def term_buckets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row and the buckets of its terms, with repeats."""
    data, offsets = utf8(column)
    words = byte_class(_SEPARATORS)
    for first, end in chunks(offsets):
        raw = np.frombuffer(data[offsets[first] : offsets[end]].tobytes().lower(), np.uint8)
        starts, ends, before = runs(words[raw], offsets[first : end + 1] - offsets[first])
        whole = span_hashes(raw, starts, ends) >> np.uint64(64 - _BITS)
        long = ends - starts > _HEAD
        # heads have hashes of their own, apart from equal whole words
        heads = (span_hashes(raw, starts[long], starts[long] + _HEAD) * np.uint64(3)) >> np.uint64(64 - _BITS)
        head_before = np.concatenate([[0], np.cumsum(long)])[before]
        for i in range(end - first):
            yield first + i, np.concatenate([whole[before[i] : before[i + 1]], heads[head_before[i] : head_before[i + 1]]]).astype(np.int64)


def _batch(places: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries of a batch ordered by term: row of each, first entry and column of each term, and its column's number of entries."""
    at = np.concatenate([places[ends[r] : ends[r + 1]] for r in rows])
    order = np.argsort(at, kind="stable")
    row, at = np.repeat(np.arange(len(rows), dtype=np.int32), np.diff(ends)[rows])[order], at[order]
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return row, first, at[first], np.diff(np.append(first, len(at)))


def train_machine(features: list[np.ndarray], labels: np.ndarray, factors: int, steps: int = 400) -> ToxicityModel:
    """Fit by proximal Adam in batches on the distinct term buckets of each row; with one class, the constant that the labels give."""
    share = (labels.sum() + 1) / (len(labels) + 2)
    bias = float(np.log(share / (1 - share)))
    empty = ToxicityModel(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, factors)), bias)
    ends = np.cumsum([0, *map(len, features)])
    if len(set(labels.tolist())) < 2 or not ends[-1]:
        return empty
    buckets, places = np.unique(np.concatenate(features), return_inverse=True)
    counts = np.bincount(places)
    damped, places = (counts / (counts + _HALF)).astype(np.float32), places.astype(np.int32)
    draw = np.random.default_rng(0)
    parts = np.array_split(draw.permutation(len(features)), -(-len(features) // _BATCH))
    batches = [_batch(places, ends, rows) for rows in parts]
    state = [np.zeros(len(buckets), np.float32), draw.normal(0, 0.02, (len(buckets), factors)).astype(np.float32), np.array([bias], np.float32)]
    first, second = [np.zeros_like(s) for s in state], [np.zeros_like(s) for s in state]
    penalties, decay, dealt = [p / np.sqrt(len(features)) for p in _PENALTIES] + [0.0], (1e-5, 1e-4, 0.0), []
    settled = steps * 5 // 8
    for step in range(1, steps + 1):
        if step == settled + 1:  # what the penalty left is fitted without it; the other terms add exactly nothing and are left out
            counted = (state[0] != 0) | (state[1] != 0).any(1)
            buckets, damped = buckets[counted], damped[counted]
            for held in (state, first, second):
                held[:2] = [x[counted] for x in held[:2]]
            stays = counted[places]
            ends = np.concatenate([[0], np.cumsum(stays)])[ends]
            places = (np.cumsum(counted) - 1).astype(np.int32)[places[stays]]
            batches = [_batch(places, ends, rows) for rows in parts]
        dealt = dealt or draw.permutation(len(batches)).tolist()
        number = dealt.pop()
        row, starts, columns, sizes = batches[number]
        y = labels[parts[number]].astype(np.float32)
        scale, n = damped[columns], len(y)
        w, v = state[0][columns] * scale, state[1][columns] * scale[:, None]
        entries = np.repeat(v, sizes, axis=0)
        total = np.stack([np.bincount(row, entries[:, f], n) for f in range(factors)], 1).astype(np.float32)
        value = state[2] + np.bincount(row, np.repeat(w - 0.5 * (v * v).sum(1), sizes), n) + 0.5 * (total * total).sum(1)
        error = ((1 / (1 + np.exp(-np.clip(value, -30, 30))) - y) / n).astype(np.float32)
        slopes = [d * s for d, s in zip(decay, state)]
        if len(columns):
            slope = np.add.reduceat(error[row], starts)
            slopes[0][columns] += slope * scale
            slopes[1][columns] += (np.add.reduceat((error[:, None] * total)[row], starts, axis=0) - slope[:, None] * v) * scale[:, None]
        slopes[2] += error.sum()
        rate = np.float32(0.05 * min(1, 2 * (1 - step / (steps + 1))))
        for k in range(3):
            first[k] *= 0.9
            first[k] += 0.1 * slopes[k]
            second[k] *= 0.999
            second[k] += 0.001 * np.square(slopes[k], out=slopes[k])
            pace = second[k] / np.float32(1 - 0.999**step)
            np.sqrt(pace, out=pace)
            pace += 1e-3
            np.divide(rate, pace, out=pace)
            moved = state[k] - pace * (first[k] / np.float32(1 - 0.9**step))
            if step > settled:
                state[k] = np.where(state[k] != 0, moved, np.float32(0))
                continue
            pace *= np.float32(penalties[k] * min(1, 2 * step / steps))
            state[k] = moved - np.clip(moved, -pace, pace)
    return ToxicityModel(buckets, (state[0] * damped).astype(float), (state[1] * damped[:, None]).astype(float), float(state[2][0]))


def fit_toxicity(docs: DataFrame, sample: DataFrame, factors: int = FACTORS) -> ToxicityModel:
    """Fit on docs (doc_id, text) that sample (doc_id, label) names; sample must be of bounded size.

    A doc_id counts once, however many rows share it: with the least of their term sets.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(buckets) for _, buckets in term_buckets(batch.column(0))]
            ends = np.cumsum([0, *map(len, found)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found) if found else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([lists, batch.column(1), batch.column(2)], ["terms", "label", "doc_id"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            offsets, values = batch.column(0).offsets.to_numpy(), batch.column(0).values.to_numpy()
            rows += [(doc_id, label, values[offsets[i] : offsets[i + 1]].copy()) for i, (label, doc_id) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))]
        if not rows:
            return
        rows.sort(key=lambda x: x[:2])
        model = train_machine([x[2] for x in rows], np.array([x[1] for x in rows], np.int64), factors)
        numbers = np.column_stack([model.weights, model.factors])
        yield pa.RecordBatch.from_arrays([pa.array([model.bias]), pa.array([model.buckets.tobytes()]), pa.array([numbers.tobytes()])], ["bias", "buckets", "numbers"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("text", "label", "doc_id")
    features = rows.mapInArrow(extract, "terms array<long>, label int, doc_id long")
    features = features.groupBy("doc_id").agg(F.min("terms").alias("terms"), F.min("label").alias("label")).select("terms", "label", "doc_id").repartition(1)
    fitted = features.mapInArrow(fit, "bias double, buckets binary, numbers binary").first()  # one row, of a bounded number of buckets
    if not fitted:
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, factors)), 0.0)
    own = np.frombuffer(fitted.numbers, float).reshape(-1, factors + 1)
    return ToxicityModel(np.frombuffer(fitted.buckets, np.int64), own[:, 0], own[:, 1:], fitted.bias)


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score and predicted of each row of docs, from its whole text, and the `carry` columns (may hold doc_id).

    docs: needs doc_id and text; columns not in `carry` are ignored. Null texts count as empty; an
    empty text has the score of the bias alone. Repeated rows are scored each for itself, an empty
    table gives no rows. Without labelled rows the score is 0.5 for all.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.full(batch.num_rows, model.score(np.zeros(0, np.int64)))
            for row, found in term_buckets(batch.column(1)):
                if len(found) and len(model.buckets):
                    at = np.minimum(np.searchsorted(model.buckets, found), len(model.buckets) - 1)
                    scores[row] = model.score(np.unique(at[model.buckets[at] == found]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), batch.column(2)], ["doc_id", "score", "predicted", "carry"])

    held = F.struct(*carry) if carry else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("carry"))
    kind = rows.schema["carry"].dataType.simpleString()
    out = rows.mapInArrow(scored, f"doc_id long, score double, predicted int, carry {kind}")
    return out.select(*(() if "doc_id" in carry else ("doc_id",)), "score", "predicted", *(F.col("carry")[c].alias(c) for c in carry))


def fitted_on_labels(spark: SparkSession, docs: DataFrame, sf_dir: str) -> ToxicityModel:
    """Machine learnt from the folds other than 0 of 5 of the labels table."""
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    return fit_toxicity(docs, labelled_sample(labels, "toxic", SAMPLE_ROWS))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents")
    model = fitted_on_labels(spark, docs, sf_dir)
    return score_toxicity(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")

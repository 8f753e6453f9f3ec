"""Hard negatives by a norm-bucketed search for inner products.

Vectors are dealt into slices by norm. An anchor block meets a slice in a cell, one task's work
of bounded size, in which candidates are sorted by norm, longest first, and cut into buckets. By
Cauchy-Schwarz no score in a bucket exceeds the anchor's norm times the bucket's greatest norm:
a bucket, and with it all shorter ones, is left out for anchors whose bound lies under the lower
limit of each of their windows or under the running k-th score. The same bound keeps anchors
from slices before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.tables import checkpointed, table

#: Components of a slice's or a block's vectors, at most on average: what each side brings to a cell.
CELL_COMPONENTS = 1 << 23
#: Rows of a slice where there are few, so that tasks share the work.
LEAST_ROWS = 1024
#: Candidates of a bucket, and anchors that are scored at a time.
BUCKET_ROWS, ANCHOR_ROWS = 2048, 1024
#: Ranges of norms at most; each has slices of its own.
NORM_RANGES = 64
#: A score must fit a long, so vectors are shorter than this.
LONGEST = 2.0**31
#: Allowance for the rounding of norms, which bounds must not fall short by.
_SLACK = 1 + 1e-9
#: Stands for no score; unlike the least long it has a negative.
_NONE, _MOST = np.iinfo(np.int64).min + 1, np.iinfo(np.int64).max
_HIT = "anchor_key long, window int, found_id long, score long"
_NO_HITS = pa.table({"anchor_key": pa.array([], pa.int64()), "window": pa.array([], pa.int32()), "found_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})


@dataclass(frozen=True)
class Mining:
    """Positives of an anchor, negatives of a window, and the window in percent of a positive's score."""

    positives: int = 5
    negatives: int = 10
    least_pct: int = 30
    most_pct: int = 90
    scale: int = 256


def packed_vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, norm, width, packed: vectors with components floor(scale * x), as little-endian integers.

    Rows with a null id, label, vector or component, or a component that isn't finite, are left
    out, as are those of 2**31 and longer, whose scores no long holds. Equal rows count once.
    width: bytes of a component, 2 where all fit and 8 otherwise.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            lists = batch.column(2)
            values, offsets = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            x = values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
            with np.errstate(over="ignore"):  # too long a vector, left out below
                scaled = np.floor(scale * np.where(np.isfinite(x), x, 0))
                squared = scaled * scaled
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            norms = np.sqrt(np.where(offsets[:-1] == offsets[1:], 0, np.add.reduceat(np.append(squared, 0), offsets[:-1])))
            kept = np.flatnonzero((bad[offsets[1:]] == bad[offsets[:-1]]) & (norms < LONGEST))
            narrow = norms < 2**15
            rows = [scaled[offsets[i] : offsets[i + 1]].astype("<i2" if narrow[i] else "<i8").tobytes() for i in kept]
            widths = np.where(narrow[kept], 2, 8).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), batch.column(1).take(pa.array(kept)), pa.array(norms[kept]), pa.array(widths), pa.array(rows, pa.binary())], ["vec_id", "label", "norm", "width", "packed"])

    own = embeddings.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>")).where("vec_id is not null and label is not null and embedding is not null")
    packed = own.mapInArrow(pack, "vec_id long, label long, norm double, width int, packed binary")
    return packed.dropDuplicates(["vec_id", "label", "width", "packed"])


def matrix(packed: pa.ChunkedArray, widths: np.ndarray, dimensions: int) -> np.ndarray:
    """Packed vectors as rows of integers; shorter vectors end with zeros."""
    packed = packed.combine_chunks()
    sizes = pc.binary_length(packed).to_numpy()
    out = np.zeros((len(packed), dimensions), np.int64)
    for width, size in {*zip(widths.tolist(), sizes.tolist())}:
        rows = np.flatnonzero((widths == width) & (sizes == size))
        joined = b"".join(packed.take(pa.array(rows)).to_pylist())
        out[rows, : size // width] = np.frombuffer(joined, f"<i{width}").reshape(len(rows), size // width)
    return out


class Best:
    """The k best (score, id) of each anchor's windows so far: higher scores first, then smaller ids."""

    def __init__(self, shape: tuple[int, int], k: int) -> None:
        self.k = k
        self.scores = np.full((*shape, k), _NONE)
        self.ids = np.zeros((*shape, k), np.int64)

    def add(self, window: int, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Takes up candidates (anchor row, score, id); ids are new to their rows."""
        touched = np.unique(rows)
        own = np.repeat(touched, self.k)
        rows = np.concatenate([own, rows])
        scores = np.concatenate([self.scores[touched, window].ravel(), scores])
        ids = np.concatenate([self.ids[touched, window].ravel(), ids])
        order = np.lexsort((ids, -scores, rows))
        rows, scores, ids = rows[order], scores[order], ids[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        first = place < self.k
        self.scores[rows[first], window, place[first]] = scores[first]
        self.ids[rows[first], window, place[first]] = ids[first]


def search(anchors: np.ndarray, least: np.ndarray, most: np.ndarray, k: int, candidates: np.ndarray, ids: np.ndarray, allowed: Callable[[slice, np.ndarray], np.ndarray]) -> tuple[Best, int]:
    """Best k candidates with scores from `least` to `most` (anchors x windows), and the number of scores computed.

    allowed: for a run of anchors and places of candidates, which may take which, as booleans of that shape.
    """
    own_norms = np.sqrt((anchors.astype(np.float64) ** 2).sum(1))
    norms = np.sqrt((candidates.astype(np.float64) ** 2).sum(1))
    by_norm = np.argsort(-norms, kind="stable")
    exact = own_norms.max(initial=0) * norms.max(initial=0) < 2.0**52  # then doubles add up without rounding
    kind = np.float64 if exact else np.int64
    best, scored = Best(least.shape, k), 0
    for at in range(0, len(anchors), ANCHOR_ROWS):
        block = slice(at, min(at + ANCHOR_ROWS, len(anchors)))
        block_rows = anchors[block].astype(kind)
        for bucket in range(0, len(by_norm), BUCKET_ROWS):
            inside = by_norm[bucket : bucket + BUCKET_ROWS]
            bound = own_norms[block] * norms[inside[0]] * _SLACK
            limits = np.maximum(least[block], best.scores[block, :, -1])
            open_windows = (bound[:, None] >= limits) & (least[block] <= most[block])
            alive = np.flatnonzero(open_windows.any(1))
            if not len(alive):
                break  # later buckets are shorter still
            scores = (block_rows[alive] @ candidates[inside].astype(kind).T).astype(np.int64)
            scored += scores.size
            may = allowed(block, inside)[alive]
            for window in np.flatnonzero(open_windows.any(0)):
                fits = may & (scores >= limits[alive, window, None]) & (scores <= most[block][alive, window, None])
                if np.count_nonzero(fits) > 16 * k * len(alive):
                    kth = np.partition(np.where(fits, scores, _NONE), len(inside) - k, axis=1)[:, -k] if len(inside) > k else np.full(len(alive), _NONE)
                    fits &= scores >= kth[:, None]
                rows, columns = np.nonzero(fits)
                if len(rows):
                    best.add(window, alive[rows] + at, scores[rows, columns], ids[inside[columns]])
    return best, scored


def slices(vectors: DataFrame, rows: int, total: int) -> tuple[Column, list[tuple[int, float]]]:
    """Slice of a row of (norm, vec_id), and the slices with their greatest norms, for about `rows` rows in each of `total`.

    A range of norms with more rows is dealt to several slices by a hash, so equal norms spread
    too. What reaches the driver is a row for each range.
    """
    ranges = min(NORM_RANGES, -(-total // rows))
    cuts = vectors.agg(F.percentile_approx("norm", F.array(*(F.lit(i / ranges) for i in range(1, ranges + 1))))).first()[0]
    range_of = sum((F.col("norm") > cut).cast("int") for cut in sorted(set(cuts[:-1]))) + F.lit(0)
    shares, firsts, known = {}, {}, []
    for number, n, most in sorted(vectors.groupBy(range_of.alias("range")).agg(F.count("*"), F.max("norm")).collect()):
        firsts[number], shares[number] = len(known), -(-n // rows)
        known += [(len(known) + i, most) for i in range(shares[number])]
    value = lambda of: F.create_map(*(F.lit(x) for item in of.items() for x in item))[range_of]
    return (value(firsts) + F.pmod(F.xxhash64("vec_id", "packed"), value(shares))).cast("int"), known


def mine_hard_negatives(embeddings: DataFrame, anchors: Column, settings: Mining = Mining()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    embeddings: vec_id, label, embedding. anchors: which rows are anchors, over vec_id and label.
    See `packed_vectors` for rows that take no part; vectors of other lengths are scored as if the
    shorter ended with zeros. A score is the integer inner product; higher ones come first, ties by
    smaller vec_id. Positives: the first rows of the same label with other ids. For each, the first
    rows of other labels whose score lies in the window of its score. Rows that share an id but
    differ are rows of their own, and their anchors' results are told apart only by their values.
    Empty tables and anchors without positives give no rows.
    """
    vectors = checkpointed(packed_vectors(embeddings, settings.scale))
    total, dimensions = vectors.agg(F.count("*"), F.max(F.octet_length("packed") / F.col("width")).cast("int")).first()
    if not total:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    most_rows = max(LEAST_ROWS, CELL_COMPONENTS // max(dimensions, 1))
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slice_of, known = slices(vectors, min(most_rows, max(LEAST_ROWS, -(-total // tasks))), total)
    queries = vectors.where(anchors).withColumn("anchor_key", F.xxhash64("vec_id", "label", "width", "packed"))
    blocks = max(1, -(-queries.count() // most_rows))
    queries = queries.withColumn("block", F.pmod("anchor_key", F.lit(blocks)).cast("int"))
    # columns of their own names: the two sides of a cogroup must not share any
    candidates = vectors.select(*(F.col(c).alias(f"other_{c}") for c in ("vec_id", "label", "width", "packed")), slice_of.alias("slice")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(anchors: DataFrame, least: Column | None, task: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
        """Hits of the cells: every anchor by the slices that may hold a score of `least`, every candidate by the blocks."""
        reached = F.array(*(F.struct(F.lit(number).alias("slice"), F.lit(most).alias("most")) for number, most in known))
        if least is not None:
            reached = F.filter(reached, lambda s: s["most"] * F.col("norm") * _SLACK >= least)
        dealt = anchors.withColumn("reached", F.explode(reached)).withColumn("slice", F.col("reached.slice")).drop("reached")
        return dealt.groupBy("block", "slice").cogroup(candidates.groupBy("block", "slice")).applyInArrow(task, _HIT)

    def loaded(side: pa.Table, prefix: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        packed, width, ids, labels = (side[prefix + c] for c in ("packed", "width", "vec_id", "label"))
        return matrix(packed, width.to_numpy(), dimensions), ids.to_numpy(), labels.to_numpy()

    def positives(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return _NO_HITS
        (a, a_ids, a_labels), (b, b_ids, b_labels) = loaded(left, ""), loaded(right, "other_")
        parts, labels = [], np.unique(a_labels)
        a_order, b_order = np.argsort(a_labels, kind="stable"), np.argsort(b_labels, kind="stable")
        bounds = [np.searchsorted(own[order], labels, side) for own, order in ((a_labels, a_order), (b_labels, b_order)) for side in ("left", "right")]
        for a_from, a_to, b_from, b_to in zip(*bounds):
            mine, theirs = a_order[a_from:a_to], b_order[b_from:b_to]
            own, other = a_ids[mine], b_ids[theirs]
            limits = np.full((len(mine), 1), _NONE), np.full((len(mine), 1), _MOST)
            best, _ = search(a[mine], *limits, settings.positives, b[theirs], other, lambda block, inside: own[block][:, None] != other[inside])  # noqa: B023
            parts.append(_hits(best, left["anchor_key"].take(pa.array(mine))))
        return pa.concat_tables(parts)

    def negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return _NO_HITS
        least, most = np.full((2, left.num_rows, settings.positives), _MOST)
        most[:] = _NONE
        for i, scores in enumerate(left["scores"].to_pylist()):
            least[i, : len(scores)] = [-(-settings.least_pct * score // 100) for score in scores]
            most[i, : len(scores)] = [settings.most_pct * score // 100 for score in scores]
        (a, _, a_labels), (b, b_ids, b_labels) = loaded(left, ""), loaded(right, "other_")
        best, _ = search(a, least, most, settings.negatives, b, b_ids, lambda block, inside: a_labels[block][:, None] != b_labels[inside])
        return _hits(best, left["anchor_key"])

    def first(hits: DataFrame, k: int, *by: str) -> DataFrame:
        return hits.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "found_id"))).where(F.col("rank") <= k)

    near = first(meet(queries, None, positives), settings.positives, "anchor_key").groupBy("anchor_key").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("found_id").alias("id"), "score"))).alias("positives"))
    armed = checkpointed(queries.join(near, "anchor_key").withColumn("scores", F.col("positives.score")))
    least = F.array_min(F.transform(F.filter("scores", lambda s: s >= 0), lambda s: s * settings.least_pct / 100))  # the window of a negative score is empty
    hard = first(meet(armed.drop("positives"), least, negatives), settings.negatives, "anchor_key", "window")
    named = hard.join(armed.select("anchor_key", F.col("vec_id").alias("anchor_id"), "positives"), "anchor_key").withColumn("positive", F.col("positives")[F.col("window")])
    return named.select("anchor_id", F.col("positive.id").alias("positive_id"), "rank", F.col("found_id").alias("negative_id"), F.col("positive.score").alias("positive_score"), F.col("score").alias("negative_score"))


def _hits(best: Best, keys: pa.ChunkedArray) -> pa.Table:
    rows, windows, places = np.nonzero(best.scores != _NONE)
    return pa.table({"anchor_key": keys.take(pa.array(rows)), "window": pa.array(windows, pa.int32()), "found_id": best.ids[rows, windows, places], "score": best.scores[rows, windows, places]})


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector of `embeddings`, among all vectors."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)

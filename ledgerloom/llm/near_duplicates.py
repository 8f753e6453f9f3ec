"""N-gram Jaccard join with Bayesian pruning of MinHash candidates.

Documents are sets of word 5-grams. Those with equal sets form a class, which one of them
stands for. Class representatives meet in buckets of banded MinHash values. There
pairs are compared value by value: after every 16 values a pair is dropped if the posterior
probability that its similarity reaches the threshold is below the tolerance. What survives
joins representatives into islands; an island's texts then come together, the survivors are
compared as sets, exactly, and similar ones are linked.

Pairs are never rows. A bucket's task gives a spanning forest of its survivors, an island's
task the number of links of every representative and a spanning forest of them. Buckets and
islands above a fixed size are cut into blocks, and every pair of blocks is a group of its own,
so no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.components import connected_components
from ledgerloom.llm.tables import checkpointed, table
from ledgerloom.llm.text import SPACES, byte_class, chunks, fixed_list, gram_hashes, mix, runs, span_hashes, utf8

WORDS, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
#: MinHash values per document, values per band, and values compared between two looks at the posterior.
HASHES, ROWS, LOOK = 128, 4, 16
#: Representatives, and 5-grams of their texts, per block of a bucket or island.
_BLOCK_ROWS, _BLOCK_GRAMS = 1_000, 1_500_000
_SEEDS = np.random.default_rng(20).integers(1, 1 << 32, (HASHES, 2), dtype=np.uint32) | np.array([1, 0], np.uint32)


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct hashes of its word n-grams; of all its words if there are fewer; none without words."""
    data, offsets = utf8(column)
    inside = byte_class(SPACES)
    for first, end in chunks(offsets):
        part = data[offsets[first] : offsets[end]]
        starts, ends, before = runs(inside[part], offsets[first : end + 1] - offsets[first])
        hashes = span_hashes(part, starts, ends)
        grams = gram_hashes(hashes, words)
        for row in range(first, end):
            a, b = before[row - first], before[row - first + 1]
            own = grams[a : b - words + 1] if b - a >= words else gram_hashes(hashes[a:b], int(b - a)) if b > a else grams[:0]
            yield row, np.unique(own)


def set_name(shingles: np.ndarray) -> int:
    """64-bit hash of a set of n-grams."""
    return int(mix(shingles).sum().view(np.int64))


def minhash(shingles: np.ndarray) -> np.ndarray:
    """HASHES least values of a set, each under its own permutation of the upper 32 bits."""
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(high), 4096):
        values = (high[start : start + 4096, None] ^ _SEEDS[:, 1]) * _SEEDS[:, 0]
        np.minimum(least, values.min(0), out=least)
    return least


@lru_cache(maxsize=4)
def least_matches(threshold: float, tolerance: float) -> np.ndarray:
    """Equal values, of each number compared, that a pair needs for its posterior to reach the tolerance.

    The similarity has a uniform prior. Values are compared by one byte, so two unequal ones
    agree once in 256.
    """
    grid = (np.arange(2_000) + 0.5) / 2_000
    match = grid + (1 - grid) / 256
    needed = np.zeros(HASHES + 1, np.int64)
    for n in range(LOOK, HASHES + 1, LOOK):
        for m in range(n + 1):
            log = m * np.log(match) + (n - m) * np.log1p(-np.minimum(match, 1 - 1e-12))
            weight = np.exp(log - log.max())
            if weight[grid >= threshold].sum() >= tolerance * weight.sum():
                needed[n] = m
                break
    return needed


def survivors(own: np.ndarray, others: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """Places of the rows of `others` that incremental comparison with `own` doesn't drop."""
    needed = least_matches(threshold, tolerance)
    alive, matches = np.arange(len(others)), np.zeros(len(others), np.int64)
    for n in range(LOOK, HASHES + 1, LOOK):
        matches = matches + (others[alive, n - LOOK : n] == own[n - LOOK : n]).sum(1)
        stays = matches >= needed[n]
        alive, matches = alive[stays], matches[stays]
        if not len(alive):
            break
    return alive


class Forest:
    """Union-find over the places of a group; `edges` are the unions that joined two trees."""

    def __init__(self, size: int) -> None:
        self.label = np.arange(size)
        self.edges: list[tuple[int, int]] = []

    def join(self, a: int, others: np.ndarray) -> None:
        for b in others:
            if self.label[a] != self.label[b]:
                self.edges.append((a, int(b)))
                self.label[self.label == self.label[b]] = self.label[a]


def _signed(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, set_a, set_b (hash of the n-gram set; null without words), grams, signature, bands."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            set_a, set_b, grams = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            signatures, bands = np.zeros((n, HASHES), np.uint8), np.zeros((n, HASHES // ROWS), np.uint64)
            for row, own in shingle_sets(batch.column(1), words):
                least = minhash(own)
                grams[row] = len(own)
                set_a[row], set_b[row] = set_name(own), mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum().view(np.int64)
                signatures[row] = mix(least.astype(np.uint64)) & np.uint64(0xFF)
                bands[row] = gram_hashes(mix(least.astype(np.uint64)), ROWS)[::ROWS] + np.arange(HASHES // ROWS, dtype=np.uint64)
            empty = grams == 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(set_a, mask=empty), pa.array(set_b, mask=empty), pa.array(grams), pa.array([r.tobytes() for r in signatures], pa.binary()), fixed_list(bands.ravel().view(np.int64), HASHES // ROWS, pa.int64())],
                ["doc_id", "set_a", "set_b", "grams", "signature", "bands"],
            )

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(sign, "doc_id long, set_a long, set_b long, grams long, signature binary, bands array<long>")


def _blocks(rows: DataFrame, keys: list[str], blocks: str) -> DataFrame:
    """Deals each row of a group to every pair of blocks that its own block is part of."""
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("rep"), F.col(blocks)).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1)))
    dealt = dealt.withColumns({"block_a": F.least("own", "other"), "block_b": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")}).drop(blocks, "own", "other")
    return dealt.repartition(*keys, "block_a", "block_b").sortWithinPartitions(*keys, "block_a", "block_b", "side", "rep")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[bool, list[tuple]]]:
    """Rows of equal leading `keys` columns, sorted together; whether all pairs count or only those across sides."""
    own, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != own:
                if len(rows) > 1:
                    yield own[-2] == own[-1], rows
                own, rows = row[:keys], []
            rows.append(row[keys:])
    if len(rows) > 1:
        yield own[-2] == own[-1], rows


def _later(i: int, sides: np.ndarray, inside: bool) -> np.ndarray:
    """Places that make a pair with i: those after it, on the other side if only those count."""
    later = np.arange(i + 1, len(sides))
    return later if inside else later[sides[i + 1 :] != sides[i]]


def _edge_batch(edges: set[tuple[int, int]]) -> pa.RecordBatch:
    pairs = sorted(edges)
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])


def _candidate_edges(buckets: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Spanning forests of the pairs that survive in each bucket; buckets: key, rep, blocks, signature."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: set[tuple[int, int]] = set()
        for inside, rows in _groups(batches, 3):
            sides, reps = np.array([r[0] for r in rows]), [r[1] for r in rows]
            signatures = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(-1, HASHES)
            forest = Forest(len(rows))
            for i in range(len(rows) - 1):
                later = _later(i, sides, inside)
                later = later[forest.label[later] != forest.label[i]]
                if len(later):
                    forest.join(i, later[survivors(signatures[i], signatures[later], threshold, tolerance)])
            edges.update((reps[a], reps[b]) for a, b in forest.edges)
            if len(edges) > 100_000:
                yield _edge_batch(edges)
                edges.clear()
        if edges:
            yield _edge_batch(edges)

    dealt = _blocks(buckets, ["key"], "blocks").select("key", "block_a", "block_b", "side", "rep", "signature")
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def _linked(members: DataFrame, threshold: float, tolerance: float, words: int) -> DataFrame:
    """(rep, links, peer) per representative and island group: linked documents, and one edge of a spanning forest or null.

    members: island, rep, blocks, copies, text.
    """

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for inside, rows in _groups(batches, 3):
            sets = [own for _, own in shingle_sets(pa.array([r[3] for r in rows], pa.string()), words)]
            right = [i for i, own in enumerate(sets) if set_name(own) == rows[i][1]]  # the others are of another class
            right = list({(rows[i][0], rows[i][1]): i for i in reversed(right)}.values())[::-1]  # texts of equal sets may differ
            rows, sets = [rows[i] for i in right], [sets[i] for i in right]
            if len(rows) < 2:
                continue
            sides, reps, copies = np.array([r[0] for r in rows]), [r[1] for r in rows], np.array([r[2] for r in rows])
            sizes = np.array([len(x) for x in sets])
            signatures = np.stack([mix(minhash(x).astype(np.uint64)) & np.uint64(0xFF) for x in sets]).astype(np.uint8)
            # postings: for every n-gram the places that hold it
            distinct, gram = np.unique(np.concatenate(sets), return_inverse=True)
            holder = np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(gram, kind="stable")
            posted, first = holder[order], np.concatenate([[0], np.cumsum(np.bincount(gram, minlength=len(distinct)))])
            at = np.concatenate([[0], np.cumsum(sizes)])
            links, forest = np.zeros(len(rows), np.int64), Forest(len(rows))
            for i in range(len(rows) - 1):
                later = _later(i, sides, inside)
                later = later[survivors(signatures[i], signatures[later], threshold, tolerance)]
                if not len(later):
                    continue
                low, high = first[gram[at[i] : at[i + 1]]], first[gram[at[i] : at[i + 1]] + 1]
                spans = np.repeat(low - np.concatenate([[0], np.cumsum(high - low)[:-1]]), high - low) + np.arange((high - low).sum())
                shared = np.bincount(posted[spans], minlength=len(rows))[later]
                similar = later[shared >= threshold * (sizes[i] + sizes[later] - shared) - 1e-9]
                links[i] += copies[similar].sum()
                links[similar] += copies[i]
                forest.join(i, similar)
            out = [(reps[i], int(links[i]), None) for i in np.flatnonzero(links)] + [(reps[a], 0, reps[b]) for a, b in forest.edges]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["rep", "links", "peer"])

    dealt = _blocks(members, ["island"], "blocks").select("island", "block_a", "block_b", "side", "rep", "copies", "text")
    return dealt.mapInArrow(verify, "rep long, links long, peer long")


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, class_id and n_links of each row of docs.

    docs: needs doc_id and text; other columns are ignored. Two documents are linked if the
    Jaccard similarity of their sets of `words` consecutive words (separated by ASCII white
    space) is at least `threshold`. class_id: the least doc_id that a chain of links reaches,
    its own included; n_links: the other rows that a row is linked to. A text of fewer words is
    the set of its one whole sequence; null and empty texts have no links. A repeated row counts
    as a copy and is answered again; rows that share a doc_id but not their text are judged each
    by its own text. Rows without a doc_id are
    not compared: class_id is null and n_links 0. An empty table gives no rows.

    Equal sets and exact checks are certain up to 64-bit hash collisions. A pair at the
    threshold shares no band once in 10**7, and is dropped with a probability of about
    `tolerance`; more similar pairs more rarely.
    """
    signed = checkpointed(_signed(docs, words))
    known = signed.where(F.col("set_a").isNotNull())
    # a class is named by its set, not by a doc_id, as rows that share one may differ in their texts
    classes = checkpointed(known.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("grams").alias("grams"), F.min_by("signature", "doc_id").alias("signature"), F.min_by("bands", "doc_id").alias("bands")).withColumnRenamed("set_a", "rep"))
    banded = classes.select(F.explode("bands").alias("key"), "rep")
    met = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / _BLOCK_ROWS).alias("blocks"))
    buckets = banded.join(met, "key").join(classes.select("rep", "signature"), "rep").select("key", "rep", "blocks", "signature")
    islands = checkpointed(connected_components(_candidate_edges(buckets, threshold, tolerance)).select(F.col("node").alias("rep"), F.col("component").alias("island")).join(classes.select("rep", "first_id", "copies", "grams"), "rep"))
    sizes = islands.groupBy("island").agg(F.greatest(F.ceil(F.count("*") / _BLOCK_ROWS), F.ceil(F.sum("grams") / _BLOCK_GRAMS)).alias("blocks"))
    texts = docs.select(F.col("doc_id").cast("long").alias("first_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    # of a doc_id with several texts all come along once; a task keeps the one that its class is named by
    members = islands.join(sizes, "island").select("island", "rep", "first_id", "blocks", "copies").join(texts, "first_id").dropDuplicates(["rep", "text_hash"])
    linked = checkpointed(_linked(members.select("island", "rep", "blocks", "copies", "text"), threshold, tolerance, words))
    components = checkpointed(connected_components(linked.where(F.col("peer").isNotNull()).select(F.col("rep").alias("a"), F.col("peer").alias("b"))).select(F.col("node").alias("rep"), "component").join(classes.select("rep", "first_id"), "rep"))
    least = components.groupBy("component").agg(F.min("first_id").alias("class_id"))
    named = components.join(least, "component").select("rep", "class_id")
    counted = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    answers = classes.select("rep", "set_b", "first_id", "copies").join(named, "rep", "left").join(counted, "rep", "left")
    answers = answers.select(F.col("rep").alias("set_a"), "set_b", F.coalesce("class_id", "first_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    with_words = known.select("doc_id", "set_a", "set_b").join(answers, ["set_a", "set_b"]).select("doc_id", "class_id", "n_links")
    wordless = signed.where(F.col("set_a").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    nameless = docs.where(F.col("doc_id").isNull()).select(F.col("doc_id").cast("long"), F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return with_words.unionByName(wordless).unionByName(nameless)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document at a 5-word Jaccard similarity of 0.8."""
    return jaccard_join(table(spark, sf_dir, "documents"))

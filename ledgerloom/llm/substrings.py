"""Substring deduplication with a compressed FM-index per shard.

A window is `length` consecutive words of a document; every word covered by a window that a
document with a smaller doc_id holds too is removed.

Streaming every document against every shard would cost the square of the corpus, so content
picks the shard. Each window selects an anchor, its least k-gram; documents that hold the same
window select the same anchor. The least doc_id among an anchor's documents owns it. Owners
send the words around their anchors to be indexed, the others send theirs to be matched, and
both go to the shard of the owner's lot: a stretch of its words. There an FM-index over the
owners' words is built, and backward search over its wavelet tree gives every interval of
`length` words or more that occurs in a document with a smaller id. A lot whose anchors very
many documents share is spread: its words are indexed in several copies of the shard and each
document picks one.

A window that its anchor's owner doesn't hold may still occur in another document. Such windows
are few (they contain an edit); they take part in a second round in which the window itself is
the anchor, so that the owner is the least document that holds it, up to 64-bit hash
collisions, which the index then decides. Windows found in neither round occur in no smaller
document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.fm_index import FmIndex, matching_intervals
from ledgerloom.llm.tables import checkpointed, table
from ledgerloom.llm.text import SPACES, byte_class, chunks, gram_hashes, mix, runs, span_hashes, utf8

LENGTH, ANCHOR = 50, 10
#: Words of an owner per lot; documents' anchors per copy of a lot; anchors per shard; windows per matched segment.
_LOT_WORDS, _COPY_ANCHORS, _SHARD_ANCHORS, _SEGMENT = 512, 30_000, 12_000, 256
#: Segments that are searched together.
_TOGETHER = 2_000
_PLACE = np.uint64(0xFFFFFFF)
_LOT_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_PIECES = "shard int, copy int, role int, doc_id long, row_key long, start long, text binary"
_FOUND = "doc_id long, row_key long, start long, end long, text binary"


def window_anchors(hashes: np.ndarray, bounds: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, the word at which each window's anchor starts, and the hash of every k-gram.

    hashes: of the words of several rows; bounds: words before each row. The anchor is the
    window's least k-gram by the upper bits of its hash, the rightmost of equal ones.
    """
    grams = gram_hashes(hashes, anchor)
    if len(hashes) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), grams
    places = np.arange(len(grams), dtype=np.uint64)
    least, width, span = (grams & ~_PLACE) | (_PLACE - places), 1, length - anchor + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    inside = np.zeros(len(least), bool)
    for a, b in zip(bounds[:-1], bounds[1:]):
        inside[a : max(a, b - length + 1)] = True
    starts = np.flatnonzero(inside)
    return starts, (_PLACE - (least[starts] & _PLACE)).astype(np.int64), grams


def _tokenised(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of rows: first, end, bytes, word starts and ends, words before each row, word hashes."""
    data, offsets = utf8(column)
    inside = byte_class(SPACES)
    for first, end in chunks(offsets):
        part = data[offsets[first] : offsets[end]]
        starts, ends, before = runs(inside[part], offsets[first : end + 1] - offsets[first])
        yield first, end, part, starts, ends, before, span_hashes(part, starts, ends)


def _anchor_rows(rows: DataFrame, length: int, anchor: int) -> DataFrame:
    """(anchor, place, doc_id, row_key, base) of rows (doc_id, row_key, base, text), each anchor of a row once, with its first word."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, _, _, _, before, hashes in _tokenised(batch.column(3)):
                _, at, grams = window_anchors(hashes, before, length, anchor)
                at = np.unique(at)
                row = np.searchsorted(before, at, side="right") - 1
                order = np.lexsort((at, grams[at], row))
                new = np.ones(len(at), bool)
                new[1:] = (np.diff(row[order]) != 0) | (grams[at[order[1:]]] != grams[at[order[:-1]]])
                chosen = order[new]
                index = pa.array(row[chosen] + first)
                own = [batch.column(i).take(index) for i in range(3)]
                place = at[chosen] - before[row[chosen]] + own[2].to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(grams[at[chosen]].view(np.int64)), pa.array(place), *own], ["anchor", "place", "doc_id", "row_key", "base"])

    return rows.mapInArrow(listed, "anchor long, place long, doc_id long, row_key long, base long")


def _pieces(rows: DataFrame, shared: DataFrame, anchors: DataFrame, shards: int, length: int, anchor: int) -> DataFrame:
    """Words around shared anchors, to be indexed (role 0) or matched (role 1)."""
    lists = anchors.join(shared, "anchor").groupBy("doc_id", "row_key", "base").agg(F.collect_list(F.struct("anchor", "owner", "lot", "copies")).alias("shared"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, bases = (batch.column(i).to_pylist() for i in range(3))
            lists_at = batch.column(4).offsets.to_numpy()
            owned = batch.column(4).values
            named = owned.field("anchor").to_numpy().view(np.uint64), owned.field("owner").to_numpy(), owned.field("lot").to_numpy(), owned.field("copies").to_numpy()
            for first, end, part, starts, ends, before, hashes in _tokenised(batch.column(3)):
                windows, at, grams = window_anchors(hashes, before, length, anchor)
                own = np.searchsorted(windows, before)
                out: list[tuple] = []
                for row in range(first, end):
                    a, b = own[row - first], own[row - first + 1]
                    mine = slice(lists_at[row], lists_at[row + 1])
                    if a == b or mine.start == mine.stop:
                        continue
                    order = np.argsort(named[0][mine])
                    wanted = named[0][mine][order]
                    where = np.minimum(np.searchsorted(wanted, grams[at[a:b]]), len(wanted) - 1)
                    hit = wanted[where] == grams[at[a:b]]
                    owner, lot, copies = (x[mine][order][where] for x in named[1:])
                    place = mix(owner.astype(np.uint64) * _LOT_FACTOR + lot.astype(np.uint64)) % np.uint64(shards)
                    # stretches of windows in a row whose anchors are of one lot
                    new = np.ones(b - a, bool)
                    new[1:] = (owner[1:] != owner[:-1]) | (lot[1:] != lot[:-1]) | (hit[1:] != hit[:-1])
                    cuts = np.append(np.flatnonzero(new), b - a)
                    for i, j in zip(cuts[:-1], cuts[1:]):
                        if not hit[i]:
                            continue
                        word, shard = int(windows[a + i]), int(place[i])
                        stop = int(windows[a + j - 1]) + length
                        if owner[i] == ids[row]:
                            text = _joined(part, starts, ends, word, stop)
                            out += [(shard, copy, 0, ids[row], keys[row], bases[row] + word - int(before[row - first]), text) for copy in range(copies[i])]
                        else:
                            copy = keys[row] % int(copies[i])
                            for w in range(word, stop - length + 1, _SEGMENT):
                                text = _joined(part, starts, ends, w, min(w + _SEGMENT - 1 + length, stop))
                                out.append((shard, copy, 1, ids[row], keys[row], bases[row] + w - int(before[row - first]), text))
                if out:
                    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["shard", "copy", "role", "doc_id", "row_key", "start", "text"])

    return rows.join(lists, ["doc_id", "row_key", "base"]).select("doc_id", "row_key", "base", "text", "shared").mapInArrow(cut, _PIECES)


def _joined(part: np.ndarray, starts: np.ndarray, ends: np.ndarray, word: int, stop: int) -> bytes:
    """Words [word, stop) joined by one space."""
    return b" ".join(part[starts[word] : ends[stop - 1]].tobytes().split())


class Shard:
    """One copy of a shard: the owners' words, then searches."""

    def __init__(self, length: int) -> None:
        self.length = length
        self._texts: list[tuple[int, bytes]] = []
        self._index: FmIndex | None = None

    def add(self, doc_id: int, text: bytes) -> None:
        self._texts.append((doc_id, text))

    def _build(self) -> None:
        self._symbols = {}
        symbols, owners, name = [], [], self._symbols.setdefault
        self._owners = np.unique([d for d, _ in self._texts])
        for doc_id, text in self._texts:
            words = text.split()
            symbols += [name(w, len(self._symbols) + 2) for w in words]
            symbols.append(1)
            owners.append(np.full(len(words) + 1, np.searchsorted(self._owners, doc_id)))
        self._index = FmIndex(np.array(symbols, np.int64), np.concatenate(owners).astype(np.int64))
        self._texts = []

    def match(self, queries: list[tuple]) -> Iterator[tuple]:
        """Of (doc_id, row_key, start, text): matched intervals with no text, and unmatched runs with theirs."""
        if self._index is None and self._texts:
            self._build()
        split = [q[3].split() for q in queries]
        offsets = np.concatenate([[0], np.cumsum([len(w) for w in split])])
        covered = np.zeros(offsets[-1] + 1, np.int64)
        if self._index is not None:
            words = np.fromiter((self._symbols.get(w, -1) for ws in split for w in ws), np.int64, offsets[-1])
            below = np.searchsorted(self._owners, [q[0] for q in queries])
            number, begin, end = matching_intervals(self._index, words, offsets, below, self.length)
            for k, a, b in zip(number.tolist(), begin.tolist(), end.tolist()):
                doc_id, key, start, _ = queries[k]
                yield doc_id, key, start + a - int(offsets[k]), start + b - int(offsets[k]), None
            np.add.at(covered, begin, 1)
            np.add.at(covered, end - self.length + 1, -1)
        windows = np.cumsum(covered)[:-1] > 0
        for k, (doc_id, key, start, _) in enumerate(queries):
            free = ~windows[offsets[k] : max(offsets[k], offsets[k + 1] - self.length + 1)]
            edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                yield doc_id, key, start + a, start + b - 1 + self.length, b" ".join(split[k][a : b - 1 + self.length])


def _matched(pieces: DataFrame, length: int) -> DataFrame:
    """Matched intervals and unmatched runs of all pieces; a shard's copy is one task's work at a time."""

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard, waiting = None, Shard(length), []

        def flush() -> list[pa.RecordBatch]:
            out = list(shard.match(waiting)) if waiting else []
            waiting.clear()
            if not out:
                return []
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["doc_id", "row_key", "start", "end", "text"])]

        for batch in batches:
            shards, copies, roles, *rest = (batch.column(i).to_pylist() for i in range(7))
            for name, role, doc_id, key, start, text in zip(zip(shards, copies), roles, *rest):
                if name != own:
                    yield from flush()
                    own, shard = name, Shard(length)
                if role == 0:
                    shard.add(doc_id, text)
                else:
                    waiting.append((doc_id, key, start, text))
                    if len(waiting) >= _TOGETHER:
                        yield from flush()
        yield from flush()

    dealt = pieces.repartition("shard", "copy").sortWithinPartitions("shard", "copy", "role", "doc_id", "row_key", "start")
    return dealt.mapInArrow(searched, _FOUND)


def _round(rows: DataFrame, length: int, anchor: int) -> DataFrame:
    """One round over rows (doc_id, row_key, base, text): what the owners' shards found and what they didn't."""
    anchors = _anchor_rows(rows, length, anchor)  # taken twice: cheaper than keeping them
    first = F.min(F.struct("doc_id", "place")).alias("first")
    met = anchors.groupBy("anchor").agg(first, F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first.doc_id < last")
    lots = met.select("anchor", F.col("first.doc_id").alias("owner"), F.floor(F.col("first.place") / _LOT_WORDS).cast("int").alias("lot"), "n")
    copies = F.floor(F.sum("n").over(Window.partitionBy("owner", "lot")) / _COPY_ANCHORS) + 1  # a lot is a few dozen anchors
    shared = checkpointed(lots.select("anchor", "owner", "lot", copies.cast("int").alias("copies")))
    shards = max(1, math.ceil(shared.count() / _SHARD_ANCHORS))
    return checkpointed(_matched(_pieces(rows, shared, anchors, shards, length, anchor), length))


def _row_key(doc_id: Column, text: Column) -> Column:
    """Tells rows apart that share a doc_id."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, text), 1)


def _distinct(rows: DataFrame) -> DataFrame:
    """Rows, of those that share (doc_id, row_key) one; texts that stand alone are not shuffled."""
    repeated = checkpointed(rows.groupBy("doc_id", "row_key").count().where("count > 1").select("doc_id", "row_key"))
    if repeated.isEmpty():
        return rows
    alone = rows.join(repeated, ["doc_id", "row_key"], "left_anti")
    several = rows.join(repeated, ["doc_id", "row_key"], "left_semi").dropDuplicates(["doc_id", "row_key"])
    return alone.unionByName(several)


def deduplicate_substrings(docs: DataFrame, length: int = LENGTH, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, kept_text, n_words, n_removed and the `carry` columns of each row of docs.

    docs: needs doc_id and text; columns not named in `carry` are ignored. Words are separated
    by ASCII white space. kept_text is the text itself where nothing is removed, else the kept
    words joined by one space. Windows are judged on the input, not on what is left. Null and
    empty texts have no words and an empty kept_text. Rows without a doc_id are kept whole and
    remove nothing elsewhere; rows that share one never remove from each other, and equal ones are
    searched once. An empty table gives no rows.
    """
    anchor = min(ANCHOR, length)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.struct(*carry).alias("carry") if carry else F.lit(None).cast("string").alias("carry"))
    keyed = named.withColumn("row_key", _row_key(F.col("doc_id"), F.col("text")))
    rows = _distinct(keyed.where(F.col("doc_id").isNotNull()).select("doc_id", "row_key", F.lit(0).cast("long").alias("base"), "text"))
    first = _round(rows, length, anchor)
    left = first.where(F.col("text").isNotNull()).select("doc_id", "row_key", F.col("start").alias("base"), F.col("text").cast("string").alias("text"))
    second = _round(left, length, length) if anchor < length else first.limit(0)
    found = first.unionByName(second).where(F.col("text").isNull())
    intervals = found.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("start", "end")).alias("intervals"))
    joined = keyed.join(intervals, ["doc_id", "row_key"], "left").select("doc_id", "text", "intervals", "carry")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, words, removed = [], [], []
            for text, intervals in zip(batch.column(1), batch.column(2)):
                text = text.as_py()
                own = text.encode("utf-8", "replace").split()
                words.append(len(own))
                if intervals.is_valid:
                    gone = np.zeros(len(own) + 1, np.int64)
                    ends = intervals.values
                    np.add.at(gone, ends.field("start").to_numpy(), 1)
                    np.add.at(gone, ends.field("end").to_numpy(), -1)
                    stays = np.cumsum(gone)[:-1] == 0
                    text = b" ".join([own[i] for i in np.flatnonzero(stays)]).decode("utf-8", "replace")
                    removed.append(len(own) - int(stays.sum()))
                else:
                    removed.append(0)
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), batch.column(3)], ["doc_id", "kept_text", "n_words", "n_removed", "carry"])

    kind = joined.schema["carry"].dataType.simpleString()
    out = joined.mapInArrow(kept, f"doc_id long, kept_text string, n_words long, n_removed long, carry {kind}")
    return out.select("doc_id", "kept_text", "n_words", "n_removed", *(F.col("carry")[c].alias(c) for c in carry))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed from every document as repeats of a smaller document's 50 words."""
    kept = deduplicate_substrings(table(spark, sf_dir, "documents"))
    words = F.array_join(F.split(F.btrim("kept_text", F.lit(" \t\n\x0b\x0c\r")), "[ \t\n\x0b\x0c\r]+"), " ")
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))

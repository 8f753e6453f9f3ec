"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are normalised: A-Z and Latin-1 capitals lower-cased, every run of other ASCII
characters than letters and digits one space. An item of m bytes may differ from a passage by
k = floor(error_rate * m) edits, or by a few if it is short. It is split into k + 1 pieces, two
by two: if k edits are spent, some pair has one at most (or the odd piece none), so one piece of
it occurs unchanged and the other within an edit. One automaton over all pieces finds the
places, the neighbour is looked at there, and Myers' bit-parallel distance decides. Distances
are edits of normalised UTF-8 bytes.

Items are a query set: they go to the tasks in blocks of at most `block_bytes`, and each block
is one scan of the documents, without a shuffle. Documents are read whole and never collected.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.tables import table
from ledgerloom.llm.text import chunks, utf8

ERROR_RATE, BLOCK_BYTES = 0.05, 8 << 20
#: What counts as contamination in the query and the pipeline: a rate of edits, and edits that shorter items may have (one in 8 bytes at most).
CONTAMINATED_RATE, LEAST_EDITS = 0.1, 3
SCHEMA = "doc_id long, item_id long, distance int, start long, end long"
_SPACE = 0x20
_PLAIN = np.array([b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else _SPACE for b in range(256)], np.uint8)


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes of all rows, their row offsets, and the source place of every byte."""
    out = _PLAIN[data]
    capital = np.zeros(len(data), bool)
    capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    out[capital] += 0x20
    space = out == _SPACE
    before = np.ones(len(data), bool)
    before[1:] = space[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    kept = np.flatnonzero(~(space & before))
    return out[kept], np.searchsorted(kept, offsets), kept


def normalised_text(text: str) -> bytes:
    """Normalised bytes of one text, without a space at the end."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return normalised(data, np.array([0, len(data)]))[0].tobytes().rstrip()


def edit_budget(length: int, error_rate: float, least_edits: int = 0) -> int:
    """Edits that an item of `length` bytes may be away."""
    return max(math.floor(error_rate * length), min(least_edits, length // 8))


def pieces(item: bytes, budget: int) -> list[tuple[int, bytes, bool, bytes | None]]:
    """(offset, piece, whether its neighbour follows, neighbour) of `budget` + 1 pieces; the last of an odd number is longer and has none."""
    paired = (budget + 1) // 2 * 2
    weights = [0] + [2] * paired + [3] * (budget + 1 - paired)
    total, cuts = sum(weights), np.cumsum(weights).tolist()
    cuts = [len(item) * c // total for c in cuts]
    parts = [item[a:b] for a, b in zip(cuts, cuts[1:])]
    return [(cuts[i], part, i % 2 == 0, parts[i ^ 1] if i < paired else None) for i, part in enumerate(parts)]


def beside(text: bytes, start: int, end: int, follows: bool, neighbour: bytes) -> bool:
    """False only if `neighbour` isn't within one edit next to text[start:end]: one of its halves is there unchanged."""
    half = len(neighbour) // 2
    if follows:
        at = end
        near = text.startswith(neighbour[:half], at)
        far, to = neighbour[half:], at + half
    else:
        at = start - len(neighbour)
        near = at + half >= 0 and text.startswith(neighbour[half:], at + half)
        far, to = neighbour[:half], at
    return near or any(to + s >= 0 and text.startswith(far, to + s) for s in (-1, 0, 1))


def myers(pattern: bytes, text: bytes, budget: int) -> tuple[int, int] | None:
    """Least edit distance of `pattern` to a substring of `text` and that substring's end; None beyond `budget`.

    Of equally near ends the first. One column of the distance matrix is held as two bit
    vectors, of the vertical differences +1 and -1.
    """
    where: dict[int, int] = defaultdict(int)
    for i, byte in enumerate(pattern):
        where[byte] |= 1 << i
    full, last = (1 << len(pattern)) - 1, 1 << (len(pattern) - 1)
    up, down, score, best = full, 0, len(pattern), None
    for j, byte in enumerate(text):
        match = where.get(byte, 0)
        vertical = match | down
        diagonal = (((match & up) + up) ^ up) | match
        level_up = down | (full & ~(diagonal | up))
        level_down = up & diagonal
        score += 1 if level_up & last else -1 if level_down & last else 0
        level_up, level_down = level_up << 1, level_down << 1
        up = (level_down | ~(vertical | level_up)) & full
        down = level_up & vertical & full
        if score <= budget and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


@dataclass
class Item:
    """A benchmark item: id, normalised bytes, and how many edits it may be away."""

    item_id: int | None
    text: bytes
    budget: int


class Matcher:
    """Automaton over the pieces of a block of items."""

    def __init__(self, items: list[Item]) -> None:
        import ahocorasick

        self.items = items
        places: dict[bytes, list[tuple[int, int, bool, bytes | None]]] = defaultdict(list)
        for i, item in enumerate(items):
            for offset, piece, follows, neighbour in pieces(item.text, item.budget):
                places[piece].append((i, offset, follows, neighbour))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece.decode("latin-1"), (len(piece), found))
        if places:
            self.automaton.make_automaton()

    def matches(self, text: bytes) -> Iterator[tuple[int, int, int, int]]:
        """(item, distance, start, end) of the nearest passage of each item that `text` holds."""
        if not self.items:
            return
        starts: dict[int, set[int]] = defaultdict(set)
        for end, (length, found) in self.automaton.iter(text.decode("latin-1")):
            begin = end + 1 - length
            for i, offset, follows, neighbour in found:
                if begin - offset not in starts[i] and (neighbour is None or beside(text, begin, end + 1, follows, neighbour)):
                    starts[i].add(begin - offset)
        for i, found in sorted(x for x in starts.items() if x[1]):
            item, best = self.items[i], None
            for low, high in _merged(sorted(found), item.budget):
                begin = max(0, low - item.budget)
                near = self._verify(item, text[begin : high + len(item.text) + item.budget], begin)
                if near and (best is None or near[0] < best[0]):
                    best = near
            if best:
                yield i, *best

    @staticmethod
    def _verify(item: Item, window: bytes, begin: int) -> tuple[int, int, int] | None:
        at = window.find(item.text)
        if at >= 0:
            return 0, begin + at, begin + at + len(item.text)
        near = myers(item.text, window, item.budget)
        if near is None:
            return None
        distance, end = near
        back = myers(item.text[::-1], window[max(0, end - len(item.text) - distance) : end][::-1], distance)
        return distance, begin + end - back[1], begin + end


def _merged(starts: list[int], slack: int) -> Iterator[tuple[int, int]]:
    """Ranges of starts that follow each other within `slack`."""
    low = high = starts[0]
    for s in starts[1:]:
        if s > high + slack:
            yield low, high
            low = s
        high = s
    yield low, high


def _blocks(items: DataFrame, error_rate: float, block_bytes: int, least_edits: int) -> Iterator[list[Item]]:
    """Items in blocks of about `block_bytes` bytes, each collected by itself."""
    named = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    total = named.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    count = max(1, math.ceil(total / block_bytes))
    for block in range(count):
        rows = named.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == block).collect()
        texts = sorted({(r.item_id, normalised_text(r.text)) for r in rows}, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        yield [Item(i, t, edit_budget(len(t), error_rate, least_edits)) for i, t in texts if t]


def find_contamination(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES, least_edits: int = 0) -> DataFrame:
    """doc_id, item_id, distance, start, end: the nearest passage of each item that a document holds.

    docs: needs doc_id and text; items: item_id and text; other columns are ignored. start and
    end count the document's characters. Of equally near passages the first is given, of items
    that share an id each for itself. Null and empty texts match nothing, nor do items without
    a letter or digit. A repeated document row repeats its rows; empty tables give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def scan(block: list[Item]) -> DataFrame:
        def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block)
            for batch in batches:
                ids, out = batch.column(0), []
                data, offsets = utf8(batch.column(1))
                for first, end in chunks(offsets):
                    raw = data[offsets[first] : offsets[end]]
                    text, at, source = normalised(raw, offsets[first : end + 1] - offsets[first])
                    for i in range(end - first):
                        for item, distance, a, b in matcher.matches(text[at[i] : at[i + 1]].tobytes()):
                            places = offsets[first + i], source[at[i] + a] + offsets[first], source[at[i] + b - 1] + offsets[first] + 1
                            head, tail = (int(((data[places[0] : p] & 0xC0) != 0x80).sum()) for p in places[1:])
                            out.append((ids[first + i].as_py(), block[item].item_id, distance, head, tail))
                if out:
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["doc_id", "item_id", "distance", "start", "end"])

        return rows.mapInArrow(matched, SCHEMA)

    return reduce(DataFrame.unionByName, map(scan, _blocks(items, error_rate, block_bytes, least_edits)))


def without_contamination(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES, least_edits: int = 0) -> DataFrame:
    """The rows of docs (text, any other columns) that hold no item: each is judged by its own text, whatever its id."""

    def scan(rows: DataFrame, block: list[Item]) -> DataFrame:
        place = rows.columns.index("text")

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block)
            for batch in batches:
                stays = []
                data, offsets = utf8(batch.column(place))
                for first, end in chunks(offsets):
                    text, at, _ = normalised(data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first])
                    stays += [next(matcher.matches(text[at[i] : at[i + 1]].tobytes()), None) is None for i in range(end - first)]
                yield batch.filter(pa.array(stays, pa.bool_()))

        return rows.mapInArrow(clean, rows.schema)

    return reduce(scan, _blocks(items, error_rate, block_bytes, least_edits), docs)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item, the distance and the place."""
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), CONTAMINATED_RATE, least_edits=LEAST_EDITS)

"""Harmonic packing of documents into sequences of a fixed token capacity.

A tail of n tokens (what is left of a document after whole sequences are cut off) belongs to
the reciprocal class k = capacity // n, for capacity / (k + 1) < n <= capacity / k. A bin of
class k always takes exactly k tails, whatever arrives later, so each Spark partition packs on
its own and no state is shared. The room that k tails leave in their bin is filled with a slice
cut from filler documents, so a bin is closed full. Only the last tails of a partition, fewer
than k per class, are joined end to end; at most one sequence per partition is short.

The plan is one scan with one `mapInArrow`: no shuffle, and no task sees more than its split.
"""

from __future__ import annotations

import re
import struct
from collections import defaultdict, deque
from collections.abc import Callable, Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.tables import table

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Keys of a worker's memo, which holds up to twice as many, and characters of a key at most, which takes 0.2 KB for ASCII and 1.4 KB at worst.
CACHE_WORDS, CACHE_CHARS = 240_000, 64
#: Control characters that Python's split takes for white space and the tokenizer does not.
_ODD_SPACES = re.compile("[\x1c-\x1f]")
#: The tokenizer's own split pattern.
_RUNS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest for U+0100 on.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHARS = {b: chr(b) for b in _PLAIN} | {b: chr(0x100 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PLAIN)))}
#: Pieces per Arrow batch that a task emits.
_BATCH = 2_000


class Recent(dict):
    """A memo of about the last used `size` to twice `size` keys of few characters; `make` gives a missing value, each time for a longer key."""

    def __init__(self, size: int, make: Callable[[str], bytes]) -> None:
        super().__init__()
        self._size, self._make, self._older = size, make, {}

    def __missing__(self, key: str) -> bytes:
        if len(key) > CACHE_CHARS:
            return self._make(key)
        value = self._older.get(key)
        if value is None:
            value = self._make(key)
        self[key] = value
        if len(self) > self._size:
            self._older = dict(self)
            self.clear()
        return value


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit bytes, equal to the tokenizer's own.

    The tokenizer drops white space, lower-cases, and treats letter runs, digits and other runs
    as independent, so the ids of a white-space-delimited chunk, and of the runs in it, are
    remembered (a chunk of one run is that run). Chunks beyond the Latin blocks, where composed and lower-case forms could differ,
    and those that may hold a special token go through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._model._resize_cache(0)  # the memo below takes its place
        self._known = Recent(CACHE_WORDS, self._chunk)

    def __call__(self, text: str) -> bytes:
        if _ODD_SPACES.search(text):
            return self._whole(text)
        return b"".join(map(self._known.__getitem__, text.split()))

    def _whole(self, text: str) -> bytes:
        return pack(self._tokenizer.encode(text, add_special_tokens=False).ids)

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii() or max(chunk) < "\u0250":
            lowered = chunk.lower()
            if lowered.isalpha():
                return self._run(chunk) if chunk == lowered else self._known[lowered]
            if lowered[-1] in ".,!?" and lowered[:-1].isalpha():
                return self._known[lowered[:-1]] + self._known[lowered[-1]]
            if min(chunk) > " " and "<|" not in chunk:
                runs = _RUNS.findall(lowered)
                return self._run(lowered) if len(runs) == 1 else b"".join(map(self._known.__getitem__, runs))
        return self._whole(chunk)

    def _run(self, run: str) -> bytes:
        symbols = run if run.isascii() and run.isprintable() else "".join(map(_BYTE_CHARS.__getitem__, run.encode()))
        return pack([x.id for x in self._model.tokenize(symbols)])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker process's encoder; what it remembers serves its later tasks too."""
    return Encoder(path)


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class HarmonicPacker:
    """Packs one partition's documents; `add` and `finish` yield sequences, lists of pieces.

    A piece is (doc_id, start, ids as bytes, doc_tokens). At most `capacity` tokens wait per
    class, and the filler holds less than `capacity` tokens and one document.
    """

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self._open: dict[int, list[tuple]] = defaultdict(list)
        self._filler: deque[tuple] = deque()
        self._spare = 0

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[list[tuple]]:
        n = len(ids) // 4
        if self._spare < self.capacity:
            self._filler.append((doc_id, 0, ids, n))
            self._spare += n
            return
        whole = n - n % self.capacity
        for start in range(0, whole, self.capacity):
            yield [(doc_id, start, ids[4 * start : 4 * (start + self.capacity)], n)]
        if whole < n:
            k = self.capacity // (n - whole)
            self._open[k].append((doc_id, whole, ids[4 * whole :], n))
            if len(self._open[k]) == k:
                pieces = self._open.pop(k)
                yield pieces + self._cut(self.capacity - sum(len(x[2]) // 4 for x in pieces))

    def _cut(self, tokens: int) -> list[tuple]:
        """Pieces of `tokens` tokens in all, or what there is, taken off the filler."""
        pieces = []
        while tokens and self._filler:
            doc_id, start, ids, n = self._filler.popleft()
            pieces.append((doc_id, start, ids[: 4 * tokens], n))
            taken = len(pieces[-1][2]) // 4
            if taken < len(ids) // 4:
                self._filler.appendleft((doc_id, start + taken, ids[4 * taken :], n))
            tokens -= taken
            self._spare -= taken
        return pieces

    def finish(self) -> Iterator[list[tuple]]:
        """What is still open, end to end; the largest class first."""
        for k in sorted(self._open):
            self._filler.extend(self._open[k])
            self._spare += sum(len(x[2]) // 4 for x in self._open[k])
        self._open.clear()
        while self._spare:
            yield self._cut(self.capacity)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of packed sequences: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    docs: needs doc_id and text; other columns, whatever their names, are ignored.
    ids: little-endian unsigned 32-bit ids of the piece; start: the document's ids before it;
    doc_tokens: all its ids, with `end_id` at the end; offset: the piece's place in its sequence.
    tokenizer_path: file of the tokenizer, at the same place on every worker.

    Null and empty texts are the end id alone. Rows with equal or null doc_id are packed each
    for itself. An empty table gives no rows. A text of any length is cut as often as needed.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    tail = pack([end_id])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(tokenizer_path), HarmonicPacker(capacity)
        sequence, rows = TaskContext.get().partitionId() << 40, []

        def put(pieces: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for doc_id, start, ids, n in pieces:
                rows.append((doc_id, start, len(ids) // 4, ids, n, sequence, offset))
                offset += len(ids) // 4
            sequence += 1

        def batch() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
            rows.clear()
            return out

        for batch_in in batches:
            for doc_id, text in zip(batch_in.column(0).to_pylist(), batch_in.column(1)):
                for pieces in packer.add(doc_id, encode(text.as_py() or "") + tail):
                    put(pieces)
                if len(rows) >= _BATCH:
                    yield batch()
        for pieces in packer.finish():
            put(pieces)
            if len(rows) >= _BATCH:
                yield batch()
        if rows:
            yield batch()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(packed, SCHEMA)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of at most 2048 tokens."""
    pieces = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

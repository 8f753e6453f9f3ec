"""Hashes over all rows of a group in order, without the rows of a group in memory.

A running hash is sequential by definition. Rows are first put in order and packed into pieces
of consecutive rows, in parallel; then each group's pieces are streamed in order through one
hash. A task holds one batch of pieces, however many rows its group has. A group of more pieces
than a stretch goes on in the next task after each stretch, from the state of the one before,
so no task reads all of a long group. `hashlib` shows no state within a message; that of the
libcrypto under it is taken instead, and only where there is none does one task read all of a
long group's SHA-256.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
import struct
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.framing import FOLD_SEED_TEXT
from ledgerloom.session import broadcast_if_small, checkpointed, stored

#: Rows per piece, of 32 bytes each.
PIECE_ROWS = 256
#: Pieces that one task takes of a group: 128 MB.
STRETCH_PIECES = 1 << 14


class Running:
    """SHA-256 of everything added."""

    def __init__(self, head: bytes) -> None:
        self._hash = hashlib.sha256(head)

    def add(self, digests: bytes) -> None:
        self._hash.update(digests)

    def hex(self) -> str:
        return self._hash.hexdigest()

    def state(self) -> str | None:
        """What another task can go on from; `hashlib` gives none."""
        return None


class Resumable:
    """SHA-256 of everything added, whose state can be handed to another task."""

    def __init__(self, head: bytes) -> None:
        self._words, self._size, self._rest = _START, 0, b""
        self.add(head)

    @classmethod
    def resumed(cls, state: str) -> Resumable:
        """A hash that goes on from what `state` gave."""
        running, data = cls(b""), bytes.fromhex(state)
        running._words, running._size, running._rest = data[:32], int.from_bytes(data[32:40], "big"), data[40:]
        return running

    def add(self, digests: bytes) -> None:
        data = self._rest + digests
        whole = len(data) - len(data) % 64
        self._words, self._size, self._rest = _compressed(self._words, data[:whole]), self._size + len(digests), data[whole:]

    def hex(self) -> str:
        padding = b"\x80" + bytes(-(self._size + 9) % 64) + (8 * self._size).to_bytes(8, "big")
        return _compressed(self._words, self._rest + padding).hex()

    def state(self) -> str:
        return (self._words + self._size.to_bytes(8, "big") + self._rest).hex()


class Chain:
    """Hash of the hash so far and the next digest, from a fixed seed."""

    def __init__(self, head: bytes) -> None:
        self._hash = hashlib.sha256(FOLD_SEED_TEXT.encode()).digest()

    @classmethod
    def resumed(cls, state: str) -> Chain:
        """A chain that goes on from what `state` gave."""
        chain = cls(b"")
        chain._hash = bytes.fromhex(state)
        return chain

    def add(self, digests: bytes) -> None:
        for at in range(0, len(digests), 32):
            self._hash = hashlib.sha256(self._hash + digests[at : at + 32]).digest()

    def hex(self) -> str:
        return self._hash.hex()

    state = hex


#: Fixed values of SHA-256: its first words and the constants of its rounds, of the roots of the first primes.
_PRIMES = [n for n in range(2, 312) if all(n % d for d in range(2, n))]
_START = struct.pack(">8I", *(int(p ** (1 / 2) % 1 * 2**32) for p in _PRIMES[:8]))
_ROUNDS = [int(p ** (1 / 3) % 1 * 2**32) for p in _PRIMES]


def _compressed(words: bytes, blocks: bytes) -> bytes:
    """State of a SHA-256 after whole blocks of 64 bytes, from the state before."""
    return (_native() or plainly_compressed)(words, blocks)


@functools.cache
def _native() -> Callable[[bytes, bytes], bytes] | None:
    """The compression of the libcrypto that `hashlib` uses, which `hashlib` doesn't show; None if it can't be reached."""

    def compressed(words: bytes, blocks: bytes) -> bytes:
        context = ctypes.create_string_buffer(256)  # SHA256_CTX: eight words, then counts and the open block
        start(context)
        context[:32] = struct.pack("=8I", *struct.unpack(">8I", words))
        update(context, blocks, len(blocks))
        return struct.pack(">8I", *struct.unpack("=8I", context[:32]))

    try:
        import _hashlib

        library = ctypes.CDLL(_hashlib.__file__)
        start, update = library.SHA256_Init, library.SHA256_Update
        start.argtypes, update.argtypes = [ctypes.c_void_p], [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
    except (ImportError, AttributeError, OSError):
        return None
    probe = bytes(range(128))
    return compressed if compressed(plainly_compressed(_START, probe), probe) == plainly_compressed(_START, 2 * probe) else None


def plainly_compressed(words: bytes, blocks: bytes) -> bytes:
    """As the native compression, in Python alone: for workers without it, much slower."""
    state, mask = list(struct.unpack(">8I", words)), 0xFFFFFFFF
    turned = lambda x, n: x >> n | x << 32 - n  # noqa: E731  its upper bits are masked by the callers
    for block in struct.iter_unpack(">16I", blocks):
        w = list(block)
        for t in range(16, 64):
            x, y = w[t - 15], w[t - 2]
            w.append(w[t - 16] + ((turned(x, 7) ^ turned(x, 18)) & mask ^ x >> 3) + w[t - 7] + ((turned(y, 17) ^ turned(y, 19)) & mask ^ y >> 10) & mask)
        a, b, c, d, e, f, g, h = state
        for k, word in zip(_ROUNDS, w):
            first = h + ((turned(e, 6) ^ turned(e, 11) ^ turned(e, 25)) & mask) + (e & f ^ ~e & g) + k + word
            second = ((turned(a, 2) ^ turned(a, 13) ^ turned(a, 22)) & mask) + (a & b ^ a & c ^ b & c)
            a, b, c, d, e, f, g, h = first + second & mask, a, b, c, d + first & mask, e, f, g
        state = [old + new & mask for old, new in zip(state, (a, b, c, d, e, f, g, h))]
    return struct.pack(">8I", *state)


def hashed_in_order(rows: DataFrame, by: tuple[str, ...], digest: str, kind: type[Running] | type[Chain], head: Callable[[int], bytes] = lambda n: b"", is_stored: bool = False) -> DataFrame:
    """The `by` columns, n_rows and hashed of each group of rows (source_row_no, `digest` as 64 hex digits).

    Rows go in order of source_row_no; rows that share one in order of their digests. head: what
    the hash begins with, from the number of rows. is_stored: the rows are read from where they
    were put, so that they can be read twice without a copy. Groups without rows have no row.
    """
    own = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    named = rows.select(own.alias("own"), "source_row_no", F.unhex(digest).alias("digest"))
    named = named if is_stored else stored(named)  # read twice: ranges come from a sample
    order = [*(F.col("own")[c] for c in by), "source_row_no", "digest"]
    ordered = named.repartitionByRange(*order).sortWithinPartitions(*order).select("own", "digest")
    packed = ordered.mapInArrow(_packed, f"own {named.schema['own'].dataType.simpleString()}, digests int, data binary")
    pieces = stored(packed.withColumn("piece", F.monotonically_increasing_id()))  # its upper bits are the partition's number

    part, group = F.shiftright("piece", 33).alias("part"), Window.partitionBy("own")
    parts = pieces.groupBy("own", part).agg(F.min("piece").alias("first"), F.count("*").alias("n"), F.sum("digests").alias("n_rows"))
    before = F.sum("n").over(group.orderBy("part")) - F.col("n")
    parts = parts.select("own", "part", "first", "n", before.alias("before"), F.sum("n").over(group).alias("n_pieces"), F.sum("n_rows").over(group).alias("n_rows"))
    parts = broadcast_if_small(checkpointed(parts))

    shortest, longest = parts.agg(F.min("n_pieces"), F.max("n_pieces")).first()
    most = STRETCH_PIECES if kind is Chain or _native() else longest or 0
    found = []
    if longest is None or shortest <= most:
        short = pieces.withColumn("part", part).join(parts.where(F.col("n_pieces") <= most), ["own", "part"])
        found.append(_streamed(short.select("own", "piece", "n_rows", "data", F.lit(None).cast("string").alias("state")), kind, head))
    if longest is not None and longest > most:
        found.append(_in_stretches(pieces, parts.where(F.col("n_pieces") > most), Resumable if kind is Running else kind, head))
    out = functools.reduce(DataFrame.unionByName, found)
    return out.select(*(F.col("own")[c].alias(c) for c in by), "n_rows", "hashed")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """own, number of digests and data of pieces: the digests of at most PIECE_ROWS consecutive rows (own, digest) of a group."""
    for batch in batches:
        owns, digests, starts, datas = batch.column(0), batch.column(1).to_pylist(), [], []
        start = 0
        while start < batch.num_rows:
            key = owns[start].as_py()
            rest = range(start + 1, min(start + PIECE_ROWS, batch.num_rows))
            end = start + 1 + bisect_left(rest, True, key=lambda i: owns[i].as_py() != key)
            starts.append(start)
            datas.append(b"".join(d for d in digests[start:end] if d is not None))
            start = end
        counts = pa.array([len(data) // 32 for data in datas], pa.int32())
        yield pa.RecordBatch.from_arrays([owns.take(pa.array(starts, pa.int64())), counts, pa.array(datas, pa.binary())], ["own", "digests", "data"])


def _streamed(pieces: DataFrame, kind: type[Running] | type[Resumable] | type[Chain], head: Callable[[int], bytes]) -> DataFrame:
    """own, n_rows, hashed and state of groups of pieces (own, piece, n_rows, data, state: what a hash goes on from, or null)."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, key, n, running = None, None, 0, None
        ended = lambda: pa.RecordBatch.from_arrays([own, pa.array([n], pa.int64()), pa.array([running.hex()]), pa.array([running.state()], pa.string())], ["own", "n_rows", "hashed", "state"])
        for batch in batches:
            keys, counts, datas, states = batch.column(0), batch.column(1).to_pylist(), batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                here = keys[i].as_py()
                if running is None or here != key:
                    if running is not None:
                        yield ended()
                    own, key, n, state = keys.slice(i, 1), here, counts[i], states[i].as_py()
                    running = kind(head(n)) if state is None else kind.resumed(state)
                running.add(datas[i].as_py())
        if running is not None:
            yield ended()

    ordered = pieces.repartition("own").sortWithinPartitions("own", "piece").select("own", "n_rows", "data", "state")
    return ordered.mapInArrow(stream, f"own {pieces.schema['own'].dataType.simpleString()}, n_rows long, hashed string, state string")


def _in_stretches(pieces: DataFrame, parts: DataFrame, kind: type[Resumable] | type[Chain], head: Callable[[int], bytes]) -> DataFrame:
    """As `_streamed`, of the long groups that `parts` tells of: a stretch of each, then the next.

    The pieces of a group follow each other, so its stretch is a range of their numbers; a turn
    has one for each long group that goes on, and reads no other pieces.
    """
    turn, first, last = F.col("turn") * STRETCH_PIECES, F.col("first"), F.col("before") + F.col("n")
    turns_of = F.sequence(F.floor(F.col("before") / STRETCH_PIECES), F.floor((last - 1) / STRETCH_PIECES))
    within = parts.withColumn("turn", F.explode(turns_of)).select("own", "turn", (first + F.greatest(turn - F.col("before"), F.lit(0))).alias("low"), (first + F.least(turn + STRETCH_PIECES, last) - F.col("before") - 1).alias("high"))
    ranges = within.groupBy("turn", "own").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    by_turn = ranges.groupBy("turn").agg(F.collect_list(F.struct("low", "high")).alias("ranges")).orderBy("turn").collect()  # a long group has 128 MB at least
    counts, turns = parts.groupBy("own").agg(F.first("n_rows").alias("n_rows")), []
    for at in by_turn:
        read = functools.reduce(lambda a, b: a | b, (F.col("piece").between(low, high) for low, high in at.ranges))
        now = pieces.where(read).join(broadcast_if_small(counts), "own")
        started = now.join(F.broadcast(turns[-1].select("own", "state")), "own") if turns else now.withColumn("state", F.lit(None).cast("string"))  # a row for each group of a stretch at least
        turns.append(stored(_streamed(started.select("own", "piece", "n_rows", "data", "state"), kind, head).withColumn("turn", F.lit(at.turn))))
    every = functools.reduce(DataFrame.unionByName, turns)
    return every.groupBy("own").agg(F.max("n_rows").alias("n_rows"), F.max_by("hashed", "turn").alias("hashed"), F.lit(None).cast("string").alias("state"))

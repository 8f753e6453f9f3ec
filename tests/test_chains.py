"""Chains go on from task to task."""

import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.framing import FOLD_SEED_TEXT
from ledgerloom.operators import chains


def test_a_chain_is_taken_in_stretches(spark, monkeypatch):
    """Groups of any length, some with gaps and some that begin late: no pass takes all pieces."""
    sizes, streamed = [], chains._streamed
    monkeypatch.setattr(chains, "STRETCH_PIECES", 8)
    monkeypatch.setattr(chains, "_streamed", lambda pieces, *more: sizes.append(pieces.count()) or streamed(pieces, *more))
    numbers = {"a": range(1, 5_000), "b": range(7, 9_000, 11), "c": range(6_000, 6_100), "d": [3], "e": [10**12]}
    rows = spark.createDataFrame([(g, n) for g, ns in numbers.items() for n in ns], "g string, source_row_no long").repartition(5)
    found = chains.hashed_in_order(rows.withColumn("h", F.sha2(F.col("source_row_no").cast("string"), 256)), ("g",), "h", chains.Chain).collect()
    assert len(sizes) > 3 and max(sizes) <= 2 * 8
    for g, ns in numbers.items():
        chain = hashlib.sha256(FOLD_SEED_TEXT.encode()).digest()
        for n in ns:
            chain = hashlib.sha256(chain + hashlib.sha256(str(n).encode()).digest()).digest()
        assert [(r.n_rows, r.hashed) for r in found if r.g == g] == [(len(ns), chain.hex())]
    assert len(found) == len(numbers)


def _taken_in_stretches(spark, monkeypatch):
    """Whether datasets hash as with `hashlib`, from few pieces however sparse their numbers, and the pieces of each pass."""
    sizes, streamed, head = [], chains._streamed, b"an odd head"
    monkeypatch.setattr(chains, "STRETCH_PIECES", 8)
    monkeypatch.setattr(chains, "_streamed", lambda pieces, *more: sizes.append(pieces.count()) or streamed(pieces, *more))
    numbers = {"a": range(1000, 6_001_000, 1000), "b": range(-300, 4_000), "c": range(0, 700, 7), "d": [3, 3, 3], "e": [10**12]}
    rows = spark.createDataFrame([(g, n, i) for g, ns in numbers.items() for i, n in enumerate(ns)], "g string, source_row_no long, i int").repartition(5)
    found = chains.hashed_in_order(rows.withColumn("h", F.sha2(F.col("i").cast("string"), 256)), ("g",), "h", chains.Running, lambda n: head + str(n).encode()).collect()
    right = {}
    for g, ns in numbers.items():
        placed = sorted((n, hashlib.sha256(str(i).encode()).digest()) for i, n in enumerate(ns))
        right[g] = (len(ns), hashlib.sha256(head + str(len(ns)).encode() + b"".join(h for _, h in placed)).hexdigest())
    return len(found) == len(right) and {r.g: (r.n_rows, r.hashed) for r in found} == right, sizes


def test_a_dataset_hash_is_taken_in_stretches(spark, monkeypatch):
    """A SHA-256 goes on in the next task: no pass takes all pieces of a long dataset."""
    right, sizes = _taken_in_stretches(spark, monkeypatch)
    assert right and len(sizes) > 3 and max(sizes) <= 2 * 8


def test_a_dataset_hash_without_libcrypto(spark, monkeypatch):
    """Then one task takes a dataset, whole and right."""
    monkeypatch.setattr(chains, "_native", lambda: None)
    right, sizes = _taken_in_stretches(spark, monkeypatch)
    assert right and len(sizes) == 1


@pytest.mark.parametrize("compressed", ["_compressed", "plainly_compressed"])
def test_a_resumed_sha256(monkeypatch, compressed):
    monkeypatch.setattr(chains, "_compressed", getattr(chains, compressed))
    for size in [*range(130), 5_000]:
        data = bytes(i * i % 251 for i in range(size))
        running = chains.Resumable(b"head")
        for at in range(0, size, 37):
            running.add(data[at : at + 37])
            running = chains.Resumable.resumed(running.state())
        assert running.hex() == hashlib.sha256(b"head" + data).hexdigest()

"""Connected components of an edge table, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.tables import checkpointed

_MOST_ROUNDS = 40


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of edges (a, b): component is the least node reached; each node once.

    Every round links larger neighbours, then smaller ones, to the least neighbour, which takes
    rounds in the logarithm of the longest path; edges never grow in number. Neighbours are
    never gathered: least neighbours are aggregates, joined back to the edges.
    """
    known = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = None
    for _ in range(_MOST_ROUNDS):
        both = known.unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
        root = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(root, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("least").alias("b")), F.struct("a", F.col("least").alias("b")))).alias("e")).select("e.*")
        known = checkpointed(small.where("a <> b").distinct())
        now = known.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components have not settled in {_MOST_ROUNDS} rounds")
    members = known.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return members.unionByName(known.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

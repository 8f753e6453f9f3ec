"""Reconciliation of two record sets: candidate pairs, greedy one-to-one matches, residuals.

Records: idx (input order), id, reference, amount decimal(15,2), counterparty, value_date. Two
record sets are matched by `matched`, which never has their pairs as a table, since these grow
with the square of the records; `candidates` and `greedy_matches` are for those who want the pairs.

Candidates are found by bands: an amount meets only the amounts of its own and the two adjacent
bands, within the date window. Pairs compete only within an island: a run of amount bands that
follow each other without a gap. Islands are matched in parallel, each by one pass over its
pairs from best to worst.

An island of very many pairs is first split into the connected components of its records. What
is still too large is matched by stretches of its order: the best pairs, as many as fit a task,
are matched by one pass, their records are retired from all that is left, and so on. No pair
depends on one that ranks below it, and the order (confidence, then source, then target) is
strict, so every way gives the pairs of one pass over everything. A round settles a stretch at
least, so their number is bounded by pairs over stretch, however long a chain of pairs is in
which each waits for the one before.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import money
from ledgerloom.functions.text import key
from ledgerloom.functions.timeparts import days_between
from ledgerloom.operators.ingest import content_numbered
from ledgerloom.operators.matching import matched
from ledgerloom.session import checkpointed

#: Pairs that one pass takes.
MOST_PAIRS = 1_000_000


@dataclass(frozen=True)
class Settings:
    """Window in days (above 0), tolerance in minor units, and least confidence."""

    window_days: float = 5
    tolerance: int = 0
    least_confidence: float = 0.5

    def __post_init__(self) -> None:
        if self.window_days <= 0 or self.tolerance < 0:
            raise ValueError("the window must be above 0 and the tolerance not below")


def _keyed(records: DataFrame, side: str, settings: Settings) -> DataFrame:
    width = max(settings.tolerance, 1)
    rows = records.select("idx", "id", money.minor_units(F.col("amount")).alias("minor"), key(F.col("reference")).alias("ref"), key(F.col("counterparty")).alias("party"), "value_date")
    # without a tolerance only equal amounts meet: every other band stays empty, so that none follow each other
    rows = rows.withColumn("band", F.floor(F.col("minor") / width) if settings.tolerance else F.col("minor") * 2)
    rows = rows.withColumn("slot", F.floor(F.unix_micros("value_date") / (settings.window_days * 86_400_000_000)))
    return rows.select(*(F.col(c).alias(f"{side}_{c}") for c in rows.columns))


def candidates(source: DataFrame, target: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Pairs within tolerance and window with their confidence, at least the least one: source_*, target_*, delta, days, confidence and the amount bands."""
    a, b = _keyed(source, "source", settings), _keyed(target, "target", settings)
    around = (-1, 0, 1) if settings.tolerance else (0,)
    a = a.withColumn("band", F.explode(F.array(*(F.col("source_band") + d for d in around)))).withColumn("slot", F.explode(F.array(*(F.col("source_slot") + d for d in (-1, 0, 1)))))
    joined = a.join(b, (F.col("band") == F.col("target_band")) & (F.col("slot") == F.col("target_slot")))
    delta = F.abs(F.col("source_minor") - F.col("target_minor"))
    days = F.abs(days_between(F.col("source_value_date"), F.col("target_value_date")))
    near = joined.withColumns({"delta": delta, "days": days}).where((F.col("delta") <= settings.tolerance) & (F.col("days") <= settings.window_days))
    amount_score = F.when(F.col("delta") == 0, 1.0).otherwise(1 - F.col("delta") / max(settings.tolerance, 1) * 0.4)
    date_score = 1 - F.col("days") / settings.window_days * 0.4
    same_ref = F.when((F.col("source_ref") != "") & (F.col("source_ref") == F.col("target_ref")), 0.1).otherwise(0.0)
    same_party = F.when((F.col("source_party") != "") & (F.col("source_party") == F.col("target_party")), 0.05).otherwise(0.0)
    confidence = F.least(F.lit(1.0), 0.6 * amount_score + 0.3 * date_score + same_ref + same_party)
    scored = near.withColumn("confidence", confidence).where(F.col("confidence") >= settings.least_confidence)
    return scored.select("source_idx", "source_id", "target_idx", "target_id", "delta", "days", "confidence", "source_band", "target_band")


def _with_islands(pairs: DataFrame) -> DataFrame:
    """Adds island: equal for pairs whose bands are joined by bands that follow each other."""
    if pairs.where("source_band <> target_band").isEmpty():
        return pairs.withColumn("island", F.col("source_band"))
    bands = pairs.select(F.explode(F.array("source_band", "target_band")).alias("source_band")).distinct()
    runs = content_numbered(bands, ["source_band"]).select("source_band", (F.col("source_band") - F.col("source_row_no")).alias("island"))
    return pairs.join(runs, "source_band")


def _in_one_pass(pairs: DataFrame) -> DataFrame:
    """Greedy pairs of islands: an island's pairs stream by in order, and only what is taken is remembered."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sources, targets = None, set(), set()
        for batch in batches:
            kept = []
            for i, (island, source, target) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("island", "source_idx", "target_idx")))):
                if island != own:
                    own, sources, targets = island, set(), set()
                if source not in sources and target not in targets:
                    sources.add(source)
                    targets.add(target)
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int64()))

    ordered = pairs.repartition("island").sortWithinPartitions("island", F.desc("confidence"), "source_idx", "target_idx")
    return ordered.mapInArrow(take, pairs.schema)


def components(pairs: DataFrame) -> DataFrame:
    """Pairs with `part`: a number that the pairs of connected records share.

    Records take the least number among their neighbours' until none changes. Neighbours are
    linked to their least one from step to step, larger ones first and smaller ones then, so a
    path is halved rather than walked; the links never outnumber the pairs.
    """
    nodes = pairs.select((F.col("target_idx") * 2 + 1).alias("high"), (F.col("source_idx") * 2).alias("low"))
    links = checkpointed(nodes.select(F.greatest("high", "low").alias("high"), F.least("high", "low").alias("low")).distinct())
    settled = None
    while True:
        around = links.unionByName(links.select(F.col("low").alias("high"), F.col("high").alias("low")))
        nearest = around.groupBy("high").agg(F.least(F.min("low"), F.col("high")).alias("root"))
        upper = around.where("low > high").join(nearest, "high").select(F.col("low").alias("high"), F.col("root").alias("low")).distinct()
        root = upper.groupBy("high").agg(F.min("low").alias("root"))
        joined = upper.join(root, "high")
        lower = joined.select("high", F.col("root").alias("low")).unionByName(joined.where("low <> root").select(F.col("low").alias("high"), F.col("root").alias("low")))
        links = checkpointed(lower.distinct())
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("high", "low"))).first()
        if now == settled:
            break
        settled = now
    # every record is now linked to its component's least one, and that to none
    roots = links.groupBy("high").agg(F.min("low").alias("part"))
    ends = pairs.withColumn("high", F.col("source_idx") * 2).join(roots, "high", "left")
    return ends.withColumn("part", F.coalesce("part", "high")).drop("high")


def _in_stretches(pairs: DataFrame, most_pairs: int) -> DataFrame:
    """Greedy pairs of large islands: a round matches the best pairs of each, about `most_pairs` of them."""
    total, most_pairs = pairs.count(), max(most_pairs, 1)
    order = ("island", F.desc("confidence"), "source_idx", "target_idx")
    left = checkpointed(pairs.repartitionByRange(2 * -(-total // most_pairs), *order).withColumn("stretch", F.spark_partition_id()))
    taken = left.limit(0)
    for turn in count(1):
        before = Window.partitionBy("island").orderBy("stretch")  # a row for each stretch of an island
        sizes = left.groupBy("island", "stretch").count().withColumns({"so_far": F.sum("count").over(before), "place": F.row_number().over(before)})
        now = sizes.where((F.col("so_far") <= most_pairs) | (F.col("place") == 1)).groupBy("island").agg(F.max("stretch").alias("upto"))
        marked = left.join(F.broadcast(now), "island")  # one row per large island, of which each has `most_pairs` pairs
        won = checkpointed(_in_one_pass(marked.where("stretch <= upto").drop("upto")))
        taken = taken.unionByName(won)
        if turn % 16 == 0:
            taken = checkpointed(taken)
        rest = marked.where("stretch > upto").drop("upto")
        left = checkpointed(rest.join(won.select("source_idx"), "source_idx", "left_anti").join(won.select("target_idx"), "target_idx", "left_anti").select(*left.columns))
        if left.isEmpty():
            return taken.drop("stretch")


def greedy_matches(pairs: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """One-to-one pairs, best confidence first, then least source_idx, then least target_idx.

    pairs: as `candidates` gives them. An island of more than `most_pairs` is split into its
    components, and those that are still larger are matched in stretches of their order.
    """

    def by_size(parts: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        large = checkpointed(parts.groupBy("island").count().where(F.col("count") > most_pairs).select("island"))  # one row per `most_pairs` pairs at most
        if large.isEmpty():
            return parts, None
        return parts.join(F.broadcast(large), "island", "left_anti"), checkpointed(parts.join(F.broadcast(large), "island", "left_semi"))

    small, large = by_size(checkpointed(_with_islands(checkpointed(pairs))))
    found = _in_one_pass(small)
    if large is not None:
        small, large = by_size(checkpointed(components(large.drop("island")).withColumnRenamed("part", "island").select(*small.columns)))
        found = found.unionByName(_in_one_pass(small))
        if large is not None:
            found = found.unionByName(_in_stretches(large, most_pairs))
    return found.drop("island")


def reconcile(source: DataFrame, target: DataFrame, settings: Settings = Settings(), most_pairs: int = MOST_PAIRS) -> DataFrame:
    """Matches (see `matched`), then the sources without one: source_id, target_id, status, confidence, delta."""
    matches = matched(source, target, settings, most_pairs)
    rows = matches.select("source_id", "target_id", F.when(F.col("delta") == 0, "MATCHED").otherwise("PARTIAL").alias("status"), F.round("confidence", 4).alias("confidence"), "delta")
    alone = unmatched(source, matches, "source").select(F.col("id").alias("source_id"), F.lit(None).cast("string").alias("target_id"), F.lit("UNMATCHED").alias("status"), F.lit(0.0).alias("confidence"), F.lit(0).cast("long").alias("delta"))
    return rows.unionByName(alone)


def unmatched(records: DataFrame, matches: DataFrame, side: str) -> DataFrame:
    """Records of `side` (source or target) that no match takes."""
    return records.join(matches.select(F.col(f"{side}_idx").alias("idx")), "idx", "left_anti")


def summary(matches: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """One row: matched, partial, unmatched_source, unmatched_target."""
    counted = matches.agg(F.count_if(F.col("delta") == 0).alias("matched"), F.count_if(F.col("delta") != 0).alias("partial"))
    sizes = source.agg(F.count("*").alias("s")).crossJoin(target.agg(F.count("*").alias("t")))  # one row each
    return counted.crossJoin(F.broadcast(sizes)).select("matched", "partial", (F.col("s") - F.col("matched") - F.col("partial")).alias("unmatched_source"), (F.col("t") - F.col("matched") - F.col("partial")).alias("unmatched_target"))


def unreconciled_findings(unmatched_source: DataFrame) -> DataFrame:
    """A finding for each unmatched source."""
    return unmatched_source.select(F.lit("UNRECONCILED").alias("code"), F.lit("MEDIUM").alias("severity"), F.lit(60).alias("score"), F.array("id").alias("ids"))

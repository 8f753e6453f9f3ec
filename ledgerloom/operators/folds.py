"""Population fingerprints in bounded steps, from which an aborted or extended population goes on.

A fold is a chain over a dataset's members in row order, so it can't be split; but its state is
32 bytes. Every step takes the next stretch of row numbers of all datasets at once, folds each
dataset's in one task and appends the states to a table. A later call goes on from the last
state whose members are still there as they were, which a count and a checksum over them tell,
taken in parallel; a dataset whose folded members have changed starts afresh.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import framing
from ledgerloom.operators.chains import PIECE_ROWS, Chain
from ledgerloom.session import checkpointed

STATE = "dataset_id string, step long, last_row long, n_members long, chain string, checksum long"


def stored_states(spark: SparkSession, path: str) -> DataFrame:
    """The last state of each dataset; none where nothing is stored."""
    try:
        states = spark.read.schema(STATE).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":  # no step has been written
            raise
        states = spark.createDataFrame([], STATE)
    return states.groupBy("dataset_id").agg(F.max_by(F.struct("step", "last_row", "n_members", "chain", "checksum"), "step").alias("s")).select("dataset_id", "s.*")


def _checksum() -> Column:
    """Of the members of a group, in any order."""
    return F.bit_xor(F.xxhash64("source_row_no", "eoi"))


def valid_states(members: DataFrame, states: DataFrame) -> DataFrame:
    """States whose members are those that were folded."""
    folded = members.join(states.select("dataset_id", "last_row"), "dataset_id").where("source_row_no <= last_row")
    now = folded.groupBy("dataset_id").agg(F.count("*").alias("n_now"), _checksum().alias("checksum_now"))
    return states.join(now, "dataset_id").where("n_members = n_now and checksum = checksum_now").drop("n_now", "checksum_now")


def reach(members: DataFrame) -> DataFrame:
    """dataset_id, and the first and last row number of its members."""
    return members.groupBy("dataset_id").agg(F.min("source_row_no").alias("first_row"), F.max("source_row_no").alias("top"))


def starts(span: DataFrame) -> DataFrame:
    """The states of datasets (see `reach`) before their first member, without a step."""
    seed = F.sha2(F.encode(F.lit(framing.FOLD_SEED_TEXT), "UTF-8"), 256)
    none = F.lit(0).cast("long")
    return span.select("dataset_id", (F.col("first_row") - 1).alias("last_row"), none.alias("n_members"), seed.alias("chain"), none.alias("checksum"))


def limits(span: DataFrame, states: DataFrame, rows_per_step: int) -> DataFrame:
    """Datasets with members beyond their state, with that state and the row up to which the next step goes."""
    unstarted = starts(span).join(states, "dataset_id", "left_anti").withColumn("step", F.lit(0).cast("long"))
    joined = states.unionByName(unstarted).join(span.select("dataset_id", "top"), "dataset_id")
    return joined.where("last_row < top").withColumn("upto", F.least("top", F.col("last_row") + rows_per_step))


def advanced(members: DataFrame, due: DataFrame) -> DataFrame:
    """The states of `due` (see `limits`) after one more step.

    members: dataset_id, source_row_no, eoi (64 hex digits). Members that share a row number go
    in order of their eoi. A dataset's members of a step are streamed through one task, which
    holds a batch of them.
    """
    span = due.agg(F.min("last_row"), F.max("upto")).first()  # two numbers, which the scan can skip row groups by
    if span[0] is None:
        return members.sparkSession.createDataFrame([], STATE)
    near = members.where((F.col("source_row_no") > span[0]) & (F.col("source_row_no") <= span[1]))
    rows = near.join(due.select("dataset_id", "last_row", "upto"), "dataset_id").where("source_row_no > last_row and source_row_no <= upto")
    ordered = F.array_sort(F.collect_list(F.struct("source_row_no", "eoi")))
    data = F.unhex(F.array_join(F.transform(ordered, lambda x: x["eoi"]), ""))
    pieces = rows.groupBy("dataset_id", F.floor(F.col("source_row_no") / PIECE_ROWS).alias("piece")).agg(data.alias("data"), _checksum().alias("checksum"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, chain, n, checksum = None, None, 0, 0
        emit = lambda: pa.RecordBatch.from_arrays([pa.array([own]), pa.array([n], pa.int64()), pa.array([chain.hex()]), pa.array([checksum], pa.int64())], ["dataset_id", "n", "hashed", "sum"])
        for batch in batches:
            for dataset, start, piece, piece_sum in zip(*(batch.column(c).to_pylist() for c in ("dataset_id", "chain", "data", "checksum"))):
                if dataset != own:
                    if chain is not None:
                        yield emit()
                    own, chain, n, checksum = dataset, Chain.resumed(start), 0, 0
                chain.add(piece)
                n, checksum = n + len(piece) // 32, checksum ^ piece_sum
        if chain is not None:
            yield emit()

    started = pieces.join(due.select("dataset_id", "chain"), "dataset_id").repartition("dataset_id").sortWithinPartitions("dataset_id", "piece")
    folded = started.select("dataset_id", "chain", "data", "checksum").mapInArrow(fold, "dataset_id string, n long, hashed string, sum long")
    after = due.join(folded, "dataset_id", "left")  # a stretch may hold no member
    return after.select(
        "dataset_id",
        (F.col("step") + 1).alias("step"),
        F.col("upto").alias("last_row"),
        (F.col("n_members") + F.coalesce("n", F.lit(0))).alias("n_members"),
        F.coalesce("hashed", "chain").alias("chain"),
        F.col("checksum").bitwiseXOR(F.coalesce("sum", F.lit(0))).alias("checksum"),
    )


def fold_population(members: DataFrame, path: str, rows_per_step: int = 1 << 20, most_steps: int | None = None) -> DataFrame:
    """Folds members step by step into the table of states at `path`; dataset_id, n_members, fingerprint of finished datasets.

    A step takes `rows_per_step` row numbers of each dataset. Whatever ends a call, the next one
    with the same path goes on; most_steps ends it on purpose. The result equals the fold over
    everything at once, with members added since after the last ones as well.
    """
    spark, span, steps = members.sparkSession, checkpointed(reach(members)), 0
    stored = stored_states(spark, path)
    stale = stored.join(valid_states(members, stored).select("dataset_id"), "dataset_id", "left_anti").select("dataset_id", (F.col("step") + 1).alias("step"))
    afresh = checkpointed(starts(span).join(stale, "dataset_id").select(*stored.columns))
    if not afresh.isEmpty():
        afresh.write.mode("append").parquet(path)
    while True:
        states = checkpointed(stored_states(spark, path))
        due = checkpointed(limits(span, states, rows_per_step))
        if due.isEmpty() or (most_steps is not None and steps >= most_steps):
            break
        advanced(members, due).write.mode("append").parquet(path)
        steps += 1
    done = states.join(due.select("dataset_id"), "dataset_id", "left_anti").join(span.select("dataset_id"), "dataset_id", "left_semi")
    return done.select("dataset_id", "n_members", framing.population_seal(F.col("chain"), F.col("n_members")).alias("fingerprint"))

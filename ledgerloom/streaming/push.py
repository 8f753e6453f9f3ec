"""Pushes the events of an append-only log to their channels, each once.

A stream reads the log; every micro-batch is written into a folder of its number, which replaces
what an earlier try of the same number has left. Which events a number has is in the stream's
checkpoint, so a batch that was written but not acknowledged before a crash is written again as
it was: none is lost, none is there twice. Subscribers read a channel from a number on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

#: Channel of events without an engagement.
SHARED = "demo"


def channel(engagement_id: str = "engagement_id") -> F.Column:
    """Name of the channel of an engagement."""
    return F.concat(F.lit("engagement:"), F.coalesce(F.nullif(F.col(engagement_id), F.lit("")), F.lit(SHARED)))


def push_events(log: DataFrame, path: str, checkpoint: str, told: Callable[[DataFrame, int], None] = lambda batch, number: None) -> DataStreamWriter:
    """A writer that pushes a streamed log (engagement_id and what an event says) to the channels below `path`.

    told is called with a batch once it is written, with its number; where it fails the batch is
    pushed again under the same number.
    """

    def push(batch: DataFrame, number: int) -> None:
        place = f"{path}/number={number}"
        batch.withColumn("channel", channel()).write.mode("overwrite").partitionBy("channel").parquet(place)
        told(batch.sparkSession.read.parquet(place), number)

    return log.writeStream.foreachBatch(push).option("checkpointLocation", checkpoint)


def start(log: DataFrame, path: str, checkpoint: str, **trigger: str | bool) -> StreamingQuery:
    """Pushes what is there, and what comes, by a trigger."""
    return push_events(log, path, checkpoint).trigger(**trigger).start()


def channel_events(spark: SparkSession, path: str, engagement_id: str, after: int = -1) -> DataFrame | None:
    """Events of a channel pushed with higher numbers than `after`, with their number; None before the first push.

    Numbers and channels are partitions, so replaying the end of a channel reads the end of it.
    """
    try:
        pushed = spark.read.option("basePath", path).parquet(f"{path}/number=*")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return pushed.where((F.col("number") > after) & (F.col("channel") == f"engagement:{engagement_id or SHARED}"))

"""Session factory: UTC, ANSI arithmetic and adaptive execution."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """The active session with the engine's settings, or a new one."""
    builder = SparkSession.builder.appName("ledgerloom").config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share: the session's `spark.checkpoint.dir`.

    Only on one machine may that be unset, as in tests: then it is a folder of the warehouse.
    """
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` cut from its lineage, kept in the shared folder; survives the loss of executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


@contextmanager
def releasing(spark: SparkSession) -> Iterator[None]:
    """Shuffles of frames that are made and run inside go with their action, not with a later garbage collection of the driver."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stored(df: DataFrame) -> DataFrame:
    """As `checkpointed`, by column: many or wide rows take a fraction of the disk, and a reader takes the columns that it needs."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    with releasing(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that are sent to every executor at most.
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df`, marked to be sent to every executor if it has few rows; it should be cheap to count, as a checkpoint is."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df

"""Tables behind a log of numbered commits, which several writers may add to at once.

A writer puts its rows into a folder of its own attempt, then claims the next number of the log
by a file that is put there only if it is absent. Of two writers one gets the number; the other
reads what was committed in between, drops what is there by now and tries the next. Readers see
the attempts that the log names up to the version that they took, and nothing else: what a
failed or beaten attempt has left is no part of any version.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.operators.runs import guarded_evidence, new_results

_LOG = "version long, attempt string, table_names array<string>"


class Conflict(RuntimeError):
    """Another writer has committed what this one would."""


def put_if_absent(spark: SparkSession, path: str, content: str) -> bool:
    """Makes a file with this content, whole or not at all; False if there is one of this name.

    A local file gets its name by a link, any other by a rename of the file system that refuses
    to overwrite, which HDFS does in one step.
    """
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        os.makedirs(os.path.dirname(parts.path), exist_ok=True)
        draft = f"{os.path.dirname(parts.path)}/.{uuid.uuid4().hex}"
        with open(draft, "w", encoding="utf-8") as file:
            file.write(content)
            file.flush()
            os.fsync(file.fileno())
        try:
            os.link(draft, parts.path)
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True
    jvm, configuration = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    files = target.getFileSystem(configuration)
    stream = files.create(draft, False)
    stream.write(bytearray(content.encode()))
    stream.close()
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), configuration).rename(draft, target, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as error:
        files.delete(draft, False)
        if "FileAlreadyExistsException" in str(error):
            return False
        raise
    return True


@dataclass(frozen=True)
class Snapshot:
    """A version of the tables under a path; version 0 has none."""

    spark: SparkSession
    path: str
    version: int
    attempts: tuple[tuple[str, tuple[str, ...]], ...]

    def table(self, name: str, since: int = 0) -> DataFrame | None:
        """Rows of a table that the commits after `since` have added; None if no commit holds it."""
        folders = [f"{self.path}/{attempt}/{name}" for attempt, names in self.attempts[since:] if name in names]
        return self.spark.read.parquet(*folders) if folders else None


def snapshot(spark: SparkSession, path: str) -> Snapshot:
    """The latest version. The log is read as a table: a row for each commit, whatever a commit holds."""
    try:
        rows = spark.read.schema(_LOG).json(f"{path}/log").orderBy("version").collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":  # nothing has been committed
            raise
        rows = []
    if [r.version for r in rows] != list(range(1, len(rows) + 1)):
        raise RuntimeError(f"the log of {path} has gaps")
    return Snapshot(spark, path, len(rows), tuple((r.attempt, tuple(r.table_names)) for r in rows))


def written(tables: dict[str, DataFrame], path: str) -> str:
    """Writes tables into a folder of a new attempt, which no reader sees; gives its name."""
    attempt = f"attempt-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{path}/{attempt}/{name}")
    return attempt


def claimed(spark: SparkSession, path: str, version: int, attempt: str, names: list[str]) -> bool:
    """Makes an attempt the commit of this number, unless there is one."""
    entry = json.dumps({"version": version, "attempt": attempt, "table_names": sorted(names)})
    return put_if_absent(spark, f"{path}/log/{version:012d}.json", entry)


def commit(spark: SparkSession, path: str, make: Callable[[Snapshot], dict[str, DataFrame]], most_tries: int = 20) -> int:
    """Commits the tables that `make` gives for a snapshot; a beaten try is made anew for the next. Gives the version."""
    for _ in range(most_tries):
        base = snapshot(spark, path)
        tables = make(base)
        attempt = written(tables, path)
        if claimed(spark, path, base.version + 1, attempt, list(tables)):
            return base.version + 1
    raise Conflict(f"{path}: beaten {most_tries} times")


IDENTITY = ["firm_id", "run_id", "occurrence_fingerprint"]


def insert_results(results: DataFrame, evidence: DataFrame, path: str, members: DataFrame | None = None, most_tries: int = 20, before_claim: Callable[[], object] = lambda: None) -> int:
    """Inserts results that aren't stored yet with the evidence of those, as one commit; gives the version.

    results: IDENTITY and what a result holds; evidence: IDENTITY and what it points at. However
    many writers insert the same occurrence, one of them stores it, with its own evidence; the
    evidence of the others is dropped with their result. members: where given, evidence must lie
    within it, or the insert fails. A beaten writer looks only at what was committed since, from
    what it has written already. before_claim is called when rows are written, for tests.
    """
    spark, since = results.sparkSession, 0
    for _ in range(most_tries):
        base = snapshot(spark, path)
        stored = base.table("results", since)
        fresh = results.dropDuplicates(IDENTITY) if stored is None else new_results(results, stored)
        attempt = written({"results": fresh}, path)
        results = spark.read.parquet(f"{path}/{attempt}/results")  # from here on what is written, not what it came from
        own = evidence.join(results.select(*IDENTITY), IDENTITY, "left_semi")
        (guarded_evidence(own, members) if members is not None and since == 0 else own).write.parquet(f"{path}/{attempt}/evidence")
        evidence = spark.read.parquet(f"{path}/{attempt}/evidence")
        before_claim()
        if claimed(spark, path, base.version + 1, attempt, ["results", "evidence"]):
            return base.version + 1
        since = base.version
    raise Conflict(f"{path}: beaten {most_tries} times")


def deleted_attempts(spark: SparkSession, path: str) -> list[str]:
    """Removes the folders that no commit names; to be called when no writer is at work."""
    known = {attempt for attempt, _ in snapshot(spark, path).attempts}
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = [s.getPath() for s in files.listStatus(root) if s.getPath().getName().startswith("attempt-") and s.getPath().getName() not in known]
    for folder in gone:
        files.delete(folder, True)
    return [folder.getName() for folder in gone]

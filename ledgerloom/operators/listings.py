"""Listings of runs, jobs, datasets, results and tests for those who may see them, all requests in one job.

asks are rows firm_id, user_id and what is asked for. Each is judged first: what is of another
firm doesn't exist for it (NOT_FOUND), what is of an engagement that the user isn't a member of is
FORBIDDEN, and only GRANTED ones get rows. Tops are `row_number() <= k`, which Spark limits
before the shuffle, so a group of any size sends k rows of each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.workflow import FEED_ROWS

#: Statuses of datasets that runs may use, and the most tests that a listing has.
CONSUMABLE, MOST_TESTS = ("COMPLETED", "COMPLETED_WITH_ISSUES"), 500
_ASKER = ("firm_id", "user_id")


def engagement_access(asks: DataFrame, engagements: DataFrame, members: DataFrame) -> DataFrame:
    """asks (firm_id, user_id, engagement_id), each once, with `access`."""
    own = engagements.select("firm_id", "engagement_id", F.lit(True).alias("is_found")).distinct()
    joined = members.select("engagement_id", "user_id", F.lit(True).alias("is_member")).distinct()
    looked = asks.select(*_ASKER, "engagement_id").distinct().join(own, ["firm_id", "engagement_id"], "left").join(joined, ["engagement_id", "user_id"], "left")
    access = F.when(F.col("is_found").isNull(), "NOT_FOUND").when(F.col("is_member").isNull(), "FORBIDDEN").otherwise("GRANTED")
    return looked.select(*_ASKER, "engagement_id", access.alias("access"))


def run_access(asks: DataFrame, runs: DataFrame, engagements: DataFrame, members: DataFrame) -> DataFrame:
    """asks (firm_id, user_id, run_id), each once, with the run's engagement and `access`."""
    placed = asks.select(*_ASKER, "run_id").distinct().join(runs.select("firm_id", "run_id", "engagement_id"), ["firm_id", "run_id"], "left")
    judged = engagement_access(placed.where("engagement_id is not null"), engagements, members)
    looked = placed.join(judged, [*_ASKER, "engagement_id"], "left")
    return looked.select(*_ASKER, "run_id", "engagement_id", F.coalesce("access", F.lit("NOT_FOUND")).alias("access"))


def _granted(judged: DataFrame, on: str) -> DataFrame:
    return judged.where("access = 'GRANTED'").select(*_ASKER, on)


def top(rows: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each group, with their `place` from 1."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= most)


def runs_listed(judged: DataFrame, runs: DataFrame, most: int = FEED_ROWS) -> DataFrame:
    """The newest runs of each engagement that was granted, for each who asked: runs with user_id and place."""
    newest = top(runs, ["firm_id", "engagement_id"], [F.desc("created_at"), F.asc("run_id")], most)
    return _granted(judged, "engagement_id").join(newest, ["firm_id", "engagement_id"])


def datasets_listed(judged: DataFrame, datasets: DataFrame, most: int = FEED_ROWS) -> DataFrame:
    """The newest datasets that runs may use, of each engagement that was granted."""
    usable = datasets.where(F.col("status").isin(*CONSUMABLE))
    newest = top(usable, ["firm_id", "engagement_id"], [F.desc("created_at"), F.asc("dataset_id")], most)
    return _granted(judged, "engagement_id").join(newest, ["firm_id", "engagement_id"])


def jobs_listed(judged: DataFrame, jobs: DataFrame) -> DataFrame:
    """All attempts of each run that was granted; `place` is their order."""
    return _granted(judged, "run_id").join(top(jobs, ["firm_id", "run_id"], [F.asc("attempt_no")], 1 << 30), ["firm_id", "run_id"])


def results_listed(judged: DataFrame, results: DataFrame, after: DataFrame | None = None, most: int = 500) -> DataFrame:
    """A page of each granted run's results by semantic fingerprint, then id: those after the last one seen.

    after: firm_id, user_id, run_id, semantic_fingerprint, result_id of the last row of the page
    before; those who have none get the first page.
    """
    seen = _granted(judged, "run_id")
    if after is not None:
        last = after.select(*_ASKER, "run_id", F.struct("semantic_fingerprint", "result_id").alias("last"))
        seen = seen.join(last, [*_ASKER, "run_id"], "left")
    rows = seen.join(results, ["firm_id", "run_id"])
    if after is not None:
        rows = rows.where(F.col("last").isNull() | (F.struct("semantic_fingerprint", "result_id") > F.col("last"))).drop("last")
    return top(rows, [*_ASKER, "run_id"], [F.asc("semantic_fingerprint"), F.asc("result_id")], min(max(most, 1), 1_000))


def tests_listed(tests: DataFrame, versions: DataFrame, kinds: DataFrame, most: int = MOST_TESTS) -> DataFrame:
    """A firm's tests by key that have a current version which is ACTIVE, with the dataset kinds of their executor (none where no executor is known).

    tests: firm_id, test_key, name, test_type, current_version_id; versions: firm_id, version_id,
    status, kind; kinds: test_type, kind, dataset_kinds. The first `most` with any current
    version are looked at, as listings are cut before versions are read.
    """
    first = top(tests.where("current_version_id is not null"), ["firm_id"], [F.asc("test_key")], most)
    active = versions.where("status = 'ACTIVE'").select("firm_id", F.col("version_id").alias("current_version_id"), "kind")
    named = first.join(active, ["firm_id", "current_version_id"]).join(F.broadcast(kinds), ["test_type", "kind"], "left")  # a row for each executor
    return named.select("firm_id", "test_key", "name", "test_type", F.coalesce("dataset_kinds", F.array().cast("array<string>")).alias("dataset_kinds"))


def evidence_listed(judged: DataFrame, results: DataFrame, evidence: DataFrame, lines: DataFrame, balances: DataFrame, records: DataFrame, most: int = FEED_ROWS) -> DataFrame:
    """The first rows of evidence of each result of a granted run, with the cells of the source row that each leads to.

    evidence: evidence_id, result_id, evidence_type, source_row_no, record_id, line_id,
    balance_id; lines: line_id, record_id; balances: balance_id, record_id; records: record_id,
    cells (structs i, h, v). Evidence of rows without a number comes last, ties by evidence_id.
    `cells` are structs h, v in column order; null where no record is found.
    """
    wanted = _granted(judged, "run_id").join(results.select("firm_id", "run_id", "result_id"), ["firm_id", "run_id"])
    first = top(evidence, ["result_id"], [F.asc_nulls_last("source_row_no"), F.asc("evidence_id")], most)
    rows = wanted.join(first, "result_id")
    by = lambda table, key: table.select(key, F.col("record_id").alias(f"{key}_record"))
    rows = rows.join(by(lines, "line_id"), "line_id", "left").join(by(balances, "balance_id"), "balance_id", "left")
    rows = rows.withColumn("traced_id", F.coalesce("record_id", "line_id_record", "balance_id_record"))
    in_order = F.transform(F.array_sort("cells"), lambda c: F.struct(F.coalesce(c["h"], F.lit("")).alias("h"), c["v"].alias("v")))
    cells = records.select(F.col("record_id").alias("traced_id"), in_order.alias("cells"))
    return rows.join(cells, "traced_id", "left").select(*_ASKER, "run_id", "result_id", "place", "evidence_id", "evidence_type", "source_row_no", "traced_id", "cells")


def page(rows: DataFrame, order: list[str], after: tuple | None, take: int) -> DataFrame:
    """The next rows in an order whose columns tell rows apart: those greater than the last one seen, compared column by column; nulls come first."""
    if after is not None:
        later, equal = F.lit(False), F.lit(True)
        for name, value in zip(order, after, strict=True):
            seen = F.lit(value).cast(rows.schema[name].dataType)
            greater = F.col(name).isNotNull() if value is None else F.coalesce(F.col(name) > seen, F.lit(False))
            later, equal = later | (equal & greater), equal & F.col(name).eqNullSafe(seen)
        rows = rows.where(later)
    return rows.orderBy(*order).limit(take)

"""Imports, runs and matters from start to end: what is new, what may run, and what state events leave."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import key
from ledgerloom.operators.executors import ConfigurationError, executor
from ledgerloom.operators.ingest import _leb128, frame

# Imports


def known_content(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Files whose bytes (sha256) the firm has imported already; such imports are refused."""
    return files.join(stored.select("firm_id", "sha256").distinct(), ["firm_id", "sha256"], "left_semi")


def new_versions(proposed: DataFrame, versions: DataFrame) -> DataFrame:
    """Proposed (name, hash) that no version of the name holds, numbered after its latest; nothing is overwritten."""
    fresh = proposed.select("name", "hash").distinct().join(versions.select("name", "hash"), ["name", "hash"], "left_anti")
    latest = versions.groupBy("name").agg(F.max("version_no").alias("latest"))
    turn = F.row_number().over(Window.partitionBy("name").orderBy("hash"))
    return fresh.join(latest, "name", "left").select("name", "hash", (F.coalesce("latest", F.lit(0)) + turn).alias("version_no"))


def source_identity(cells: Column, fields: dict[str, str]) -> Column:
    """Struct of source fields taken from cells by an explicit map of header to field; the first header in any case wins."""
    found = {field: F.get(F.filter(cells, lambda c: key(c["h"]) == header.strip().lower()), F.lit(0))["v"].alias(field) for header, field in fields.items()}
    return F.struct(*found.values())


# Runs


@dataclass(frozen=True)
class PinnedTest:
    """A test of a run: its type and kind name the executor, which takes these parameters."""

    test_key: str
    kind: str
    name: str
    parameters: dict[str, Any]


def preflight(tests: Iterable[PinnedTest], parse: dict[tuple[str, str], Callable[[dict[str, Any]], Any]]) -> list[tuple[PinnedTest, Callable[..., DataFrame], Any]]:
    """Executors and parsed parameters of all tests; one that can't run stops the run before any result."""
    ready, failed = [], []
    for test in tests:
        try:
            ready.append((test, executor(test.kind, test.name), parse.get((test.kind, test.name), lambda p: p)(test.parameters)))
        except ConfigurationError as error:
            failed.append(f"{test.test_key}: {error}")
    if failed:
        raise ConfigurationError("; ".join(failed))
    return ready


def run_tests(ready: list[tuple[PinnedTest, Callable[..., DataFrame], Any]], inputs: Callable[[PinnedTest, Any], tuple]) -> dict[str, DataFrame]:
    """Results by test; `inputs` gives an executor's tables and settings. Each is a plan of its own, run when written."""
    return {test.test_key: run(*inputs(test, settings)) for test, run, settings in ready}


# Identities of configuration: a few strings each, framed on the driver.


def sequence(parts: list[bytes]) -> bytes:
    return b"\x02" + _leb128(len(parts)) + b"".join(parts)


def multiset(parts: list[bytes]) -> bytes:
    return b"\x04" + _leb128(len(parts)) + b"".join(sorted(parts))


def fields(parts: dict[str, bytes]) -> bytes:
    return b"\x03" + _leb128(len(parts)) + b"".join(frame(k) + parts[k] for k in sorted(parts))


def fingerprint(tag: str, body: bytes) -> str:
    return hashlib.sha256(frame(tag) + body).hexdigest()


def _named(row: dict[str, Any], names: tuple[str, ...]) -> bytes:
    return fields({n: frame(None if row.get(n) is None else str(row[n])) for n in names})


def config_fingerprint(anchor: str, datasets: list[dict], tests: list[dict], resolutions: list[dict], mappings: list[str], build: str, materiality: str | None = None, risk_model: str | None = None) -> str:
    """Identity of a run's configuration; the order of its parts doesn't matter."""
    return fingerprint(
        "g4cfg.3",
        fields(
            {
                "semanticScopeAnchor": frame(anchor),
                "datasetScope": sequence([_named(d, ("datasetHash", "datasetKind", "lineageClass")) for d in sorted(datasets, key=lambda d: d["datasetHash"])]),
                "testPins": sequence([_named(t, ("testKey", "version", "versionHash", "ruleKey", "ruleVersion", "ruleVersionHash", "effectiveParametersHash")) for t in sorted(tests, key=lambda t: t["testKey"])]),
                "scopeResolutions": sequence([_named(r, ("testKey", "datasetHash", "eligibility", "resolutionAlgorithmVersion", "eligiblePopulationFingerprint")) for r in sorted(resolutions, key=lambda r: (r["testKey"], r["datasetHash"]))]),
                "consumedMappings": multiset([frame(m) for m in mappings]),
                "engineBuildVersion": frame(build),
                "materialityVersionKey": frame(materiality),
                "riskModelVersionKey": frame(risk_model),
            }
        ),
    )


# Matters


def exception_states(events: DataFrame) -> DataFrame:
    """Status of each exception: that of its last STATUS or REOPEN event, OPEN without one."""
    last = F.max_by(F.when(F.col("action").isin("STATUS", "REOPEN"), F.col("to_status")), F.when(F.col("action").isin("STATUS", "REOPEN"), F.col("event_seq")))
    return events.groupBy("exception_id").agg(F.coalesce(last, F.lit("OPEN")).alias("status"), F.max("event_seq").alias("event_seq"))


def reviewable(events: DataFrame) -> DataFrame:
    """Review events that may stand: reviewers don't review what they prepared, and preparers belong to the engagement."""
    return events.where((F.col("reviewer_id") != F.col("preparer_id")) & F.col("preparer_is_member"))


def amounts_with_currency(findings: DataFrame) -> DataFrame:
    """Findings whose amounts and currencies come in pairs."""
    pair = lambda a, c: F.col(a).isNull() == F.col(c).isNull()
    return findings.where(pair("observed_amount", "observed_currency") & pair("exposure_amount", "exposure_currency"))


def document_counts(documents: DataFrame, transactions: DataFrame) -> DataFrame:
    """Documents with the number of their transactions, shown for parsed ones only."""
    counted = transactions.groupBy("document_id").agg(F.count("*").alias("n"))
    return documents.join(counted, "document_id", "left").withColumn("n_transactions", F.when(F.col("status") == "PARSED", F.coalesce("n", F.lit(0)))).drop("n")


def sessions(headers: DataFrame, matches: DataFrame, transactions: DataFrame) -> DataFrame:
    """Reconciliation sessions with their matches (source and target amount) as an array, and counts by status."""
    side = lambda s: transactions.select(F.col("id").alias(f"{s}_id"), F.col("amount").alias(f"{s}_amount"))
    rows = matches.join(side("source"), "source_id", "left").join(side("target"), "target_id", "left")
    pairs = F.array_sort(F.collect_list(F.struct("source_id", "target_id", "status", "source_amount", "target_amount")))
    counts = [F.count_if(F.col("status") == s).alias(s.lower()) for s in ("MATCHED", "PARTIAL", "UNMATCHED")]
    return headers.join(rows.groupBy("session_id").agg(pairs.alias("matches"), *counts), "session_id", "left")

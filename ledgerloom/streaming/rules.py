"""An extension: row rules and exact duplicates over a stream of transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.analyzers import keyed
from ledgerloom.operators.rules import ROW_RULES, Rule, evaluate


def streamed_findings(transactions: DataFrame, rules: list[Rule]) -> DataFrame:
    """Findings of the row rules as transactions arrive; stateless."""
    return evaluate(transactions, [r for r in rules if r.definition.get("type") in ROW_RULES])


def streamed_first_seen(transactions: DataFrame, delay: str = "72 hours") -> DataFrame:
    """The first transaction of each amount, counterparty and reference within the delay; state is bounded by it."""
    rows = keyed(transactions).where("minor <> 0").withWatermark("posted_at", delay)
    return rows.dropDuplicatesWithinWatermark(["minor", "party", "ref"])


def streamed_totals(transactions: DataFrame, window: str = "1 day", slide: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Number and sum of minor units by counterparty and sliding window."""
    rows = keyed(transactions).withWatermark("posted_at", delay)
    return rows.groupBy(F.window("posted_at", window, slide), "party").agg(F.count("*").alias("n"), F.sum("minor").alias("total"))

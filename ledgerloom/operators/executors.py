"""Frozen test executors: results and bounded evidence over a fixed population.

Members: dataset_id, source_row_no, content_hash, eoi. Every executor reads members only, so
its results depend on the frozen population alone. A registry names executors by test type and
kind; parameters are checked before anything runs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation
from math import gcd
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.money import canon_amount, single_sided
from ledgerloom.operators.accounting import entries
from ledgerloom.session import broadcast_if_small, checkpointed

EVIDENCE = 3
MEMBER = ["dataset_id", "source_row_no"]
Executor = Callable[..., DataFrame]
REGISTRY: dict[tuple[str, str], Executor] = {}


class ConfigurationError(ValueError):
    """Parameters or a test that no executor can run."""


def register_test(kind: str, name: str) -> Callable[[Executor], Executor]:
    """Registers an executor under a test type and kind."""

    def put(executor: Executor) -> Executor:
        REGISTRY[kind, name] = executor
        return executor

    return put


def executor(kind: str, name: str) -> Executor:
    """The registered executor; tests without one fail before any result."""
    if (kind, name) not in REGISTRY:
        raise ConfigurationError(f"no executor for {kind}:{name}")
    return REGISTRY[kind, name]


def _result(code: str, severity: str) -> dict[str, Column]:
    return {"result_code": F.lit(code), "severity": F.lit(severity)}


def population(members: DataFrame, resolutions: DataFrame, run_datasets: DataFrame, records: DataFrame, preparation_id: Any, test_version_id: Any) -> DataFrame:
    """Members of a test's frozen population with their records: MEMBER, content_hash, eoi, record_id, raw_hash and dataset_hash.

    members: preparation_id, test_version_id, MEMBER, content_hash, eoi; resolutions:
    preparation_id, test_version_id, dataset_id, eligibility; run_datasets: preparation_id,
    dataset_id, dataset_hash; records: record_id, MEMBER, raw_hash. A member counts where its
    dataset is one of the preparation's, resolved as other than NOT_ELIGIBLE, and its record is
    there. What says so is a row per dataset, sent to all tasks while those are few; members and
    records meet by dataset and row, so a large dataset is no one task's.
    """
    of_test = (F.col("preparation_id") == preparation_id) & (F.col("test_version_id") == test_version_id)
    eligible = resolutions.where(of_test & (F.col("eligibility") != "NOT_ELIGIBLE")).select("dataset_id").distinct()
    datasets = checkpointed(run_datasets.where(F.col("preparation_id") == preparation_id).select("dataset_id", "dataset_hash").join(eligible, "dataset_id"))
    few = broadcast_if_small(datasets)
    frozen = members.where(of_test).select(*MEMBER, "content_hash", "eoi").join(few, "dataset_id")
    known = records.select(*MEMBER, "record_id", "raw_hash").join(few.select("dataset_id"), "dataset_id", "left_semi")
    return frozen.join(known, MEMBER)


@register_test("DATA_QUALITY", "POPULATION_MEMBER")
def population_member(members: DataFrame) -> DataFrame:
    """A result for every member."""
    return members.select(*MEMBER, "content_hash").withColumns(_result("DQ_POPULATION_MEMBER", "LOW"))


@register_test("DATA_QUALITY", "SOURCE_TO_CANONICAL_MISMATCH")
def hash_mismatch(members: DataFrame, records: DataFrame) -> DataFrame:
    """Members whose frozen hash isn't their record's raw_hash."""
    joined = members.select(*MEMBER, "content_hash").join(records.select(*MEMBER, "raw_hash"), MEMBER)
    return joined.where("content_hash <> raw_hash").select(*MEMBER, "content_hash", "raw_hash").withColumns(_result("DQ_SOURCE_TO_CANONICAL_MISMATCH", "HIGH"))


@register_test("ACCOUNTING_INTEGRITY", "UNBALANCED_JE")
def unbalanced_entries(members: DataFrame, lines: DataFrame) -> DataFrame:
    """Unbalanced entries of the population. An entry of which only some lines are members fails the whole run.

    lines: as `accounting.entries` takes them. Members are marked once, and an entry's lines,
    members and totals are one aggregate.
    """
    marked = lines.join(members.select(*MEMBER, F.lit(True).alias("is_member")), MEMBER, "left")
    found = entries(marked, n_member_lines=F.count("is_member")).where("n_member_lines > 0")
    partly = F.concat(F.lit("entry is partly in the population: "), F.col("source_entry_id"))
    wrong = found.where(F.assert_true(F.col("n_lines") == F.col("n_member_lines"), partly).isNull()).where("balance_status = 'UNBALANCED'")
    return wrong.select("dataset_id", "source_entry_id", canon_amount(F.col("debit_total")).alias("debit_total"), canon_amount(F.col("credit_total")).alias("credit_total"), canon_amount(F.col("difference")).alias("difference"), "balance_currency").withColumns(_result("AI_UNBALANCED_JOURNAL_ENTRY", "HIGH"))


@register_test("ACCOUNTING_INTEGRITY", "INVALID_DEBIT_CREDIT")
def invalid_sides(members: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines with a negative side or with both; reasons in a fixed order."""
    debit, credit = F.col("transaction_debit"), F.col("transaction_credit")
    zero = lambda c: F.coalesce(c, F.lit(0))
    reasons = F.concat_ws(",", F.when(zero(debit) < 0, "NEGATIVE_DEBIT"), F.when(zero(credit) < 0, "NEGATIVE_CREDIT"), F.when((zero(debit) != 0) & (zero(credit) != 0), "BOTH_SIDED"))
    joined = lines.join(members.select(*MEMBER), MEMBER, "left_semi").withColumn("reasons", reasons)
    return joined.where("reasons <> ''").select(*MEMBER, "reasons").withColumns(_result("AI_INVALID_DEBIT_CREDIT", "HIGH"))


def _first_rows(rows: DataFrame, group: list[str], k: int) -> DataFrame:
    """The first k rows of each group, numbered."""
    order = Window.partitionBy(*group).orderBy(F.asc_nulls_last("source_row_no"))
    return rows.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


@register_test("ACCOUNTING_INTEGRITY", "TB_ACCOUNT_DUPLICATION")
def duplicated_accounts(members: DataFrame, balances: DataFrame) -> DataFrame:
    """Accounts that stand more than once in a trial balance; balances: dataset_id, trial_balance_id, account, source_row_no."""
    rows = balances.join(members.select(*MEMBER), MEMBER, "left_semi")
    return rows.groupBy("dataset_id", "trial_balance_id", "account").agg(F.count("*").alias("n")).where("n > 1").withColumns(_result("AI_TB_ACCOUNT_DUPLICATION", "MEDIUM"))


def duplicated_accounts_evidence(members: DataFrame, balances: DataFrame, k: int = EVIDENCE) -> DataFrame:
    """The first k rows of each duplicated account."""
    group = ["dataset_id", "trial_balance_id", "account"]
    rows = balances.join(members.select(*MEMBER), MEMBER, "left_semi")
    found = duplicated_accounts(members, balances).select(*group)
    return _first_rows(rows.join(found, group, "left_semi"), group, k).select(*group, "position", "source_row_no")


@dataclass(frozen=True)
class RoundNumbers:
    """Parameters of the round number test; the rate is the fraction num / denom."""

    quantum: Decimal
    least_population: int
    least_round: int
    rate_num: int
    rate_denom: int

    @classmethod
    def parse(cls, parameters: dict[str, Any]) -> RoundNumbers:
        try:
            quantum = Decimal(parameters["roundingQuantum"])
            numbers = [parameters[k] for k in ("minimumPopulation", "minimumRoundCount", "rateThresholdNum", "rateThresholdDenom")]
        except (KeyError, InvalidOperation, TypeError) as error:
            raise ConfigurationError(str(error)) from error
        if not quantum.is_finite() or quantum <= 0 or -quantum.as_tuple().exponent > 6 or len(quantum.as_tuple().digits) > 24:
            raise ConfigurationError("roundingQuantum must be above 0 with at most 6 places")
        if any(type(n) is not int or n < 0 for n in numbers) or not 0 < numbers[2] <= numbers[3] or gcd(numbers[2], numbers[3]) != 1:
            raise ConfigurationError("counts must be integers and the rate a reduced fraction in (0, 1]")
        return cls(quantum, *numbers)


def scalars(members: DataFrame, lines: DataFrame) -> DataFrame:
    """Member lines with exactly one positive side and a currency: adds scalar."""
    rows = lines.join(members.select(*MEMBER), MEMBER, "left_semi")
    return rows.withColumn("scalar", single_sided(F.col("transaction_debit"), F.col("transaction_credit"))).where(F.col("scalar").isNotNull() & F.col("transaction_currency").isNotNull())


def _is_round(settings: RoundNumbers) -> Column:
    return F.col("scalar").cast("decimal(24,6)") % F.lit(settings.quantum).cast("decimal(24,6)") == 0


@register_test("STATISTICAL", "ROUND_NUMBER_FREQUENCY")
def round_frequency(members: DataFrame, lines: DataFrame, settings: RoundNumbers) -> DataFrame:
    """Datasets and currencies in which round amounts reach the rate: population and n_round; compared as integers."""
    grouped = scalars(members, lines).groupBy("dataset_id", "transaction_currency").agg(F.count("*").alias("population"), F.count_if(_is_round(settings)).alias("n_round"))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    reached = wide("n_round") * settings.rate_denom >= wide("population") * settings.rate_num
    found = grouped.where((F.col("population") >= settings.least_population) & (F.col("n_round") >= settings.least_round) & reached)
    return found.withColumns(_result("ST_ROUND_NUMBER_RATE_EXCEEDED", "INFO"))


def round_evidence(members: DataFrame, lines: DataFrame, settings: RoundNumbers, k: int = EVIDENCE) -> DataFrame:
    """The first k round lines of each signal."""
    group = ["dataset_id", "transaction_currency"]
    rows = scalars(members, lines).where(_is_round(settings))
    found = round_frequency(members, lines, settings).select(*group)
    return _first_rows(rows.join(found, group, "left_semi"), group, k).select(*group, "position", "source_row_no", canon_amount(F.col("scalar")).alias("scalar"))


@register_test("STATISTICAL", "DUPLICATE_AMOUNT_FREQUENCY")
def duplicate_amounts(members: DataFrame, lines: DataFrame, least: int = 2) -> DataFrame:
    """Amounts that occur at least `least` times in a dataset and currency; the amount is text with six places."""
    if least < 2:
        raise ConfigurationError("minimumOccurrenceCount must be at least 2")
    grouped = scalars(members, lines).groupBy("dataset_id", "transaction_currency", canon_amount(F.col("scalar")).alias("scalar")).agg(F.count("*").alias("n"))
    return grouped.where(F.col("n") >= least).withColumns(_result("ST_DUPLICATE_AMOUNT_DETECTED", "LOW"))


def duplicate_evidence(members: DataFrame, lines: DataFrame, least: int = 2, k: int = EVIDENCE) -> DataFrame:
    """The first k lines of each duplicated amount."""
    group = ["dataset_id", "transaction_currency", "scalar"]
    rows = scalars(members, lines).withColumn("scalar", canon_amount(F.col("scalar")))
    found = duplicate_amounts(members, lines, least).select(*group)
    return _first_rows(rows.join(found, group, "left_semi"), group, k).select(*group, "position", "source_row_no")

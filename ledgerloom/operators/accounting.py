"""Canonical accounting facts of ledgers and trial balances: contexts, accounts, entries, balances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONEY, TOTAL = "decimal(24,6)", "decimal(34,6)"


def contexts(lines: DataFrame) -> DataFrame:
    """Distinct (dataset_id, source_system, source_entity, source_ledger); null counts as empty."""
    names = ("source_system", "source_entity", "source_ledger")
    return lines.select("dataset_id", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in names)).distinct()


def accounts(lines: DataFrame, by: tuple[str, ...] = ("dataset_id",)) -> DataFrame:
    """Accounts with their first row and number of rows; the name is that of the first row, null or not."""
    return lines.where(F.col("account").isNotNull()).groupBy(*by, "account").agg(F.min("source_row_no").alias("first_row_no"), F.min_by("account_name", "source_row_no").alias("account_name"), F.count("*").alias("occurrence_count"))


def numbered_lines(lines: DataFrame) -> DataFrame:
    """Adds line_no: 1 to n within an entry in row order; lines without an entry take their row number."""
    order = Window.partitionBy("dataset_id", "source_entry_id").orderBy("source_row_no")
    grouped = lines.where(F.col("source_entry_id").isNotNull()).withColumn("line_no", F.row_number().over(order).cast("long"))
    return grouped.unionByName(lines.where(F.col("source_entry_id").isNull()).withColumn("line_no", F.col("source_row_no").cast("long")))


def entries(lines: DataFrame, **counted: Column) -> DataFrame:
    """Journal entries as the source groups them, with totals, and how far they balance; `counted`: more aggregates by name.

    lines: dataset_id, source_entry_id, source_row_no, entry_date, transaction_debit,
    transaction_credit, transaction_currency, functional_debit, functional_credit,
    functional_currency. Only lines with an amount count. An entry in one currency (a missing
    one differs from any) is AVAILABLE and balanced or not; else functional amounts in one
    currency decide if as many lines have them; else an entry of several currencies is PARTIAL,
    any other NOT_AVAILABLE. Totals never mix currencies.
    """
    rows = lines.where(F.col("source_entry_id").isNotNull())

    def there(kind: str) -> Column:
        return F.col(f"{kind}_debit").isNotNull() | F.col(f"{kind}_credit").isNotNull()

    def side(name: str, kind: str) -> Column:
        return F.coalesce(F.sum(f"{kind}_{name}"), F.lit(0)).cast(TOTAL)

    def currencies(kind: str) -> Column:
        """0, 1 or more: none, one or several are told apart by the least and the greatest, in one exchange."""
        known = F.when(there(kind), F.col(f"{kind}_currency"))
        several = F.when(F.min(known).isNull(), 0).when(F.min(known) == F.max(known), 1).otherwise(2)
        return several + F.when(F.count_if(there(kind) & F.col(f"{kind}_currency").isNull()) > 0, 1).otherwise(0)

    def measures(kind: str, short: str) -> list[Column]:
        return [
            F.count_if(there(kind)).alias(f"{short}_lines"),
            currencies(kind).alias(f"{short}_kinds"),
            F.max(F.when(there(kind), F.col(f"{kind}_currency"))).alias(f"{short}_currency"),
            side("debit", kind).alias(f"{short}_debit"),
            side("credit", kind).alias(f"{short}_credit"),
        ]

    grouped = rows.groupBy("dataset_id", "source_entry_id").agg(F.count("*").alias("n_lines"), F.min_by("entry_date", "source_row_no").alias("entry_date"), *measures("transaction", "t"), *measures("functional", "f"), *(c.alias(name) for name, c in counted.items()))
    by_transaction = (F.col("t_kinds") == 1) & F.col("t_currency").isNotNull()
    by_functional = ~by_transaction & (F.col("f_kinds") == 1) & F.col("f_currency").isNotNull() & (F.col("f_lines") == F.col("t_lines"))
    pick = lambda t, f: F.when(by_transaction, F.col(t)).when(by_functional, F.col(f))
    out = grouped.withColumns(
        {
            "monetary_basis": F.when(by_transaction, "TRANSACTION").when(by_functional, "FUNCTIONAL"),
            "balance_currency": pick("t_currency", "f_currency"),
            "debit_total": pick("t_debit", "f_debit"),
            "credit_total": pick("t_credit", "f_credit"),
            "balance_capability": F.when(by_transaction | by_functional, "AVAILABLE").when(F.col("t_kinds") > 1, "PARTIAL").otherwise("NOT_AVAILABLE"),
        }
    )
    out = out.withColumn("difference", (F.col("debit_total") - F.col("credit_total")).cast(TOTAL))
    status = F.when(F.col("balance_capability") != "AVAILABLE", "NOT_EVALUABLE").when(F.col("difference") == 0, "BALANCED").otherwise("UNBALANCED")
    return out.withColumn("balance_status", status).drop(*(f"{short}_{name}" for short in "tf" for name in ("lines", "kinds", "currency", "debit", "credit")))


def trial_balance_rows(rows: DataFrame) -> DataFrame:
    """Trial balance rows with an account, amounts with six places."""
    amounts = ("opening_debit", "opening_credit", "period_debit", "period_credit", "closing_debit", "closing_credit")
    there = [c for c in amounts if c in rows.columns]
    return rows.where(F.col("account").isNotNull()).withColumns({c: F.col(c).cast(MONEY) for c in there})


def mapping_versions(events: DataFrame) -> DataFrame:
    """Versions of account mappings with the time at which the next one took over; events: account, version, target, at."""
    order = Window.partitionBy("account").orderBy("version")
    return events.withColumn("superseded_at", F.lead("at").over(order))


def current_mappings(events: DataFrame) -> DataFrame:
    """The latest version of each account's mapping: account, version, target."""
    return events.groupBy("account").agg(F.max("version").alias("version"), F.max_by("target", "version").alias("target"))

"""Bindings of the engine's inputs to the tables at hand, in Spark and, for the checks, in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables, at a path of any kind that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _money(value: str) -> Column:
    """Doubles with two places as exact decimals."""
    return (F.floor(F.col(value) * 100 + 0.5).cast("decimal(17,0)") / 100).cast("decimal(15,2)")


def _instant(name: str) -> Column:
    return F.col(name).cast("timestamp")


def _transactions(rows: DataFrame, **columns: Column) -> DataFrame:
    none = {"vat_amount": "decimal(15,2)", "account": "string", "value_date": "timestamp", "has_document": "boolean"}
    filled = {c: F.lit(None).cast(kind) for c, kind in none.items()} | columns
    order = ("row_no", "id", "reference", "amount", "vat_amount", "counterparty", "account", "posted_at", "value_date", "has_document")
    return rows.select(*(filled[c].alias(c) for c in order))


def event_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events: the only table with times of day."""
    return _transactions(
        table(spark, sf_dir, "events"),
        row_no=F.col("event_id"), id=F.col("event_id").cast("string"), reference=F.col("event_type"), amount=_money("value"),
        counterparty=F.col("user_id").cast("string"), posted_at=_instant("ts"),
    )


def order_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, with the first shipping date of their lines as value date."""
    shipped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("shipped"))
    joined = table(spark, sf_dir, "orders").join(shipped, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return _transactions(
        joined,
        row_no=F.col("o_orderkey"), id=F.col("o_orderkey").cast("string"), reference=F.col("o_orderkey").cast("string"), amount=_money("o_totalprice"),
        counterparty=F.col("o_custkey").cast("string"), account=F.col("o_orderpriority"), posted_at=_instant("o_orderdate"),
        value_date=_instant("shipped"), has_document=F.col("shipped").isNotNull(),
    )


LINE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def line_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with VAT by their tax rate; the id joins the keys of the line."""
    rows = table(spark, sf_dir, "lineitem")
    vat = (F.floor(F.col("l_extendedprice") * F.col("l_tax") * 100 + 0.5).cast("decimal(17,0)") / 100).cast("decimal(15,2)")
    line = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return _transactions(rows, row_no=F.col("l_orderkey"), id=line, reference=line, amount=_money("l_extendedprice"), vat_amount=vat, counterparty=F.col("l_suppkey").cast("string"), posted_at=_instant("l_shipdate"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as a general ledger; an order is an entry, and rows are numbered within the order by all columns."""
    rows = table(spark, sf_dir, "lineitem")
    number = F.col("l_orderkey") * 1000 + F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER[1:]))
    price = _money("l_extendedprice").cast("decimal(24,6)")
    none = F.lit(None)
    return rows.select(
        F.lit("ds1").alias("dataset_id"),
        number.alias("source_row_no"),
        F.col("l_orderkey").cast("string").alias("source_entry_id"),
        F.col("l_partkey").cast("string").alias("account"),
        F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("account_name"),
        F.to_date(_instant("l_shipdate")).alias("entry_date"),
        F.when(F.col("l_returnflag") != "R", price).alias("transaction_debit"),
        F.when(F.col("l_returnflag") == "R", price).alias("transaction_credit"),
        F.col("l_linestatus").alias("transaction_currency"),
        none.cast("decimal(24,6)").alias("functional_debit"),
        none.cast("decimal(24,6)").alias("functional_credit"),
        none.cast("string").alias("functional_currency"),
    )


def balanced_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger with a mirror line for every line of even orders."""
    sides = F.when(F.col("source_entry_id").cast("long") % 2 == 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    rows = ledger(spark, sf_dir).withColumn("is_mirror", F.explode(sides))
    swapped = lambda own, other: F.when(F.col("is_mirror"), F.col(other)).otherwise(F.col(own))
    number = F.col("source_row_no") + F.when(F.col("is_mirror"), 500).otherwise(0)
    return rows.withColumns({"transaction_debit": swapped("transaction_debit", "transaction_credit"), "transaction_credit": swapped("transaction_credit", "transaction_debit"), "source_row_no": number}).drop("is_mirror")


def members(lines: DataFrame) -> DataFrame:
    """A frozen population of all lines."""
    return lines.select("dataset_id", "source_row_no")


def trial_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as rows of their nation's trial balance."""
    return table(spark, sf_dir, "customer").select(F.lit("tb1").alias("dataset_id"), F.col("c_nationkey").cast("string").alias("trial_balance_id"), F.col("c_mktsegment").alias("account"), _money("c_acctbal").cast("decimal(24,6)").alias("closing_debit"), F.col("c_custkey").alias("source_row_no"))


def record_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders with even keys to be reconciled with those with odd keys."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderkey").cast("string").alias("reference"), _money("o_totalprice").alias("amount"), F.col("o_custkey").cast("string").alias("counterparty"), _instant("o_orderdate").alias("value_date"))
    return rows.where("idx % 2 = 0"), rows.where("idx % 2 = 1")


def runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs, preparations and jobs made of orders."""
    orders = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "QUEUED").when(F.col("o_orderstatus") == "P", "PREPARING").otherwise("RUNNING")
    all_runs = orders.select((F.col("o_custkey") % 10).alias("firm_id"), F.col("o_orderkey").alias("run_id"), status.alias("status"), _instant("o_orderdate").alias("updated_at"))
    preparations = orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderkey") % 3 == 0, "COMPLETE").otherwise("PREPARING").alias("status"))
    attempts = orders.select(F.col("o_orderkey").alias("run_id"), F.explode(F.sequence(F.lit(1), (1 + F.col("o_orderkey") % 3).cast("int"))).alias("attempt_no"), _instant("o_orderdate").alias("lease_expires_at"))
    return all_runs, preparations, attempts.withColumn("status", F.when((F.col("run_id") + F.col("attempt_no")) % 2 == 0, "RUNNING").otherwise("FAILED"))


# The same views as SQL, to be put before a check's own query.

TX_E = """tx AS (SELECT event_id AS row_no, CAST(event_id AS VARCHAR) AS id, event_type AS ref, CAST(floor(value * 100 + 0.5) AS BIGINT) AS minor,
  CAST(user_id AS VARCHAR) AS party, epoch_us(ts) AS at_us, ts + INTERVAL 3 HOUR AS local FROM events)"""
TX_O = """tx AS (SELECT o_orderkey AS row_no, CAST(o_orderkey AS VARCHAR) AS id, CAST(o_orderkey AS VARCHAR) AS ref, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS minor,
  CAST(o_custkey AS VARCHAR) AS party, lower(o_orderpriority) AS account, epoch_us(o_orderdate) AS at_us, epoch_us(shipped) AS value_at, o_orderdate + INTERVAL 3 HOUR AS local
  FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS shipped FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"""
TX_L = """tx AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS minor,
  CAST(floor(l_extendedprice * l_tax * 100 + 0.5) AS BIGINT) AS vat FROM lineitem)"""
GL = """gl AS (SELECT 'ds1' AS dataset_id, l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS source_row_no,
  CAST(l_orderkey AS VARCHAR) AS source_entry_id, CAST(l_partkey AS VARCHAR) AS account, CAST(l_shipdate AS DATE) AS entry_date, l_linestatus AS currency,
  CASE WHEN l_returnflag <> 'R' THEN CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) END AS debit, CASE WHEN l_returnflag = 'R' THEN CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) END AS credit FROM lineitem)"""

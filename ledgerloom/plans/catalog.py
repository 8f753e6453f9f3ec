"""The engine's operators as queries over the tables at hand, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import framing, money
from ledgerloom.functions.text import key
from ledgerloom.functions.timeparts import parse_date_strict
from ledgerloom.operators import accounting, analyzers, executors, ingest, lifecycle, reconcile, rules, runs, workflow
from ledgerloom.plans import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Callable], Callable]:
    """Registers a query under its function's name, with its SQL."""

    def put(build: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name or build.__name__] = build
        if sql:
            ORACLE_SQL[name or build.__name__] = sql
        return build

    return put


# Analyzers

_DIGITS = f"""WITH {views.TX_O}, n AS (SELECT CAST(left(CAST(abs(minor) AS VARCHAR), 1) AS INTEGER) AS digit, count(*) AS observed FROM tx WHERE minor <> 0 GROUP BY 1),
d AS (SELECT CAST(g.i AS INTEGER) AS digit, coalesce(observed, 0) AS observed, log10(1 + 1.0::DOUBLE / g.i) AS share, sum(coalesce(observed, 0)) OVER () AS total FROM range(1, 10) AS g(i) LEFT JOIN n ON n.digit = g.i)"""


@query(f"{_DIGITS} SELECT digit, CAST(observed AS BIGINT) AS observed, round(observed / total, 6) AS proportion, round(share, 6) AS expected_share FROM d")
def benford_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = analyzers.benford_digits(views.order_transactions(spark, sf_dir))
    return digits.select("digit", "observed", F.round("proportion", 6).alias("proportion"), F.round(F.log10(1 + 1 / F.col("digit")), 6).alias("expected_share"))


@query(f"""{_DIGITS}, s AS (SELECT CAST(sum(observed) AS BIGINT) AS sample_size, sum((observed - share * total) ** 2 / (share * total)) AS chi FROM d)
SELECT sample_size, round(chi, 2) AS chi_square, chi > 15.507 AS rejects, CASE WHEN chi / 15.507 >= 3 THEN 'CRITICAL' WHEN chi / 15.507 >= 2 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
CAST(least(100, floor(40 + 20 * chi / 15.507 + 0.5)) AS INTEGER) AS score FROM s""")
def benford_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyzers.benford_summary(views.order_transactions(spark, sf_dir)).withColumn("chi_square", F.round("chi_square", 2))


@query(f"WITH {views.TX_E} SELECT minor, party, ref, count(*) AS n, min(row_no) AS first_row FROM tx WHERE minor <> 0 GROUP BY 1, 2, 3 HAVING count(*) >= 2")
def dup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyzers.exact_duplicates(views.event_transactions(spark, sf_dir), with_ids=False).drop("ids")


@query(f"""WITH {views.TX_E} SELECT a.minor, a.party, a.row_no AS first_row, b.row_no AS second_row, CAST(floor((b.at_us - a.at_us) / 3600000000.0::DOUBLE + 0.5) AS INTEGER) AS hours_apart
FROM tx a JOIN tx b ON a.minor = b.minor AND a.party = b.party AND a.ref <> b.ref AND (b.at_us > a.at_us OR (b.at_us = a.at_us AND b.row_no > a.row_no)) AND b.at_us - a.at_us <= 72 * 3600000000 WHERE a.minor <> 0""")
def dup_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyzers.near_duplicates(views.event_transactions(spark, sf_dir)).select("minor", "party", "first_row", "second_row", "hours_apart")


@query(f"WITH {views.TX_E} SELECT id, CAST(hour(local) AS INTEGER) AS hour FROM tx WHERE dayofweek(local) NOT IN (5, 6) AND (hour(local) < 7 OR hour(local) >= 19)")
def off_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyzers.off_hours_postings(views.event_transactions(spark, sf_dir)).select("id", "hour")


@query(f"WITH {views.TX_E} SELECT id, CAST(dayofweek(local) AS INTEGER) AS weekday FROM tx WHERE dayofweek(local) IN (5, 6)")
def weekend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyzers.weekend_postings(views.event_transactions(spark, sf_dir)).select("id", "weekday")


_VAT = f"""WITH {views.TX_L}, e AS (SELECT *, (abs(minor * 400) + 5000) // 10000 AS expected FROM tx WHERE minor <> 0), d AS (SELECT *, vat - expected AS delta FROM e WHERE abs(vat - expected) > 1)"""


@query(f"""{_VAT} SELECT id, minor, vat, expected, delta, CASE WHEN abs(delta) / greatest(expected, 1) >= 0.5 THEN 'CRITICAL' WHEN abs(delta) / greatest(expected, 1) >= 0.1 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
CAST(least(100, floor(60 + 60 * (abs(delta) / greatest(expected, 1)) + 0.5)) AS INTEGER) AS score FROM d""")
def vat_discrepancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = analyzers.vat_discrepancies(views.line_transactions(spark, sf_dir), rate=0.04)
    return wrong.select("id", money.minor_units(F.col("amount")).alias("minor"), money.minor_units(F.col("vat_amount")).alias("vat"), "expected", "delta", "severity", "score")


_ENGINE = f"""WITH {views.TX_E}, digits AS (SELECT CAST(left(CAST(abs(minor) AS VARCHAR), 1) AS INTEGER) AS digit, count(*) AS observed FROM tx WHERE minor <> 0 GROUP BY 1),
chi AS (SELECT sum((coalesce(observed, 0) - share * total) ** 2 / (share * total)) AS chi FROM (SELECT observed, log10(1 + 1.0::DOUBLE / g.i) AS share, (SELECT sum(observed) FROM digits) AS total FROM range(1, 10) AS g(i) LEFT JOIN digits ON digit = g.i)),
found AS (
  SELECT 'BENFORD' AS code, CASE WHEN chi / 15.507 >= 3 THEN 'CRITICAL' WHEN chi / 15.507 >= 2 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, CAST(least(100, floor(40 + 20 * chi / 15.507 + 0.5)) AS INTEGER) AS score, '' AS first_id, 0 AS n_ids FROM chi WHERE chi > 15.507 AND (SELECT count(*) FROM tx) >= 50
  UNION ALL SELECT 'DUPLICATE', 'HIGH', 85, CAST(min(row_no) AS VARCHAR), count(*) FROM tx WHERE minor <> 0 GROUP BY minor, party, ref HAVING count(*) >= 2
  UNION ALL SELECT 'NEAR_DUPLICATE', 'MEDIUM', 65, a.id, 2 FROM tx a JOIN tx b ON a.minor = b.minor AND a.party = b.party AND a.ref <> b.ref AND (b.at_us > a.at_us OR (b.at_us = a.at_us AND b.row_no > a.row_no)) AND b.at_us - a.at_us <= 72 * 3600000000 WHERE a.minor <> 0
  UNION ALL SELECT 'WEEKEND', 'LOW', 45, id, 1 FROM tx WHERE dayofweek(local) IN (5, 6)
  UNION ALL SELECT 'OFF_HOURS', 'MEDIUM', 55, id, 1 FROM tx WHERE dayofweek(local) NOT IN (5, 6) AND (hour(local) < 7 OR hour(local) >= 19))"""


@query(f"{_ENGINE} SELECT code, severity, score, first_id, CAST(n_ids AS INTEGER) AS n_ids FROM found")
def audit_engine_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = analyzers.audit_engine(views.event_transactions(spark, sf_dir), with_ids=False)
    return ranked.select("code", "severity", "score", F.coalesce(F.get("ids", F.lit(0)), F.lit("")).alias("first_id"), "n_ids")


# Rules


def _row_rule(name: str, view: Callable[[SparkSession, str], DataFrame], sql_view: str, definition: dict, where: str) -> None:
    rule = rules.Rule(name, "MEDIUM", definition)
    query(f"WITH {sql_view} SELECT id, minor FROM tx WHERE {where}", f"rule_{name}")(lambda spark, sf_dir: rules.matching(view(spark, sf_dir), rule).select("id", money.minor_units(F.col("amount")).alias("minor")))


_O, _E, _L = (views.order_transactions, views.TX_O), (views.event_transactions, views.TX_E), (views.line_transactions, views.TX_L)
_row_rule("field_compare_amount", *_O, {"type": "field_compare", "field": "amount", "op": "between", "value": 100000, "value2": 200000}, "minor BETWEEN 10000000 AND 20000000")
_row_rule("field_compare_vat_amount", *_L, {"type": "field_compare", "field": "vatAmount", "op": "gt", "value": 5000}, "vat > 500000")
_row_rule("field_compare_vat_ratio", *_L, {"type": "field_compare", "field": "vatRatioPct", "op": "lt", "value": 3.5}, "minor <> 0 AND vat::DOUBLE / minor::DOUBLE * 100 < 3.5")
_row_rule("field_compare_hour", *_E, {"type": "field_compare", "field": "hour", "op": "gte", "value": 22}, "hour(local) >= 22")
_row_rule("field_compare_weekday", *_E, {"type": "field_compare", "field": "weekday", "op": "eq", "value": 0}, "dayofweek(local) = 0")
_row_rule("field_compare_value_days", *_O, {"type": "field_compare", "field": "valueVsPostedDays", "op": "lt", "value": 0}, "floor((at_us - value_at) / 86400000000.0::DOUBLE + 0.5) < 0")
_row_rule("round_amount", *_O, {"type": "round_amount", "minTrailingZeros": 0}, "minor <> 0 AND minor % 100 = 0")
_row_rule("threshold_avoidance", *_O, {"type": "threshold_avoidance", "limit": 10000, "marginPct": 5}, "minor >= 950000 AND minor < 1000000")
_row_rule("value_list_deny", *_O, {"type": "value_list", "field": "account", "mode": "deny", "values": ["1-Urgent", " 2-high "]}, "account IN ('1-urgent', '2-high')")
_row_rule("value_list_allow", *_O, {"type": "value_list", "field": "account", "mode": "allow", "values": ["1-URGENT", "2-HIGH", "3-MEDIUM"]}, "coalesce(account, '') NOT IN ('1-urgent', '2-high', '3-medium')")
_row_rule("missing_field", *_O, {"type": "missing_field", "field": "document"}, "value_at IS NULL")
_row_rule("missing_value_date", *_O, {"type": "missing_field", "field": "valueDate"}, "value_at IS NULL")
_row_rule("time_window_off_hours", *_E, {"type": "time_window", "mode": "off_hours"}, "hour(local) < 7 OR hour(local) >= 19")
_row_rule("time_window_weekend", *_E, {"type": "time_window", "mode": "weekend"}, "dayofweek(local) IN (5, 6)")


@query(f"WITH {views.TX_E} SELECT minor, party, count(*) AS n, CAST(sum(minor) AS BIGINT) AS total, min(row_no) AS first_row FROM tx GROUP BY 1, 2 HAVING count(*) >= 2")
def rule_aggregate_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = next(r for r in rules.LIBRARY if r.code == "DUP-PAYMENTS")
    groups = rules.grouped(views.event_transactions(spark, sf_dir), rule, with_ids=False)
    return groups.select(F.col("key_amount").alias("minor"), F.col("key_counterparty").alias("party"), "n", "total", "first_row")


@query(f"""WITH {views.TX_O}, w AS (SELECT *, at_us - min(at_us) OVER (PARTITION BY party) AS since FROM tx)
SELECT party, count(*) AS n, CAST(sum(minor) AS BIGINT) AS total, min(row_no) AS first_row FROM w WHERE since <= 86400000000 GROUP BY 1 HAVING sum(minor) >= 5000000""")
def rule_aggregate_sum_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = next(r for r in rules.LIBRARY if r.code == "SPLIT-PAY")
    groups = rules.grouped(views.order_transactions(spark, sf_dir), rule, with_ids=False)
    return groups.select(F.col("key_counterparty").alias("party"), "n", "total", "first_row")


@query(f"""WITH {views.TX_O}, f AS (
  SELECT 'LARGE-ITEMS' AS rule, 80 AS score, count(*) AS n FROM tx WHERE minor >= 10000000
  UNION ALL SELECT 'THRESHOLD-AVOID', 80, count(*) FROM tx WHERE minor >= 950000 AND minor < 1000000
  UNION ALL SELECT 'ROUND-AMOUNTS', 60, count(*) FROM tx WHERE minor <> 0 AND minor % 100000 = 0
  UNION ALL SELECT 'OFF-HOURS', 60, count(*) FROM tx WHERE hour(local) < 7 OR hour(local) >= 19
  UNION ALL SELECT 'WEEKEND', 40, count(*) FROM tx WHERE dayofweek(local) IN (5, 6)
  UNION ALL SELECT 'FUTURE-DATE', 80, count(*) FROM tx WHERE floor((at_us - value_at) / 86400000000.0::DOUBLE + 0.5) < 0
  UNION ALL SELECT 'BACKDATED', 60, count(*) FROM tx WHERE floor((at_us - value_at) / 86400000000.0::DOUBLE + 0.5) > 30
  UNION ALL SELECT 'MISSING-DOC', 60, count(*) FROM tx WHERE value_at IS NULL
  UNION ALL SELECT 'DUP-PAYMENTS', 80, count(*) FROM (SELECT 1 FROM tx GROUP BY minor, party HAVING count(*) >= 2)
  UNION ALL SELECT 'SPLIT-PAY', 80, count(*) FROM (SELECT 1 FROM (SELECT *, at_us - min(at_us) OVER (PARTITION BY party) AS since FROM tx) WHERE since <= 86400000000 GROUP BY party HAVING sum(minor) >= 5000000))
SELECT rule, score, n FROM f WHERE n > 0""")
def rule_library_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.stored(rules.evaluate(views.order_transactions(spark, sf_dir), list(rules.LIBRARY), with_ids=False))
    return found.groupBy("rule", "score").agg(F.count("*").alias("n"))


# Reconciliation

_RECON = reconcile.Settings(window_days=60, tolerance=10_000)
_CANDIDATES = """WITH r AS (SELECT o_orderkey AS idx, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS minor, o_custkey AS party, epoch_us(o_orderdate) AS at_us FROM orders),
p AS (SELECT a.idx AS source_idx, b.idx AS target_idx, abs(a.minor - b.minor) AS delta, abs(a.at_us - b.at_us) / 86400000000.0::DOUBLE AS days, a.party = b.party AS same FROM r a JOIN r b ON a.idx % 2 = 0 AND b.idx % 2 = 1 AND abs(a.minor - b.minor) <= 10000 AND abs(a.at_us - b.at_us) <= 60 * 86400000000),
c AS (SELECT *, least(1.0::DOUBLE, 0.6::DOUBLE * (CASE WHEN delta = 0 THEN 1.0::DOUBLE ELSE 1 - delta / 10000.0::DOUBLE * 0.4::DOUBLE END) + 0.3::DOUBLE * (1 - days / 60.0::DOUBLE * 0.4::DOUBLE) + CASE WHEN same THEN 0.05::DOUBLE ELSE 0 END) AS confidence FROM p)"""


@query(f"{_CANDIDATES} SELECT source_idx, target_idx, delta, round(confidence, 6) AS confidence FROM c WHERE confidence >= 0.5")
def recon_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = reconcile.candidates(*views.record_sides(spark, sf_dir), _RECON)
    return pairs.select("source_idx", "target_idx", "delta", F.round("confidence", 6).alias("confidence"))


#: The greedy choice in SQL: a fold over the pairs from best to worst that keeps what isn't taken yet.
_GREEDY = f"""{_CANDIDATES}, o AS (SELECT list({{'s': [source_idx], 't': [target_idx], 'd': [CAST(delta AS BIGINT)], 'c': [confidence]}} ORDER BY confidence DESC, source_idx, target_idx) AS pairs FROM c WHERE confidence >= 0.5),
g AS (SELECT list_reduce(pairs, lambda a, x: CASE WHEN list_has_any(a.s, x.s) OR list_has_any(a.t, x.t) THEN a ELSE {{'s': list_concat(a.s, x.s), 't': list_concat(a.t, x.t), 'd': list_concat(a.d, x.d), 'c': list_concat(a.c, x.c)}} END) AS m FROM o WHERE pairs IS NOT NULL),
m AS (SELECT unnest(m.s) AS source_idx, unnest(m.t) AS target_idx, unnest(m.d) AS delta, unnest(m.c) AS confidence FROM g), u AS (SELECT idx FROM r WHERE idx % 2 = 0 AND idx NOT IN (SELECT source_idx FROM m))"""


@query(f"""{_GREEDY} SELECT CAST(source_idx AS VARCHAR) AS source_id, CAST(target_idx AS VARCHAR) AS target_id, CASE WHEN delta = 0 THEN 'MATCHED' ELSE 'PARTIAL' END AS status, round(confidence, 4) AS confidence, delta FROM m
UNION ALL SELECT CAST(idx AS VARCHAR), NULL, 'UNMATCHED', 0.0::DOUBLE, 0 FROM u""")
def recon_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.reconcile(*views.record_sides(spark, sf_dir), _RECON)


@query(f"{_GREEDY} SELECT 'UNRECONCILED' AS code, 'MEDIUM' AS severity, 60 AS score, CAST(idx AS VARCHAR) AS id FROM u")
def recon_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = views.record_sides(spark, sf_dir)
    matches = reconcile.matched(source, target, _RECON)
    found = reconcile.unreconciled_findings(reconcile.unmatched(source, matches, "source"))
    return found.select("code", "severity", "score", F.col("ids")[0].alias("id"))


@query(f"""{_GREEDY} SELECT count(*) FILTER (WHERE delta = 0) AS matched, count(*) FILTER (WHERE delta <> 0) AS partial, (SELECT count(*) FROM r WHERE idx % 2 = 0) - count(*) AS unmatched_source, (SELECT count(*) FROM r WHERE idx % 2 = 1) - count(*) AS unmatched_target FROM m""")
def recon_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = views.record_sides(spark, sf_dir)
    return reconcile.summary(reconcile.matched(source, target, _RECON), source, target)


# Import

_WRITTEN = """CASE o_orderkey % 6 WHEN 0 THEN ' 1,' || CAST(o_orderkey AS VARCHAR) || '.50 ' WHEN 1 THEN 'SAR 00' || CAST(o_orderkey AS VARCHAR) WHEN 2 THEN '-' || CAST(o_orderkey AS VARCHAR) || '.0000005'
  WHEN 3 THEN '1.2.' || CAST(o_orderkey AS VARCHAR) WHEN 4 THEN '٢٥' || CAST(o_orderkey AS VARCHAR) ELSE '—' END"""


@query("""SELECT id, CASE k WHEN 0 THEN '1' || s || '.50' WHEN 1 THEN coalesce(nullif(ltrim(s, '0'), ''), '0') WHEN 2 THEN '-' || s || '.0000005' WHEN 4 THEN '25' || s END AS canonical
FROM (SELECT o_orderkey AS id, CAST(o_orderkey AS VARCHAR) AS s, o_orderkey % 6 AS k FROM orders)""")
def parse_decimal_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr(_WRITTEN.replace("VARCHAR", "STRING")).alias("written"))
    return rows.select("id", money.canonical_decimal(F.col("written")).alias("canonical"))


_DATES = """CASE o_orderkey % 4 WHEN 0 THEN concat(y, '-', m, '/', d) WHEN 1 THEN concat(d, '.', m, '.', y) WHEN 2 THEN concat('31/', m, '/', y) ELSE concat(d, ' ', m, ' ', y) END"""


@query("""WITH p AS (SELECT o_orderkey AS id, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d FROM orders)
SELECT id, CAST(CASE id % 4 WHEN 0 THEN make_date(y, m, d) WHEN 1 THEN make_date(y, m, d) WHEN 2 THEN CASE WHEN m IN (1, 3, 5, 7, 8, 10, 12) THEN make_date(y, m, 31) END END AS VARCHAR) AS parsed FROM p""")
def parse_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("timestamp")
    rows = views.table(spark, sf_dir, "orders").select("o_orderkey", *(f(day).cast("string").alias(c) for f, c in ((F.year, "y"), (F.month, "m"), (F.dayofmonth, "d"))))
    return rows.select(F.col("o_orderkey").alias("id"), parse_date_strict(F.expr(_DATES)).cast("string").alias("parsed"))


QUERIES["parse_date_strict"], ORACLE_SQL["parse_date_strict"] = QUERIES.pop("parse_date"), ORACLE_SQL.pop("parse_date")

#: Headers of the import made of order lines, one of them twice.
_HEADERS = ["Account", "Posting Date", "Debit", "Credit", "Debit", "Currency"]


def _imported(spark: SparkSession, sf_dir: str, headers: list[str | None] = _HEADERS) -> DataFrame:
    """Order lines as positional cells: some without an account, with an impossible date, or without an amount."""
    rows = views.ledger(spark, sf_dir)
    entry = F.col("source_entry_id").cast("long")
    date = F.when(entry % 7 == 0, F.lit("31/31/2024")).otherwise(F.date_format("entry_date", "dd/MM/yyyy"))
    written = lambda c: F.coalesce(F.when(entry % 11 == 0, F.lit("")).otherwise(F.col(c).cast("decimal(15,2)").cast("string")), F.lit(""))
    values = F.array(F.when(entry % 13 == 0, F.lit(" ")).otherwise(F.col("account")), date, written("transaction_debit"), written("transaction_credit"), F.lit("9"), F.col("transaction_currency"))
    return rows.select("source_row_no", ingest.raw_cells(headers, values).alias("cells"))


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.prepare_rows(_imported(spark, sf_dir), "GENERAL_LEDGER", ingest.suggest_mapping("GENERAL_LEDGER", _HEADERS), headers=_HEADERS)


_ROWS = f"""WITH {views.GL}, i AS (SELECT source_row_no, CAST(source_entry_id AS BIGINT) % 13 = 0 AS no_account, CAST(source_entry_id AS BIGINT) % 7 = 0 AS bad_date, CAST(source_entry_id AS BIGINT) % 11 = 0 AS no_amount FROM gl)"""


@query(f"{_ROWS} SELECT source_row_no, CASE WHEN no_account OR bad_date OR no_amount THEN 'REJECTED' ELSE 'ACCEPTED_WITH_WARNING' END AS status, CAST(no_account::INT + bad_date::INT + no_amount::INT AS INTEGER) AS n_issues FROM i")
def import_validate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prepared(spark, sf_dir).select("source_row_no", "status", F.size("issues").alias("n_issues"))


@query(f"""{_ROWS} SELECT code, n FROM (SELECT 'INVALID_DATE' AS code, count(*) FILTER (WHERE bad_date) AS n FROM i UNION ALL SELECT 'MISSING_REQUIRED', count(*) FILTER (WHERE no_account) FROM i
UNION ALL SELECT 'MISSING_VALUE_GROUP', count(*) FILTER (WHERE no_amount) FROM i UNION ALL SELECT 'DUPLICATE_SOURCE_COLUMN', count(*) FROM i) WHERE n > 0""")
def import_issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.issue_rows(_prepared(spark, sf_dir)).groupBy("code").agg(F.count("*").alias("n"))


@query(f"{_ROWS} SELECT count(*) AS total, count(*) FILTER (WHERE NOT (no_account OR bad_date OR no_amount)) AS accepted, count(*) FILTER (WHERE no_account OR bad_date OR no_amount) AS rejected, CAST(sum(no_account::INT + bad_date::INT + no_amount::INT) AS BIGINT) AS blocking FROM i")
def import_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.counts(_prepared(spark, sf_dir))


@query("SELECT * FROM (VALUES ('Account', 'accountCode'), ('Posting Date', 'postingDate'), ('Debit', 'debit'), ('Credit', 'credit'), ('Currency', 'currency')) AS t(header, field)")
def header_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(ingest.suggest_mapping("GENERAL_LEDGER", _HEADERS).items()), "header string, field string")


@query(f"""WITH {views.GL} SELECT source_row_no, CASE WHEN debit IS NOT NULL THEN 'DEBIT' ELSE 'CREDIT' END AS type, coalesce(debit, credit) AS minor, currency FROM gl
WHERE CAST(source_entry_id AS BIGINT) % 13 <> 0 AND CAST(source_entry_id AS BIGINT) % 7 <> 0 AND CAST(source_entry_id AS BIGINT) % 11 <> 0""")
def import_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = _HEADERS[:4] + [None] + _HEADERS[5:]
    prepared = ingest.prepare_rows(_imported(spark, sf_dir, headers), "GENERAL_LEDGER", ingest.suggest_mapping("GENERAL_LEDGER", headers), headers=headers)
    return ingest.to_transactions(prepared, "GENERAL_LEDGER").select("source_row_no", "type", money.minor_units(F.col("amount")).alias("minor"), "currency")


# Hashes

_FRAME = "CASE WHEN {x} IS NULL THEN unhex('00') ELSE unhex('01') || unhex(lpad(printf('%x', strlen({x})), 2, '0')) || encode({x}) END"


def _frame(x: str) -> str:
    return _FRAME.format(x=x)


_TWO_CELLS = "unhex('02') || " + " || ".join(_frame(x) for x in ("'0'", "'key'", "CAST(o_orderkey AS VARCHAR)", "'1'", "'status'", "nullif(o_orderstatus, 'P')"))


def _two_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.array(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).otherwise(""))
    return views.table(spark, sf_dir, "orders").select(F.lit("ds1").alias("dataset_id"), F.col("o_orderkey").alias("source_row_no"), framing.raw_hash(ingest.raw_cells(["key", "status"], values)).alias("raw_hash"), F.lit("ACCEPTED").alias("status"))


@query(f"SELECT o_orderkey AS source_row_no, sha256({_TWO_CELLS}) AS raw_hash FROM orders")
def raw_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two_cells(spark, sf_dir).select("source_row_no", "raw_hash")


@query(f"""WITH h AS (SELECT o_orderkey AS source_row_no, sha256({_TWO_CELLS}) AS raw_hash FROM orders)
SELECT source_row_no, sha256({_frame("'g4eoi.1'")} || unhex('0203') || {_frame("'abc'")} || {_frame("CAST(source_row_no AS VARCHAR)")} || {_frame("raw_hash")}) AS eoi FROM h""")
def eoi(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashes = spark.createDataFrame([("ds1", "abc")], "dataset_id string, dataset_hash string")
    return runs.population(_two_cells(spark, sf_dir), hashes).select("source_row_no", "eoi")


_LEB = "CASE WHEN {n} < 128 THEN unhex(printf('%02x', {n})) WHEN {n} < 16384 THEN unhex(printf('%02x%02x', {n} % 128 + 128, {n} // 128)) ELSE unhex(printf('%02x%02x%02x', {n} % 128 + 128, {n} // 128 % 128 + 128, {n} // 16384)) END"
_HEADER = {"sourceFileSha256": None, "effectiveProfileHash": "p", "mappingHash": "m", "datasetKind": "OTHER", "normalizerVersion": "g2.1"}
_HEADER_SQL = "unhex('05') || " + " || ".join(_frame(repr(k)) + " || " + ("unhex('00')" if v is None else _frame(repr(v))) for k, v in sorted(_HEADER.items()))


@query(f"""WITH h AS (SELECT o_orderkey AS source_row_no, sha256({_TWO_CELLS}) AS raw_hash FROM orders), g AS (SELECT count(*) AS n, string_agg(raw_hash, '' ORDER BY source_row_no) AS body FROM h)
SELECT 'ds1' AS dataset_id, sha256({_HEADER_SQL} || {_LEB.format(n='n')} || unhex(body)) AS dataset_hash, n AS n_rows FROM g""")
def dataset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.dataset_hash(_two_cells(spark, sf_dir), _HEADER, ("dataset_id",))


_EOI = f"""h AS (SELECT o_orderkey AS source_row_no, sha256({_TWO_CELLS}) AS raw_hash FROM orders),
eois AS (SELECT source_row_no, sha256({_frame("'g4eoi.1'")} || unhex('0203') || {_frame("'abc'")} || {_frame("CAST(source_row_no AS VARCHAR)")} || {_frame("raw_hash")}) AS eoi FROM h)"""


@query(f"""WITH {_EOI}, c AS (SELECT count(*) AS n, list_reduce(list_prepend(sha256('g4pop.seed'), list(eoi ORDER BY source_row_no)), lambda a, x: sha256(unhex(a) || unhex(x))) AS chain FROM eois)
SELECT 'ds1' AS dataset_id, n AS n_members, sha256({_frame("'g4pop.2'")} || unhex('0202') || {_frame("chain")} || {_frame("CAST(n AS VARCHAR)")}) AS fingerprint FROM c""")
def population_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashes = spark.createDataFrame([("ds1", "abc")], "dataset_id string, dataset_hash string")
    return runs.population_fingerprints(runs.population(_two_cells(spark, sf_dir), hashes))


# Canonical accounting


def _text(column: Column) -> Column:
    return column.cast("decimal(24,6)").cast("string")


@query(f"WITH {views.GL} SELECT account, min(source_row_no) AS first_row_no, 'Part ' || account AS account_name, count(*) AS occurrence_count FROM gl GROUP BY account")
def canonical_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounting.accounts(views.ledger(spark, sf_dir)).drop("dataset_id")


@query(f"WITH {views.GL} SELECT source_entry_id, count(*) AS n_lines, CAST(arg_min_null(entry_date, source_row_no) AS VARCHAR) AS entry_date FROM gl GROUP BY 1")
def canonical_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounting.entries(views.ledger(spark, sf_dir)).select("source_entry_id", "n_lines", F.col("entry_date").cast("string").alias("entry_date"))


@query(f"WITH {views.GL} SELECT source_row_no, CAST(row_number() OVER (PARTITION BY source_entry_id ORDER BY source_row_no) AS BIGINT) AS line_no FROM gl")
def canonical_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounting.numbered_lines(views.ledger(spark, sf_dir)).select("source_row_no", "line_no")


_ALL = """bal AS (SELECT source_entry_id, currency, debit, credit FROM gl UNION ALL SELECT source_entry_id, currency, credit, debit FROM gl WHERE CAST(source_entry_id AS BIGINT) % 2 = 0),
e AS (SELECT source_entry_id, count(DISTINCT currency) AS k, coalesce(sum(debit), 0) AS d, coalesce(sum(credit), 0) AS c FROM bal GROUP BY 1)"""


@query(f"""WITH {views.GL}, {_ALL} SELECT source_entry_id, CASE WHEN k = 1 THEN 'AVAILABLE' ELSE 'PARTIAL' END AS balance_capability, CASE WHEN k > 1 THEN 'NOT_EVALUABLE' WHEN d = c THEN 'BALANCED' ELSE 'UNBALANCED' END AS balance_status,
CASE WHEN k = 1 THEN CAST(d AS BIGINT) END AS debit, CASE WHEN k = 1 THEN CAST(c AS BIGINT) END AS credit FROM e""")
def je_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = accounting.entries(views.balanced_ledger(spark, sf_dir))
    return found.select("source_entry_id", "balance_capability", "balance_status", (F.col("debit_total") * 100).cast("long").alias("debit"), (F.col("credit_total") * 100).cast("long").alias("credit"))


@query("SELECT CAST(c_nationkey AS VARCHAR) AS trial_balance_id, c_mktsegment AS account, count(*) AS n, CAST(sum(CAST(floor(c_acctbal * 100 + 0.5) AS BIGINT)) AS BIGINT) AS total FROM customer GROUP BY 1, 2")
def canonical_tb(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = accounting.trial_balance_rows(views.trial_balance(spark, sf_dir))
    return rows.groupBy("trial_balance_id", "account").agg(F.count("*").alias("n"), (F.sum("closing_debit") * 100).cast("long").alias("total"))


_VERSIONS = "SELECT c_mktsegment AS account, CAST(c_custkey AS BIGINT) AS version, 'T' || CAST(c_nationkey AS VARCHAR) AS target FROM customer"


@query(f"SELECT account, max(version) AS version, arg_max(target, version) AS target FROM ({_VERSIONS}) GROUP BY 1")
def mapping_current_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = views.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("account"), F.col("c_custkey").alias("version"), F.concat(F.lit("T"), F.col("c_nationkey").cast("string")).alias("target"))
    return accounting.current_mappings(events)


# Frozen tests


@query(f"WITH {views.GL} SELECT source_row_no, 'DQ_POPULATION_MEMBER' AS result_code FROM gl")
def exe_population_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = views.ledger(spark, sf_dir).withColumn("content_hash", F.sha2(F.col("source_row_no").cast("string"), 256))
    return executors.population_member(lines).select("source_row_no", "result_code")


@query("SELECT o_orderkey AS source_row_no, 'HIGH' AS severity FROM orders WHERE o_orderkey % 100 = 0")
def exe_hash_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _two_cells(spark, sf_dir)
    frozen = records.withColumn("content_hash", F.when(F.col("source_row_no") % 100 == 0, F.lit("changed")).otherwise(F.col("raw_hash")))
    return executors.hash_mismatch(frozen, records).select("source_row_no", "severity")


@query(f"WITH {views.GL}, {_ALL} SELECT source_entry_id, CAST(d - c AS BIGINT) AS difference FROM e WHERE k = 1 AND d <> c")
def exe_unbalanced_je(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = views.balanced_ledger(spark, sf_dir)
    found = executors.unbalanced_entries(views.members(lines), lines)
    return found.select("source_entry_id", (F.col("difference").cast("decimal(24,6)") * 100).cast("long").alias("difference"))


_ODD = "CASE CAST(source_entry_id AS BIGINT) % 5 WHEN 0 THEN -coalesce(debit, credit) WHEN 1 THEN coalesce(debit, credit) ELSE debit END AS debit, CASE CAST(source_entry_id AS BIGINT) % 5 WHEN 0 THEN NULL WHEN 1 THEN -coalesce(debit, credit) ELSE credit END AS credit"


@query(f"""WITH {views.GL}, odd AS (SELECT source_row_no, {_ODD} FROM gl)
SELECT source_row_no, concat_ws(',', CASE WHEN debit < 0 THEN 'NEGATIVE_DEBIT' END, CASE WHEN credit < 0 THEN 'NEGATIVE_CREDIT' END, CASE WHEN coalesce(debit, 0) <> 0 AND coalesce(credit, 0) <> 0 THEN 'BOTH_SIDED' END) AS reasons
FROM odd WHERE debit < 0 OR credit < 0 OR (coalesce(debit, 0) <> 0 AND coalesce(credit, 0) <> 0)""")
def exe_invalid_debit_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, kind, amount = views.ledger(spark, sf_dir), F.col("source_entry_id").cast("long") % 5, F.coalesce("transaction_debit", "transaction_credit")
    debit = F.when(kind == 0, -amount).when(kind == 1, amount).otherwise(F.col("transaction_debit"))
    credit = F.when(kind == 0, None).when(kind == 1, -amount).otherwise(F.col("transaction_credit"))
    odd = lines.withColumns({"transaction_debit": debit, "transaction_credit": credit})
    return executors.invalid_sides(views.members(odd), odd).select("source_row_no", "reasons")


@query("SELECT CAST(c_nationkey AS VARCHAR) AS trial_balance_id, c_mktsegment AS account, count(*) AS n FROM customer GROUP BY 1, 2 HAVING count(*) > 1")
def exe_tb_duplication(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.trial_balance(spark, sf_dir)
    return executors.duplicated_accounts(views.members(rows), rows).select("trial_balance_id", "account", "n")


@query("""SELECT trial_balance_id, account, CAST(position AS INTEGER) AS position, source_row_no FROM (SELECT CAST(c_nationkey AS VARCHAR) AS trial_balance_id, c_mktsegment AS account, c_custkey AS source_row_no,
row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS position, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS n FROM customer) WHERE n > 1 AND position <= 3""")
def exe_tb_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.trial_balance(spark, sf_dir)
    return executors.duplicated_accounts_evidence(views.members(rows), rows).drop("dataset_id")


_ROUND = executors.RoundNumbers.parse({"roundingQuantum": "1", "minimumPopulation": 10, "minimumRoundCount": 2, "rateThresholdNum": 1, "rateThresholdDenom": 200})
_SCALARS = f"WITH {views.GL}, s AS (SELECT source_row_no, currency, coalesce(debit, credit) AS minor FROM gl WHERE coalesce(debit, credit) > 0)"


@query(f"{_SCALARS} SELECT currency, count(*) AS population, count(*) FILTER (WHERE minor % 100 = 0) AS n_round FROM s GROUP BY 1 HAVING count(*) >= 10 AND count(*) FILTER (WHERE minor % 100 = 0) >= 2 AND count(*) FILTER (WHERE minor % 100 = 0) * 200 >= count(*)")
def exe_round_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = views.ledger(spark, sf_dir)
    return executors.round_frequency(views.members(lines), lines, _ROUND).select(F.col("transaction_currency").alias("currency"), "population", "n_round")


@query(f"""{_SCALARS}, f AS (SELECT currency FROM s GROUP BY 1 HAVING count(*) >= 10 AND count(*) FILTER (WHERE minor % 100 = 0) >= 2 AND count(*) FILTER (WHERE minor % 100 = 0) * 200 >= count(*))
SELECT currency, CAST(position AS INTEGER) AS position, source_row_no FROM (SELECT currency, source_row_no, row_number() OVER (PARTITION BY currency ORDER BY source_row_no) AS position FROM s WHERE minor % 100 = 0 AND currency IN (SELECT currency FROM f)) WHERE position <= 3""")
def exe_round_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = views.ledger(spark, sf_dir)
    return executors.round_evidence(views.members(lines), lines, _ROUND).select(F.col("transaction_currency").alias("currency"), "position", "source_row_no")


@query(f"{_SCALARS} SELECT currency, minor, count(*) AS n FROM s GROUP BY 1, 2 HAVING count(*) >= 2")
def exe_dup_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = views.ledger(spark, sf_dir)
    return executors.duplicate_amounts(views.members(lines), lines).select(F.col("transaction_currency").alias("currency"), (F.col("scalar").cast("decimal(24,6)") * 100).cast("long").alias("minor"), "n")


@query(f"""{_SCALARS} SELECT currency, minor, CAST(position AS INTEGER) AS position, source_row_no FROM (SELECT *, row_number() OVER (PARTITION BY currency, minor ORDER BY source_row_no) AS position, count(*) OVER (PARTITION BY currency, minor) AS n FROM s) WHERE n >= 2 AND position <= 3""")
def exe_dup_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = views.ledger(spark, sf_dir)
    found = executors.duplicate_evidence(views.members(lines), lines)
    return found.select(F.col("transaction_currency").alias("currency"), (F.col("scalar").cast("decimal(24,6)") * 100).cast("long").alias("minor"), "position", "source_row_no")


# Runs and workflow


@query("""WITH r AS (SELECT o_custkey % 10 AS firm_id, o_orderkey AS run_id, o_orderstatus AS s, o_orderdate AS updated_at, 1 + o_orderkey % 3 AS last_attempt FROM orders),
w AS (SELECT firm_id, run_id, updated_at, 'PREPARATION' AS work_type FROM r WHERE s = 'P' AND run_id % 2 = 0 AND run_id % 3 <> 0
  UNION ALL SELECT firm_id, run_id, updated_at, 'EXECUTION' FROM r WHERE s = 'O' OR (s NOT IN ('O', 'P') AND (run_id + last_attempt) % 2 = 0 AND updated_at < TIMESTAMP '1996-01-01')),
c AS (SELECT *, row_number() OVER (PARTITION BY firm_id ORDER BY updated_at, run_id) AS turn FROM w)
SELECT firm_id, run_id, work_type FROM c WHERE turn <= 50 ORDER BY updated_at, run_id LIMIT 200""")
def work_locator(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = runs.work_queue(*views.runs(spark, sf_dir), F.lit("1996-01-01").cast("timestamp"))
    return queue.select("firm_id", "run_id", "work_type")


_STATUS = "['OPEN', 'IN_REVIEW', 'RESOLVED', 'DISMISSED']"
_ANOMALIES = "SELECT event_id AS anomaly_id, event_type AS title, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][CAST(event_id % 4 + 1 AS INTEGER)] AS severity, " + _STATUS + "[CAST(event_id % 5 % 4 + 1 AS INTEGER)] AS status, CAST(event_id % 7 * 10 AS INTEGER) AS score, ts AS detected_at FROM events"


def _anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), at.cast("int") + 1)
    empty = {c: F.lit(None).cast("string") for c in ("title_ar", "description_ar", "description", "counterparty", "reference")}
    rows = views.table(spark, sf_dir, "events").select(F.col("event_id").alias("anomaly_id"), F.col("event_type").alias("title"), pick(analyzers.SEVERITIES, F.col("event_id") % 4).alias("severity"), pick(("OPEN", "IN_REVIEW", "RESOLVED", "DISMISSED"), F.col("event_id") % 5 % 4).alias("status"), (F.col("event_id") % 7 * 10).cast("int").alias("score"), F.col("ts").cast("timestamp").alias("detected_at"))
    return rows.withColumns(empty | {"rule_code": F.lit("CUSTOM_RULE")})


@query(f"SELECT anomaly_id, severity, score FROM ({_ANOMALIES}) WHERE severity = 'HIGH' AND status = 'OPEN' ORDER BY score DESC, detected_at DESC, anomaly_id LIMIT 200")
def anomaly_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.feed(_anomalies(spark, sf_dir), workflow.FeedFilter(severity="HIGH", rule="ALL", status="OPEN")).select("anomaly_id", "severity", "score")


@query(f"SELECT anomaly_id, title FROM ({_ANOMALIES}) WHERE contains(lower(title), 'err') AND detected_at >= TIMESTAMP '2024-01-03' AND detected_at <= TIMESTAMP '2024-01-20'")
def anomaly_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.filtered(_anomalies(spark, sf_dir), workflow.FeedFilter(search="ERR", since="2024-01-03", until="2024-01-20")).select("anomaly_id", "title")


@query(f"SELECT count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, count(*) FILTER (WHERE severity = 'HIGH') AS high, count(*) FILTER (WHERE status IN ('OPEN', 'IN_REVIEW')) AS open, count(*) FILTER (WHERE status = 'RESOLVED') AS resolved FROM ({_ANOMALIES})")
def stat_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.stat_cards(_anomalies(spark, sf_dir))


@query("SELECT o_orderkey AS engagement_id FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200")
def engagement_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.newest(views.table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey").select(F.col("o_orderkey").alias("engagement_id"))


_ACTIONS = list(workflow.STATE_OF_ACTION)


def _dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.element_at(F.array(*map(F.lit, _ACTIONS)), (F.col("event_id") % len(_ACTIONS) + 1).cast("int"))
    return views.table(spark, sf_dir, "events").select(F.col("user_id").alias("result_id"), F.col("event_id").alias("event_seq"), action.alias("action"))


@query(f"SELECT result_id, event_seq, {list(workflow.STATE_OF_ACTION.values())}[CAST(event_seq % {len(_ACTIONS)} + 1 AS INTEGER)] AS state FROM (SELECT user_id AS result_id, max(event_id) AS event_seq FROM events GROUP BY 1)")
def disposition_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.dispositions(_dispositions(spark, sf_dir))


@query("""WITH e AS (SELECT user_id AS exception_id, event_type AS result_id, event_id AS seq, event_id % 3 <> 0 AS linked FROM events), a AS (SELECT exception_id, result_id FROM e GROUP BY 1, 2 HAVING arg_max(linked, seq)),
x AS (SELECT DISTINCT user_id AS exception_id FROM events) SELECT x.exception_id, count(a.result_id) AS n_links, any_value(coalesce(f.n, 0)) AS n_findings FROM x LEFT JOIN a USING (exception_id)
LEFT JOIN (SELECT o_custkey AS exception_id, count(*) AS n FROM orders GROUP BY 1) f USING (exception_id) GROUP BY 1""")
def exception_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("exception_id"), F.col("event_type").alias("result_id"), F.col("event_id").alias("event_seq"), F.when(F.col("event_id") % 3 != 0, "LINK").otherwise("UNLINK").alias("action"))
    findings = views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("exception_id"))
    return workflow.exception_counts(events.select("exception_id").distinct(), workflow.active_links(events), findings)


@query("""SELECT o_orderkey AS result_id, CASE o_orderkey % 3 WHEN 0 THEN o_orderkey WHEN 1 THEN o_orderkey + 7 ELSE o_custkey END AS traced_row FROM orders""")
def result_evidence_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, kind = views.table(spark, sf_dir, "orders"), F.col("o_orderkey") % 3
    pick = lambda k, c: F.when(kind == k, F.col(c)).cast("long")
    evidence = orders.select(F.col("o_orderkey").alias("result_id"), pick(0, "o_orderkey").alias("source_row_no"), pick(1, "o_orderkey").alias("line_id"), pick(2, "o_orderkey").alias("balance_id"))
    lines = orders.select(F.col("o_orderkey").alias("line_id"), (F.col("o_orderkey") + 7).alias("source_row_no"))
    balances = orders.select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("source_row_no"))
    records = orders.select(F.col("o_orderkey").alias("source_row_no"), F.lit("hash").alias("raw_hash"))
    return workflow.evidence_trace(evidence, lines, balances, records).select("result_id", "traced_row")


@query("SELECT CAST(c_nationkey AS VARCHAR) AS dataset_id, CASE WHEN count(*) FILTER (WHERE c_acctbal < 0) > 0 THEN 'ELIGIBLE' ELSE 'DEGRADED' END AS eligibility FROM customer GROUP BY 1")
def run_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    datasets = views.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("string").alias("dataset_id")).agg(F.lit("GENERAL_LEDGER").alias("kind"), F.count("*").alias("n_grouped"), F.count_if(F.col("c_acctbal") < 0).alias("n_mapped"))
    return runs.eligibility(datasets, "GENERAL_LEDGER", ("JE_GROUPING", "ACCOUNT_MAPPING"), ("ACCOUNT_MAPPING",)).select("dataset_id", "eligibility")


@query("SELECT lower(trim(c_mktsegment)) AS party, count(*) AS n FROM customer GROUP BY 1")
def key_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = views.table(spark, sf_dir, "customer").select(F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit("\t")).alias("name"))
    return padded.groupBy(key(F.col("name")).alias("party")).agg(F.count("*").alias("n"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 900000000 PRECEDING AND CURRENT ROW) AS attempts FROM events")
def login_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return workflow.attempts_in_window(log, "user_id", "ts").select("event_id", "attempts")


@query("SELECT o_orderkey AS document_id, CASE WHEN o_orderstatus <> 'P' THEN coalesce(n, 0) END AS n_transactions FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def document_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.when(F.col("o_orderstatus") != "P", "PARSED").otherwise("PENDING").alias("status"))
    lines = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"))
    return lifecycle.document_counts(documents, lines).select("document_id", "n_transactions")


@query("""WITH p AS (SELECT DISTINCT c_mktsegment AS name, CAST(c_nationkey AS VARCHAR) AS hash FROM customer), v AS (SELECT name, hash, row_number() OVER (PARTITION BY name ORDER BY hash) AS version_no FROM p WHERE hash < '2')
SELECT name, hash, (SELECT count(*) FROM v WHERE v.name = f.name) + row_number() OVER (PARTITION BY name ORDER BY hash) AS version_no FROM (SELECT * FROM p WHERE hash >= '2') f""")
def import_new_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    proposed = views.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name"), F.col("c_nationkey").cast("string").alias("hash"))
    turn = F.row_number().over(Window.partitionBy("name").orderBy("hash"))
    versions = proposed.where("hash < '2'").distinct().withColumn("version_no", turn.cast("long"))
    return lifecycle.new_versions(proposed, versions)


@query("SELECT o_custkey AS exception_id, coalesce(arg_max(CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END), 'OPEN') AS status, max(o_orderkey) AS event_seq FROM orders GROUP BY 1")
def exception_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    events = views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("exception_id"), F.col("o_orderkey").alias("event_seq"), F.when(status.isNull(), "LINK").otherwise("STATUS").alias("action"), status.alias("to_status"))
    return lifecycle.exception_states(events)


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_totalprice AS DECIMAL(15, 2))::VARCHAR AS shown, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS minor FROM orders")
def money_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.order_transactions(spark, sf_dir)
    shown = money.from_minor_units(money.minor_units(F.col("amount")))
    return rows.select("id", shown.alias("shown")).withColumn("minor", money.parse_minor_units(F.col("shown")))

"""Queries of imports, identities, preparation, matters and listings; registered beside those of `catalog`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import framing, money
from ledgerloom.functions.settings import firm_settings
from ledgerloom.operators import analyzers, imports, ingest, lifecycle, matters, preparation, rules, runs, workflow
from ledgerloom.plans import views
from ledgerloom.plans.catalog import _anomalies, _dispositions, _frame, query


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "orders")


def _text(name: str) -> Column:
    return F.col(name).cast("string")


# Import

_AMOUNTS = """CASE k WHEN 0 THEN s || '.005' WHEN 1 THEN '-' || s || '.995' WHEN 2 THEN repeat('9', 30) WHEN 3 THEN '1' || lpad(s, 17, '0') || '.5' WHEN 4 THEN ' SAR ' || s || ',000.1' WHEN 5 THEN '1٫5' || s WHEN 6 THEN '1.2.3' ELSE '-' || s || '.10' END"""


@query(f"""WITH a AS (SELECT o_orderkey AS source_row_no, CAST(o_orderkey AS VARCHAR) AS s, o_orderkey % 8 AS k FROM orders),
w AS (SELECT source_row_no, {_AMOUNTS} AS written, k FROM a), p AS (SELECT source_row_no, CASE WHEN k NOT IN (2, 6) THEN printf('%.2f', CAST(regexp_replace(written, '[^0-9.-]', '', 'g') AS DOUBLE)) END AS amount FROM w)
SELECT source_row_no, amount, CASE WHEN amount IS NULL THEN 'INVALID_AMOUNT' END AS code FROM p""")
def import_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts as the strict import parser rounds them: binary halves, very long numbers, marks and units."""
    rows = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("source_row_no"), _text("o_orderkey").alias("s"), (F.col("o_orderkey") % 8).alias("k"))
    written = rows.select("source_row_no", F.expr(_AMOUNTS).alias("written"))
    headers = ["transaction date", "amount"]
    cells = written.select("source_row_no", ingest.raw_cells(headers, F.array(F.lit("2024-01-31"), "written")).alias("cells"))
    prepared = ingest.prepare_rows(cells, "BANK", ingest.suggest_mapping("BANK", headers), headers=headers)
    return prepared.select("source_row_no", F.col("normalized.amount").alias("amount"), F.get(F.col("issues.code"), F.lit(0)).alias("code"))


_BATCHES = "SELECT o_orderkey AS batch_id, CASE WHEN o_orderkey % 5 = 0 THEN 'ds' END AS result_dataset_id, CASE WHEN o_orderkey % 7 <> 0 THEN 'key' END AS object_key FROM orders"
_ATTEMPTS = "SELECT l_orderkey AS batch_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS attempt_no, CASE WHEN l_orderkey % 3 = 0 THEN 'RUNNING' ELSE 'FAILED' END AS status FROM lineitem"


def _attempts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    batches = _orders(spark, sf_dir).selectExpr("o_orderkey AS batch_id", "CASE WHEN o_orderkey % 5 = 0 THEN 'ds' END AS result_dataset_id", "CASE WHEN o_orderkey % 7 <> 0 THEN 'key' END AS object_key")
    views.table(spark, sf_dir, "lineitem").createOrReplaceTempView("ledgerloom_attempts")
    return batches, spark.sql(_ATTEMPTS.replace("FROM lineitem", "FROM ledgerloom_attempts").replace("VARCHAR", "STRING"))


@query(f"""WITH b AS ({_BATCHES}), a AS (SELECT batch_id, max(attempt_no) AS latest, arg_max(status, attempt_no) AS status FROM ({_ATTEMPTS}) GROUP BY 1)
SELECT b.batch_id, CASE WHEN result_dataset_id IS NOT NULL THEN 'DEDUPED_EXISTING' WHEN object_key IS NULL THEN 'STORAGE_FAILED' ELSE 'READY' END AS outcome,
CASE WHEN result_dataset_id IS NULL AND object_key IS NOT NULL THEN coalesce(latest, 0) + 1 END AS attempt_no, CASE WHEN result_dataset_id IS NULL AND status = 'RUNNING' THEN latest END AS interrupted FROM b LEFT JOIN a USING (batch_id)""")
def import_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports.retries(*_attempts(spark, sf_dir))


@query(f"""WITH b AS ({_BATCHES}), a AS ({_ATTEMPTS}), l AS (SELECT batch_id, max(attempt_no) AS latest FROM a GROUP BY 1), t AS (
SELECT CASE WHEN a.attempt_no = latest AND status = 'RUNNING' AND result_dataset_id IS NULL THEN 'FAILED' ELSE status END AS status FROM a JOIN l USING (batch_id) LEFT JOIN b USING (batch_id)
UNION ALL SELECT 'RUNNING' FROM b WHERE result_dataset_id IS NULL AND object_key IS NOT NULL) SELECT status, count(*) AS n FROM t GROUP BY 1""")
def import_attempts_after_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches, attempts = _attempts(spark, sf_dir)
    return imports.after_retry(attempts, imports.retries(batches, attempts)).groupBy("status").agg(F.count("*").alias("n"))


#: Proposed imports of orders: a key and bytes each, drawn from the order's number.
_PROPOSED = """SELECT o_custkey % 25 AS firm_id, o_orderkey AS arrival, CASE WHEN o_orderkey % 50 > 0 THEN CONCAT('k', CAST(floor(h / 4096) AS BIGINT) % 400) END AS idempotency_key, CONCAT('s', CAST(floor(h / 64) AS BIGINT) % 500) AS sha256,
CAST(floor(h / 64) AS BIGINT) % 500 AS size, CAST(floor(h / 1024) AS BIGINT) % 3 = 0 AS acknowledged FROM (SELECT *, (o_orderkey * 2654435761) % 4294967296 AS h FROM orders)"""


@query(f"""WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY firm_id ORDER BY arrival) AS turn FROM ({_PROPOSED})),
f AS (SELECT DISTINCT firm_id, 0::BIGINT AS arrival, 0::BIGINT AS turn, NULL::VARCHAR AS outcome, MAP {{'k0': 'b0'}}::MAP(VARCHAR, VARCHAR) AS known, MAP {{'s1': 'f1'}}::MAP(VARCHAR, VARCHAR) AS held, NULL::VARCHAR AS existing_batch_id, NULL::VARCHAR AS duplicate_of FROM p
UNION ALL SELECT firm_id, arrival, turn, outcome, CASE WHEN outcome = 'READY' AND key IS NOT NULL THEN map_concat(known, MAP {{key: CAST(arrival AS VARCHAR)}}) ELSE known END,
CASE WHEN outcome = 'READY' AND held[bytes] IS NULL THEN map_concat(held, MAP {{bytes: CAST(arrival AS VARCHAR)}}) ELSE held END, CASE WHEN outcome = 'DEDUPED_EXISTING' THEN known[key] END, CASE WHEN outcome = 'DUPLICATE_BLOCKED' THEN held[bytes] END
FROM (SELECT f.firm_id, p.arrival, p.turn, known, held, p.idempotency_key AS key, p.sha256 AS bytes, CASE WHEN known[p.idempotency_key] IS NOT NULL THEN 'DEDUPED_EXISTING' WHEN held[p.sha256] IS NOT NULL AND NOT p.acknowledged THEN 'DUPLICATE_BLOCKED' WHEN p.size % 10 = 7 OR p.size % 10 = 8 THEN 'STORAGE_FAILED' ELSE 'READY' END AS outcome FROM f JOIN p ON p.firm_id = f.firm_id AND p.turn = f.turn + 1))
SELECT firm_id, arrival, outcome, existing_batch_id, duplicate_of FROM f WHERE turn > 0""")
def imports_started(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed imports judged in order: keys used before, bytes known before, bytes that the store lacks or holds in part."""
    rows = _orders(spark, sf_dir)
    proposed = spark.sql(_PROPOSED.replace("FROM orders", "FROM {orders}"), orders=rows)
    firms = proposed.select("firm_id").distinct()
    batches = firms.select("firm_id", F.lit("k0").alias("idempotency_key"), F.lit("b0").alias("batch_id"))
    files = firms.select("firm_id", F.lit("s1").alias("sha256"), F.lit("f1").alias("source_file_id"))
    stored = proposed.where("size % 10 <> 7").select("firm_id", "sha256", (F.col("size") - F.when(F.col("size") % 10 == 8, 1).otherwise(0)).alias("length")).distinct()
    return imports.started(proposed, batches, files, stored)


_CONFIRM_HEADERS = ["account", "posting date", "debit", "credit", "currency", "Entry"]


@query(f"""WITH {views.GL}, k AS (SELECT *, CAST(source_entry_id AS BIGINT) % 11 = 0 AS bad FROM gl), g AS (SELECT source_entry_id, count(DISTINCT currency) AS c, coalesce(sum(debit), 0) AS d, coalesce(sum(credit), 0) AS e FROM k WHERE NOT bad GROUP BY 1)
SELECT 'transactions' AS part, count(*) AS n FROM k WHERE NOT bad UNION ALL SELECT 'lines', count(*) FROM k WHERE NOT bad UNION ALL SELECT 'entries', count(*) FROM g UNION ALL SELECT 'accounts', count(DISTINCT account) FROM k WHERE NOT bad
UNION ALL SELECT 'contexts', CASE WHEN count(*) > 0 THEN 1 ELSE 0 END FROM k WHERE NOT bad UNION ALL SELECT 'issues', count(*) FROM k WHERE bad UNION ALL SELECT 'records', count(*) FROM k UNION ALL SELECT 'dataset', 1""")
def import_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every table that confirming an import of order lines makes; lines of some orders have no amount."""
    rows, bad = views.ledger(spark, sf_dir), F.col("source_entry_id").cast("long") % 11 == 0
    written = lambda c: F.when(bad, F.lit("")).otherwise(F.coalesce(F.col(c).cast("string"), F.lit("")))
    values = F.array("account", F.date_format("entry_date", "yyyy-MM-dd"), written("transaction_debit"), written("transaction_credit"), "transaction_currency", "source_entry_id")
    cells = rows.select("source_row_no", ingest.raw_cells(_CONFIRM_HEADERS, values).alias("cells"))
    prepared = ingest.prepare_rows(cells, "GENERAL_LEDGER", ingest.suggest_mapping("GENERAL_LEDGER", _CONFIRM_HEADERS), headers=_CONFIRM_HEADERS)
    header = {"sourceFileSha256": None, "effectiveProfileHash": "p", "mappingHash": "m", "datasetKind": "GENERAL_LEDGER", "normalizerVersion": imports.NORMALIZER}
    tables = imports.confirmed(prepared, "GENERAL_LEDGER", "ds1", header, {"sourceEntryId": "Entry"})
    counted = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name, df in tables.items()]
    out = counted[0]
    for other in counted[1:]:
        out = out.unionByName(other)
    return out


@query("SELECT o_orderkey AS id, CAST(round(CAST(o_orderkey AS DECIMAL(30, 7)) + 0.0000005::DECIMAL(30, 7), 6) AS VARCHAR) AS micros FROM orders")
def money_micros(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("id"), F.concat(_text("o_orderkey"), F.lit(".0000005")).alias("written"))
    return rows.select("id", money.micros(F.col("written")).cast("string").alias("micros"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 7 WHEN o_orderkey % 4 = 1 OR (o_orderkey % 4 = 2 AND o_custkey = 0) THEN o_custkey END AS debit, CASE WHEN o_orderkey % 4 = 2 AND o_custkey > 0 THEN o_custkey END AS credit FROM orders""")
def transaction_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A given debit wins over the signed amount, which the convention splits; a missing amount has no side."""
    kind, exact = F.col("o_orderkey") % 4, lambda c: c.cast("decimal(24,6)")
    debit = exact(F.when(kind == 0, F.lit(7)))
    amount = exact(F.when(kind < 2, F.col("o_custkey")).when(kind == 2, -F.col("o_custkey")))
    sides = money.transaction_sides(debit, exact(F.lit(None)), amount, "POSITIVE_DEBIT_NEGATIVE_CREDIT")
    return _orders(spark, sf_dir).select(F.col("o_orderkey").alias("id"), *(s.cast("long").alias(n) for s, n in zip(sides, ("debit", "credit"))))


# Identities


def _fields(**frames: str) -> str:
    return f"unhex('03{len(frames):02x}') || " + " || ".join(f"{_frame(repr(k))} || {frames[k]}" for k in sorted(frames))


def _tagged(tag: str, body: str) -> str:
    return f"sha256({_frame(repr(tag))} || {body})"


_KEY = "CAST(o_orderkey AS VARCHAR)"
_ACCOUNT = _tagged("g4da.1", _fields(datasetHash=_frame("'abc'"), sourceSystem=_frame("'sap'"), sourceEntity="unhex('00')", sourceLedger=_frame("''"), sourceAccountCode=_frame(_KEY)))
_TARGET = _tagged("g4acct.1", _fields(scopeKey=_frame("'scope'"), accountCode=_frame(_KEY)))
_IDENTITIES = {
    "account": _ACCOUNT,
    "target": _TARGET,
    "mapping": _tagged("g4map.1", _fields(datasetAccount=_frame(_ACCOUNT), mappingVersion=_frame("'2'"), basis=_frame("'EXACT'"), targetAccount=_frame(_TARGET))),
    "entry": _tagged("g4je.1", _fields(datasetHash=_frame("'abc'"), sourceEntryId=_frame(_KEY))),
    "scope": _tagged("g4scope.1", _fields(firmLicenseNo=_frame("'L1'"), clientSemanticKey=_frame(_KEY), fiscalYear=_frame("'2024'"))),
    "population": _tagged("g4statpop.1", _fields(datasetHash=_frame("'abc'"), currency=_frame("o_orderstatus"), amountBasis=_frame("'TRANSACTION'"), methodVersion=_frame("'st.round.1'"), eligiblePopulationFingerprint=_frame(_KEY))),
    "amounts": _tagged("g4statgrp.1", _fields(datasetHash=_frame("'abc'"), currency=_frame("o_orderstatus"), amountBasis=_frame("'TRANSACTION'"), methodVersion=_frame("'st.round.1'"), eligiblePopulationFingerprint=_frame(_KEY), scalarAmount=_frame("'50.000000'"))),
    "parameters": _tagged("g4param.1", _fields(least=_frame("'2'"), strict=_frame("'true'"))),
    "occurrence": _tagged("g4occ.2", _fields(runId=_frame("'run'"), auditRunTestVersionId=_frame("'tv'"), resultCode=_frame("'X'"), evidence=f"unhex('0202') || {_frame(_KEY)} || {_frame(repr('b'))}")),
    "matter": _tagged("g5mattercorr.1", _fields(engagementId=_frame("'e'"), semantic=_frame(_KEY))),
    "members": _tagged("g5members.1", f"unhex('0402') || {_frame(repr('a'))} || {_frame(repr('b'))}"),
}


@query("SELECT o_orderkey AS id, " + ", ".join(f"{sql} AS {name}" for name, sql in _IDENTITIES.items()) + " FROM orders")
def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content identities of accounts, mappings, entries, scopes, populations, results and matters."""
    own, lit = _text("o_orderkey"), F.lit
    account = framing.account_identity(lit("abc"), lit("sap"), lit(None).cast("string"), lit(""), own)
    population = (lit("abc"), F.col("o_orderstatus"), lit("TRANSACTION"), lit("st.round.1"), own)
    found = {
        "account": account,
        "target": framing.target_account_identity(lit("scope"), own),
        "mapping": framing.mapping_identity(account, lit(2), lit("EXACT"), lit("scope"), own),
        "entry": framing.journal_entry_identity(lit("abc"), own),
        "scope": framing.scope_anchor(lit("L1"), own, lit(2024)),
        "population": framing.stat_population_identity(*population),
        "amounts": framing.stat_population_identity(*population, lit("50.000000")),
        "parameters": framing.parameters_identity({"least": 2, "strict": True}),
        "occurrence": framing.occurrence_identity(lit("run"), lit("tv"), lit("X"), F.array(own, lit("b"))),
        "matter": framing.matter_key(lit("e"), own),
        "members": framing.membership_identity(F.array(lit("b"), lit("a"))),
    }
    return _orders(spark, sf_dir).select(F.col("o_orderkey").alias("id"), *(c.alias(n) for n, c in found.items()))


_FINDING = {k: _frame("'t'") for k in framing.FINDING_TEXTS} | {"condition": _frame(_KEY), "observedCurrency": _frame("'SAR'"), "estimatedExposureCurrency": "unhex('00')", "observedAmount": _frame("'12.500000'"), "estimatedExposureAmount": "unhex('00')"}


@query(f"SELECT o_orderkey AS id, {_tagged('g5finding.1', _fields(**_FINDING))} AS content_hash FROM orders")
def finding_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = {k: F.lit("t") for k in framing.FINDING_TEXTS} | {"condition": _text("o_orderkey"), "observedCurrency": F.lit("SAR"), "estimatedExposureCurrency": F.lit(None).cast("string"), "observedAmount": F.lit("12.5").cast("decimal(24,6)"), "estimatedExposureAmount": F.lit(None).cast("decimal(24,6)")}
    return _orders(spark, sf_dir).select(F.col("o_orderkey").alias("id"), framing.finding_identity(content).alias("content_hash"))


# Preparation


@query("""WITH v AS (SELECT o_orderkey AS k FROM orders) SELECT CAST(k AS VARCHAR) AS test_key, CASE WHEN k % 9 = 0 THEN 'test not found' WHEN k % 9 = 1 THEN 'no current version' WHEN k % 9 = 2 THEN 'version not usable' WHEN k % 9 = 3 THEN 'version has no hash'
WHEN k % 9 = 4 THEN 'malformed requirements' WHEN k % 9 = 5 THEN 'rule version missing' WHEN k % 9 = 6 THEN 'unexpected rule version' END AS problem, CASE WHEN k % 9 IN (0, 1) THEN '{}' WHEN k % 2 = 0 THEN '{"own":1}' ELSE '{"frozen":2}' END AS parameters FROM v""")
def pinned_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("k"))
    own = (F.col("k") % 2 == 0) & ~(F.col("k") % 9).isin(0, 1)
    selected = rows.select(_text("k").alias("test_key"), F.col("k").alias("order_index"), F.when(own, '{"own":1}').alias("parameters"))
    tests = rows.where("k % 9 <> 0").select(_text("k").alias("test_key"), F.when(F.col("k") % 9 != 1, F.col("k")).alias("current_version_id"))
    kind = F.col("k") % 9
    versions = rows.select(F.col("k").alias("version_id"), F.when(kind == 5, "RULE").otherwise("STATISTICAL").alias("test_type"), F.when(kind == 2, "DRAFT").otherwise("ACTIVE").alias("status"), F.when(kind != 3, "h").alias("version_hash"), F.when(kind == 4, "[").otherwise("{}").alias("requirements"), F.lit('{"kind":"X","params":{"frozen":2}}').alias("definition"), F.when(kind == 6, "r").alias("rule_version_id"))
    return preparation.pinned_tests(selected, tests, versions).select("test_key", "problem", "parameters")


@query("""SELECT o_orderkey AS dataset_id, CASE o_orderkey % 5 WHEN 0 THEN 'dataset not found' WHEN 1 THEN 'dataset of another engagement' WHEN 2 THEN 'dataset not consumable' WHEN 3 THEN 'dataset has no hash' END AS problem FROM orders""")
def pinned_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, kind = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("dataset_id"), F.lit(0).alias("order_index")), F.col("dataset_id") % 5
    datasets = rows.where("dataset_id % 5 <> 0").select("dataset_id", F.when(kind == 1, "other").otherwise("own").alias("engagement_id"), F.lit("BANK").alias("kind"), F.when(kind != 3, "h").alias("dataset_hash"), F.lit("SOURCE").alias("lineage_class"), F.when(kind == 2, "PENDING").otherwise("COMPLETED").alias("status"))
    return preparation.pinned_datasets(rows, datasets, "own").select("dataset_id", "problem")


@query(f"SELECT o_orderkey AS account_id, {_IDENTITIES['mapping']} AS mapping_hash FROM orders WHERE o_orderkey % 3 <> 0")
def mapping_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, own = _orders(spark, sf_dir), F.col("o_orderkey")
    accounts = rows.select(own.alias("account_id"), F.lit("abc").alias("dataset_hash"), F.lit("sap").alias("source_system"), F.lit(None).cast("string").alias("source_entity"), F.lit("").alias("source_ledger"), own.cast("string").alias("account_code"))
    mappings = rows.select(own.alias("account_id"), F.when(own % 3 != 0, own).alias("current_version_id"))
    versions = rows.select(own.alias("mapping_version_id"), F.lit(2).alias("version"), F.lit("EXACT").alias("basis"), own.alias("target_id"))
    targets = rows.select(own.alias("target_id"), F.lit("scope").alias("scope_key"), own.cast("string").alias("target_code"))
    return preparation.mapping_pins(accounts, mappings, versions, targets).select("account_id", "mapping_hash")


@query("SELECT 25 AS datasets, 2 AS \"testVersions\", (SELECT count(*) FROM customer) AS resolutions, (SELECT count(*) FROM orders) AS members, 0 AS \"mappingPins\"")
def preparation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = lambda name: views.table(spark, sf_dir, name)
    return preparation.expected_counts(table("nation"), table("region").limit(2), table("customer"), table("orders"), table("nation").limit(0))


@query("SELECT c_custkey AS resolution_id FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 4 = 0")
def preparation_unfinished(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.col("c_custkey")
    rows = views.table(spark, sf_dir, "customer").select(own.alias("resolution_id"), F.when(own % 3 == 0, "NOT_ELIGIBLE").otherwise("ELIGIBLE").alias("eligibility"), F.when(own % 4 != 0, "f").alias("fingerprint"))
    return preparation.unfinished(rows).select("resolution_id")


@query("SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'vat:' || c_nationkey WHEN 1 THEN 'cr:' || c_mktsegment ELSE 'g4ck:' || c_custkey END AS client_key FROM customer")
def client_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("c_custkey") % 3
    key = preparation.client_key(F.when(kind == 0, _text("c_nationkey")).otherwise(""), F.when(kind < 2, F.col("c_mktsegment")), _text("c_custkey"))
    return views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), key.alias("client_key"))


# Results


@query("SELECT DISTINCT user_id AS firm_id, event_type AS fingerprint FROM events WHERE event_type NOT LIKE '%err%'")
def results_inserted_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("firm_id"), F.lit("run").alias("run_id"), F.col("event_type").alias("occurrence_fingerprint"))
    stored = rows.where("occurrence_fingerprint LIKE '%err%'")
    return runs.new_results(rows, stored).select("firm_id", F.col("occurrence_fingerprint").alias("fingerprint"))


@query("SELECT l_orderkey AS source_row_no, count(*) AS n FROM lineitem GROUP BY 1")
def evidence_within_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = views.table(spark, sf_dir, "lineitem").select(F.lit("ds1").alias("dataset_id"), F.col("l_orderkey").alias("source_row_no"))
    members = _orders(spark, sf_dir).select(F.lit("ds1").alias("dataset_id"), F.col("o_orderkey").alias("source_row_no"))
    return runs.guarded_evidence(evidence, members).groupBy("source_row_no").agg(F.count("*").alias("n"))


_STATES = list(workflow.STATE_OF_ACTION.values())


@query(f"""WITH s AS (SELECT user_id AS result_id, {_STATES}[CAST(max(event_id) % {len(_STATES)} + 1 AS INTEGER)] AS state FROM events GROUP BY 1)
SELECT c_custkey AS result_id, coalesce(state, 'UNREVIEWED') AS state FROM customer LEFT JOIN s ON result_id = c_custkey""")
def results_with_disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("result_id"))
    return workflow.with_disposition(results, _dispositions(spark, sf_dir))


@query("SELECT event_type AS outcome, count(*) AS n FROM events GROUP BY 1")
def dispatch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.outcome_counts(views.table(spark, sf_dir, "events").select(F.col("event_type").alias("outcome")))


@query("""SELECT event_id AS anomaly_id, CAST(o_orderkey AS VARCHAR) AS reference, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS minor, c_mktsegment AS resolver_name, n_name AS rule_name
FROM events LEFT JOIN orders ON o_orderkey = event_id LEFT JOIN customer ON c_custkey = user_id LEFT JOIN nation ON n_nationkey = event_id % 30""")
def anomaly_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.col("event_id")
    anomalies = views.table(spark, sf_dir, "events").select(own.alias("anomaly_id"), own.cast("string").alias("transaction_id"), F.col("user_id").alias("resolver_id"), (own % 30).alias("rule_id"))
    transactions = views.order_transactions(spark, sf_dir).withColumnRenamed("id", "transaction_id")
    users = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("resolver_id"), F.col("c_mktsegment").alias("resolver_name"))
    names = views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("rule_id"), F.col("n_name").alias("rule_name"))
    found = workflow.anomaly_listing(anomalies, transactions, users, names)
    return found.select("anomaly_id", "reference", money.minor_units(F.col("amount")).alias("minor"), "resolver_name", "rule_name")


@query("SELECT o_orderkey AS engagement_id FROM orders ORDER BY year(o_orderdate) DESC, o_totalprice DESC, o_orderkey LIMIT 200")
def engagements_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("engagement_id"), F.year(F.col("o_orderdate").cast("timestamp")).alias("fiscal_year"), F.col("o_totalprice").alias("created_at"))
    return workflow.engagements(rows).select("engagement_id")


@query("SELECT CAST(user_id AS VARCHAR) AS attempts_of, count(*) AS n FROM events WHERE event_id % 4 = 3 GROUP BY 1 ORDER BY 1 LIMIT 50")
def anomalies_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Critical anomalies by user, listed by name."""
    users = views.table(spark, sf_dir, "events").select(F.col("event_id").alias("anomaly_id"), _text("user_id").alias("attempts_of"))
    critical = workflow.filtered(_anomalies(spark, sf_dir), workflow.FeedFilter.from_query({"severity": "CRITICAL", "rule": "ALL", "q": " "}))
    counted = critical.join(users, "anomaly_id").groupBy("attempts_of").agg(F.count("*").alias("n"))
    return workflow.listed(counted, {"attempts_of": True}, 50)


# Matters

_ACTION = "CASE WHEN o_orderstatus = 'O' THEN 'SUBMIT' WHEN o_orderstatus = 'P' THEN 'RETURN' ELSE 'APPROVE' END"


def _findings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as findings with two versions each, and their orders as review events."""
    own = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("finding_id"))
    versions = own.withColumn("version_no", F.explode(F.array(F.lit(1), F.lit(2)))).withColumns({"preparer_id": F.col("finding_id") % 4, "content_hash": F.concat(F.lit("h"), F.col("version_no")), "idempotency_key": F.concat(F.lit("k"), F.col("version_no"))})
    reviews = _orders(spark, sf_dir).select(F.col("o_custkey").alias("finding_id"), F.col("o_orderkey").alias("event_seq"), F.expr(_ACTION).alias("action"), (F.col("o_orderkey") % 4).alias("actor_id"), F.lit(2).alias("version_no"), (F.col("o_orderkey") % 5).cast("string").alias("idempotency_key"))
    return versions, reviews


_FINDINGS = f"""f AS (SELECT c_custkey AS finding_id, coalesce(CASE arg_max({_ACTION}, o_orderkey) WHEN 'SUBMIT' THEN 'IN_REVIEW' WHEN 'APPROVE' THEN 'CONCLUDED' WHEN 'RETURN' THEN 'DRAFT' END, 'DRAFT') AS status, coalesce(max(o_orderkey), 0) AS latest_review_seq
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)"""


@query(f"WITH {_FINDINGS} SELECT finding_id, status, 2 AS current_version, latest_review_seq FROM f")
def finding_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matters.finding_states(*_findings(spark, sf_dir))


@query(f"""WITH {_FINDINGS}, p AS (SELECT finding_id, finding_id % 3 AS k, status, latest_review_seq, CASE finding_id % 3 WHEN 0 THEN 'SUBMIT' ELSE 'APPROVE' END AS action, CASE WHEN finding_id % 3 = 2 THEN 1 ELSE 2 END AS version_no FROM f),
e AS (SELECT p.*, EXISTS (SELECT 1 FROM orders WHERE o_custkey = finding_id AND {_ACTION} = action AND o_orderkey % 4 = 1 AND o_orderkey % 5 = 2) AS known FROM p)
SELECT finding_id, CASE WHEN known AND (action = 'SUBMIT' OR version_no = 2) THEN 'REPEATED' WHEN known THEN 'CONFLICT' WHEN action = 'SUBMIT' AND status <> 'DRAFT' THEN 'NOT_DRAFT' WHEN action = 'SUBMIT' THEN 'ACCEPTED'
WHEN status <> 'IN_REVIEW' THEN 'NOT_IN_REVIEW' WHEN version_no <> 2 THEN 'NOT_CURRENT' WHEN finding_id % 4 = 1 THEN 'OWN_WORK' ELSE 'ACCEPTED' END AS outcome FROM e""")
def finding_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review of every finding by one actor under one key: some are there already, some may not be."""
    versions, reviews = _findings(spark, sf_dir)
    kind = F.col("finding_id") % 3
    proposed = versions.where("version_no = 1").select("finding_id", F.lit(1).cast("long").alias("actor_id"), F.when(kind == 0, "SUBMIT").otherwise("APPROVE").alias("action"), F.when(kind == 2, 1).otherwise(2).alias("version_no"), F.lit("2").alias("idempotency_key"))
    return matters.judged_reviews(proposed, versions, reviews).select("finding_id", "outcome")


@query(f"""WITH {_FINDINGS} SELECT finding_id, CASE finding_id % 4 WHEN 0 THEN 'REPEATED' WHEN 1 THEN 'CONFLICT' ELSE CASE WHEN status = 'DRAFT' THEN 'ACCEPTED' ELSE 'NOT_DRAFT' END END AS outcome,
CASE WHEN finding_id % 4 = 0 THEN 1 WHEN finding_id % 4 > 1 AND status = 'DRAFT' THEN 3 END AS version_no FROM f""")
def finding_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions, reviews = _findings(spark, sf_dir)
    kind = F.col("finding_id") % 4
    proposed = versions.where("version_no = 1").select("finding_id", F.when(kind < 2, "k1").otherwise("new").alias("idempotency_key"), F.when(kind == 0, "h1").otherwise("other").alias("content_hash"))
    return matters.judged_revisions(proposed, versions, reviews).select("finding_id", "outcome", "version_no")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS condition, CASE WHEN c_custkey % 3 = 1 THEN '5' END AS amount, CASE WHEN c_custkey % 3 = 1 THEN 'SAR' END AS currency FROM customer""")
def finding_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submitted texts: some lack a required one; amounts have no currency, currencies no amount."""
    kind, lit = F.col("c_custkey") % 3, F.lit
    required = [x for name in matters.REQUIRED if name not in ("condition", "effect") for x in (lit(name), lit(" t "))]
    raw = F.create_map(*required, lit("condition"), F.concat(lit(" "), F.col("c_mktsegment")), lit("effect"), F.when(kind == 0, " ").otherwise("e"), lit("observedAmount"), F.when(kind == 1, "5").otherwise(""), lit("observedCurrency"), F.when(kind == 2, "USD").otherwise(""))
    content = matters.finding_content(raw)
    return views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), content["condition"].alias("condition"), content["observedAmount"].alias("amount"), content["observedCurrency"].alias("currency"))


@query("SELECT c_custkey AS finding_id, CASE WHEN c_custkey % 5 <> 0 THEN 'text' || c_custkey END AS body FROM customer")
def finding_current_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.col("c_custkey")
    rows = views.table(spark, sf_dir, "customer")
    findings = rows.select(own.alias("finding_id"), F.when(own % 5 != 0, 1).alias("current_version"))
    versions = rows.select(own.alias("finding_id"), F.lit(1).alias("version_no"), F.concat(F.lit("text"), own.cast("string")).alias("body"))
    return workflow.current_versions(findings, versions).select("finding_id", "body")


# Texts and settings


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 1 THEN 5.5 ELSE 15.0 END::DOUBLE AS vat_rate_pct, CASE WHEN c_custkey % 3 = 1 THEN 8.0 ELSE 7.0 END::DOUBLE AS opens, CASE WHEN c_custkey % 3 = 1 THEN 1 ELSE 2 END AS n_weekend, CASE WHEN c_custkey % 3 = 1 THEN 'UTC' ELSE 'Asia/Riyadh' END AS zone FROM customer""")
def settings_with_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("c_custkey") % 3
    stored = F.when(kind == 1, '{"vatRatePct": 5.5, "businessStartHour": 8, "weekendDays": [0, "x"], "timeZone": "UTC"}').when(kind == 2, '{"vatRatePct": "9", "weekendDays": 3, "timeZone": ""}')
    own = firm_settings(stored)
    return views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), own["vat_rate_pct"].alias("vat_rate_pct"), own["opens"].alias("opens"), F.size(own["weekend"]).alias("n_weekend"), own["zone"].alias("zone"))


@query(f"""WITH {views.TX_L}, c AS (SELECT *, (minor * 400 + 5000) // 10000 AS expected FROM tx WHERE minor > 0), d AS (SELECT id, vat, expected, vat - expected AS delta FROM c WHERE abs(vat - expected) > 1),
t AS (SELECT id, printf('%d.%02d', vat // 100, vat % 100) AS v, printf('%d.%02d', expected // 100, expected % 100) AS e, CASE WHEN delta < 0 THEN '-' ELSE '' END || printf('%d.%02d', abs(delta) // 100, abs(delta) % 100) AS x FROM d)
SELECT id, 'VAT discrepancy' AS title, 'Declared VAT ' || v || ' does not match the expected 4% (' || e || ') for reference ' || id || '; delta ' || x || '.' AS description FROM t""")
def vat_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyzers.vat_texts(views.line_transactions(spark, sf_dir), 0.04).select("id", "title", "description")


@query(f"""WITH {views.TX_O} SELECT id, ref || ': المبلغ (' || printf('%d.%02d', minor // 100, minor % 100) || ') أكبر من أو يساوي 200000.' AS description_ar FROM tx WHERE minor >= 20000000""")
def rule_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = rules.Rule("LARGE", "HIGH", {"type": "field_compare", "field": "amount", "op": "gte", "value": 200000})
    return rules.described(views.order_transactions(spark, sf_dir), rule).select("id", "description_ar")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_custkey % 2 = 0")
def imports_known_already(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = views.table(spark, sf_dir, "customer").select(F.lit("f").alias("firm_id"), _text("c_custkey").alias("sha256"))
    return lifecycle.known_content(files, files.where(F.col("sha256").cast("long") % 2 == 0)).select(F.col("sha256").alias("id"))


@query("""SELECT o_custkey AS session_id, count(*) FILTER (WHERE o_orderstatus = 'F') AS matched, count(*) FILTER (WHERE o_orderstatus = 'P') AS partial, count(*) FILTER (WHERE o_orderstatus = 'O') AS unmatched, count(*) AS n FROM orders GROUP BY 1""")
def recon_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders(spark, sf_dir)
    status = F.when(F.col("o_orderstatus") == "F", "MATCHED").when(F.col("o_orderstatus") == "P", "PARTIAL").otherwise("UNMATCHED")
    matches = orders.select(F.col("o_custkey").alias("session_id"), _text("o_orderkey").alias("source_id"), _text("o_orderkey").alias("target_id"), status.alias("status"))
    found = lifecycle.sessions(matches.select("session_id").distinct(), matches, views.order_transactions(spark, sf_dir))
    return found.select("session_id", "matched", "partial", "unmatched", F.size("matches").cast("long").alias("n"))


@query("SELECT c_mktsegment AS dataset_id, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'LEGACY_UNVERIFIED/f/' || c_nationkey END AS c_mktsegment FROM customer) WHERE c_mktsegment <> 'BUILDING' GROUP BY 1")
def legacy_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions without a dataset get a container; one dataset is deleted, which no run uses."""
    rows = views.table(spark, sf_dir, "customer").select(F.lit("f").alias("firm_id"), _text("c_nationkey").alias("engagement_id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("dataset_id"))
    used = rows.limit(0).select("dataset_id")
    return runs.without_dataset(runs.legacy_containers(rows), used, "BUILDING").groupBy("dataset_id").agg(F.count("*").alias("n"))


@query("SELECT status, rule_code, count(*) AS n FROM (SELECT CASE WHEN event_id % 2 = 0 THEN 'OPEN' ELSE 'RESOLVED' END AS status, CASE WHEN event_id % 3 = 0 THEN 'CUSTOM_RULE' ELSE 'DUPLICATE' END AS rule_code FROM events UNION ALL SELECT 'OPEN', 'FRESH' FROM nation) WHERE NOT (status = 'OPEN' AND rule_code = 'CUSTOM_RULE') GROUP BY 1, 2")
def open_findings_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.col("event_id")
    existing = views.table(spark, sf_dir, "events").select(F.when(own % 2 == 0, "OPEN").otherwise("RESOLVED").alias("status"), F.when(own % 3 == 0, "CUSTOM_RULE").otherwise("DUPLICATE").alias("rule_code"))
    fresh = views.table(spark, sf_dir, "nation").select(F.lit("OPEN").alias("status"), F.lit("FRESH").alias("rule_code"))
    return rules.replace_open(existing, fresh).groupBy("status", "rule_code").agg(F.count("*").alias("n"))


@query("SELECT CASE event_id % 3 WHEN 0 THEN 'RESOLVED' WHEN 1 THEN 'DISMISSED' ELSE 'IN_REVIEW' END AS status, count(*) AS n FROM events GROUP BY 1")
def anomaly_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_id") % 3
    action = F.when(kind == 0, "RESOLVE").when(kind == 1, "DISMISS").otherwise("ESCALATE")
    return views.table(spark, sf_dir, "events").select(workflow.resolved(F.lit("OPEN"), action).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


# Identities of whole runs: a customer's orders are the datasets of a run, two tests each

_SEQ = "unhex('02' || printf('%02x', len({0}))) || list_reduce(list_prepend(''::BLOB, {0}), lambda a, x: a || x)"
_PARTS = f"""d AS (SELECT o_custkey AS run_id, 'h' || o_orderkey AS h, o_orderstatus AS k FROM orders WHERE o_orderkey % 100 < 60),
r AS (SELECT d.*, t.t, 'r' || lpad(CAST(CASE WHEN t = 'a' THEN 1 ELSE 0 END AS VARCHAR), 2, '0') || h AS id, CASE WHEN k = 'P' THEN 'NOT_ELIGIBLE' ELSE 'ELIGIBLE' END AS e, CASE WHEN k = 'P' OR h LIKE '%77' THEN NULL ELSE 'f' || h END AS f FROM d, (VALUES ('a'), ('b')) t(t))"""


def _run_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = _orders(spark, sf_dir).where(F.col("o_orderkey") % 100 < 60)
    datasets = orders.select(F.col("o_custkey").alias("run_id"), F.concat(F.lit("h"), _text("o_orderkey")).alias("datasetHash"), F.col("o_orderstatus").alias("datasetKind"))
    pairs = datasets.withColumn("testKey", F.explode(F.array(F.lit("a"), F.lit("b"))))
    refused = F.col("datasetKind") == "P"
    return datasets, pairs.withColumns({"eligibility": F.when(refused, "NOT_ELIGIBLE").otherwise("ELIGIBLE"), "print": F.when(~refused & ~F.endswith("datasetHash", F.lit("77")), F.concat(F.lit("f"), "datasetHash"))})


@query(f"""WITH {_PARTS}, p AS (SELECT run_id, list({_frame("f")} ORDER BY id) AS prints, count(*) FILTER (WHERE e = 'ELIGIBLE' AND f IS NULL) AS n_left FROM r GROUP BY 1),
c AS (SELECT c_custkey AS run_id, CASE WHEN c_custkey % 9 > 0 THEN 'b' || c_nationkey END AS build, coalesce(prints, []::BLOB[]) AS prints, CAST(len(coalesce(prints, []::BLOB[])) AS VARCHAR) AS n, coalesce(n_left, 0) AS n_left FROM customer LEFT JOIN p ON run_id = c_custkey),
j AS (SELECT *, CASE WHEN build IS NULL THEN 'no build identity' WHEN n_left > 0 THEN n_left || ' resolutions without a fingerprint' END AS problem FROM c)
SELECT run_id, CAST(n AS INTEGER) AS n_fingerprints, problem, CASE WHEN problem IS NULL THEN {_tagged("g4manifest.1", _fields(expected=_fields(datasets=_frame("'1'"), testVersions=_frame("'2'"), resolutions=_frame("n"), members=_frame("'300'"), mappingPins=_frame("'0'")), engineBuildVersionCandidate=_frame("build"), popFingerprints=_SEQ.format("prints")))} END AS manifest_hash FROM j""")
def run_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest identities of a run of each customer; some have no build, some unfinished populations, some no dataset."""
    _, pairs = _run_parts(spark, sf_dir)
    order = F.when(F.col("testKey") == "a", "01").otherwise("00")
    resolutions = pairs.select("run_id", F.concat(F.lit("r"), order, "datasetHash").alias("resolution_id"), "eligibility", F.col("print").alias("fingerprint"))
    counted = resolutions.groupBy("run_id").agg(F.count("*").alias("resolutions"))
    customer = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), F.when(F.col("c_custkey") % 9 > 0, F.concat(F.lit("b"), _text("c_nationkey"))).alias("build"))
    counts = {"datasets": F.lit(1), "testVersions": F.lit(2), "members": F.lit(300), "mappingPins": F.lit(0), "resolutions": F.coalesce("resolutions", F.lit(0))}
    return preparation.manifests(customer.join(counted, "run_id", "left").withColumns(counts), resolutions)


@query(f"""WITH {_PARTS}, ds AS (SELECT run_id, list({_fields(datasetHash=_frame("h"), datasetKind=_frame("k"), lineageClass="unhex('00')")} ORDER BY h) AS ds FROM d GROUP BY 1),
rs AS (SELECT run_id, list({_fields(testKey=_frame("t"), datasetHash=_frame("h"), eligibility=_frame("e"), resolutionAlgorithmVersion=_frame("'1'"), eligiblePopulationFingerprint=f"CASE WHEN f IS NULL THEN unhex('00') ELSE {_frame('f')} END")} ORDER BY t, h) AS rs FROM r GROUP BY 1),
ms AS (SELECT run_id, list({_frame("k || h")} ORDER BY hex({_frame("k || h")})) AS ms FROM d GROUP BY 1),
ts AS (SELECT unnest(['a', 'b']) AS t), t AS (SELECT list({_fields(testKey=_frame("t"), version=_frame("'1'"), versionHash=_frame("'v' || t"), ruleKey="unhex('00')", ruleVersion="unhex('00')", ruleVersionHash="unhex('00')", effectiveParametersHash=_frame("'p'"))} ORDER BY t) AS ts FROM ts)
SELECT c_custkey AS run_id, {_tagged("g4cfg.3", _fields(semanticScopeAnchor=_frame("c_name"), datasetScope=_SEQ.format("coalesce(ds, []::BLOB[])"), testPins=_SEQ.format("ts"), scopeResolutions=_SEQ.format("coalesce(rs, []::BLOB[])"), consumedMappings=_SEQ.format("coalesce(ms, []::BLOB[])").replace("'02'", "'04'"), engineBuildVersion=_frame("'b'"), materialityVersionKey=_frame("c_mktsegment"), riskModelVersionKey="unhex('00')"))} AS config_hash
FROM customer LEFT JOIN ds ON ds.run_id = c_custkey LEFT JOIN rs ON rs.run_id = c_custkey LEFT JOIN ms ON ms.run_id = c_custkey, t""")
def run_configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configuration identities of a run of each customer, whose orders are its datasets."""
    datasets, pairs = _run_parts(spark, sf_dir)
    customer, none = views.table(spark, sf_dir, "customer"), F.lit(None).cast("string")
    runs_ = customer.select(F.col("c_custkey").alias("run_id"), F.col("c_name").alias("anchor"), F.lit("b").alias("build"), F.col("c_mktsegment").alias("materiality"), none.alias("risk_model"))
    tests = runs_.select("run_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("testKey")).withColumns({"version": F.lit(1), "versionHash": F.concat(F.lit("v"), "testKey"), "ruleKey": none, "ruleVersion": none, "ruleVersionHash": none, "effectiveParametersHash": F.lit("p")})
    resolutions = pairs.withColumns({"resolutionAlgorithmVersion": F.lit(1), "eligiblePopulationFingerprint": F.col("print")})
    return preparation.configurations(runs_, datasets.withColumn("lineageClass", none), tests, resolutions, datasets.select("run_id", F.concat("datasetKind", "datasetHash").alias("mapping_hash")))

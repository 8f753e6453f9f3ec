"""Queries of what is kept between calls: folds in steps, commits, events in order; registered beside those of `catalog`."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import events, executors, folds, preparation, reconcile, runs
from ledgerloom.plans import views
from ledgerloom.plans.catalog import _RECON, _TWO_CELLS, ORACLE_SQL, _frame, _two_cells, query
from ledgerloom.session import shared_folder
from ledgerloom.sources import commits, objects, storage


def _folder(spark: SparkSession, name: str) -> str:
    """A folder of this call in the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# Matching


@query(ORACLE_SQL["recon_matches"])
def recon_matches_in_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As recon_matches, in small blocks that list a few thousand pairs at a time."""
    return reconcile.reconcile(*views.record_sides(spark, sf_dir), _RECON, most_pairs=1_000)


# Folds

_EOIS = f"""h AS (SELECT 'ds' || o_custkey % 40 AS dataset_id, o_orderkey AS source_row_no, sha256({_TWO_CELLS}) AS raw_hash FROM orders),
eois AS (SELECT dataset_id, source_row_no, sha256({_frame("'g4eoi.1'")} || unhex('0203') || {_frame("dataset_id")} || {_frame("CAST(source_row_no AS VARCHAR)")} || {_frame("raw_hash")}) AS eoi FROM h)"""


@query(f"""WITH {_EOIS}, c AS (SELECT dataset_id, count(*) AS n, list_reduce(list_prepend(sha256('g4pop.seed'), list(eoi ORDER BY source_row_no)), lambda a, x: sha256(unhex(a) || unhex(x))) AS chain FROM eois GROUP BY 1)
SELECT dataset_id, n AS n_members, sha256({_frame("'g4pop.2'")} || unhex('0202') || {_frame("chain")} || {_frame("CAST(n AS VARCHAR)")}) AS fingerprint FROM c""")
def population_fold_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of forty datasets, folded in steps: stopped after one, then extended by the later orders, and gone on with."""
    rows = _two_cells(spark, sf_dir).join(views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source_row_no"), F.concat(F.lit("ds"), F.col("o_custkey") % 40).alias("own")), "source_row_no")
    rows = rows.drop("dataset_id").withColumnRenamed("own", "dataset_id")
    hashes = rows.select("dataset_id", F.col("dataset_id").alias("dataset_hash")).distinct()
    path = _folder(spark, "fold")
    runs.population(rows, hashes).write.parquet(f"{path}/members")
    members = spark.read.parquet(f"{path}/members")
    last = views.table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0] or 0
    step = last // 3 + 1
    folds.fold_population(members.where(F.col("source_row_no") <= last // 2), f"{path}/states", step, most_steps=1)
    return folds.fold_population(members, f"{path}/states", step)


# Commits


def _occurrences(spark: SparkSession, sf_dir: str, writer: str) -> tuple[DataFrame, DataFrame]:
    """Events as the evidence of results, of which there is one for each user and type of event."""
    own = [F.lit("firm").alias("firm_id"), F.col("user_id").alias("run_id"), F.col("event_type").alias("occurrence_fingerprint")]
    evidence = views.table(spark, sf_dir, "events").select(*own, F.col("event_id").alias("source_row_no"), F.lit(writer).alias("writer"))
    return evidence.select("firm_id", "run_id", "occurrence_fingerprint", "writer").distinct(), evidence


@query("""SELECT user_id AS run_id, event_type AS occurrence, CASE WHEN user_id % 3 = 0 THEN 'second' ELSE 'first' END AS writer, 1 AS n_results, count(*) AS n_evidence FROM events GROUP BY 1, 2""")
def results_of_two_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writers insert the same results at once; the second, which has a third of the runs, gets its commit in between."""
    path = _folder(spark, "results")
    results, evidence = _occurrences(spark, sf_dir, "second")
    third = F.col("run_id") % 3 == 0
    meanwhile = [lambda: commits.insert_results(results.where(third), evidence.where(third), path)]
    commits.insert_results(*_occurrences(spark, sf_dir, "first"), path, before_claim=lambda: meanwhile.pop()() if meanwhile else None)
    stored = commits.snapshot(spark, path)
    counted = lambda name, n: stored.table(name).groupBy("run_id", "occurrence_fingerprint", "writer").agg(F.count("*").alias(n))
    both = counted("results", "n_results").join(counted("evidence", "n_evidence"), ["run_id", "occurrence_fingerprint", "writer"], "full")
    return both.select("run_id", F.col("occurrence_fingerprint").alias("occurrence"), "writer", "n_results", "n_evidence")


# Events in order

#: A number drawn from an event's id, the same in both engines.
_DRAWN = "(event_id * 2654435761) % 4294967296"
_EXCEPTION_EVENTS = """SELECT user_id AS exception_id, event_id AS arrival, CASE CAST(floor(h / 65536) AS BIGINT) % 8 WHEN 0 THEN 'CREATE' WHEN 3 THEN 'UNLINK' WHEN 4 THEN 'STATUS' WHEN 5 THEN 'STATUS' WHEN 6 THEN 'REOPEN' ELSE 'LINK' END AS event_type,
CAST(floor(h / 1024) AS BIGINT) % 5 AS actor_id, user_id % 3 AS engagement_id, user_id % 3 * 10 + CAST(floor(h / 4096) AS BIGINT) % 6 AS result_id,
CASE CAST(floor(h / 65536) AS BIGINT) % 8 WHEN 6 THEN 'UNDER_INVESTIGATION' WHEN 4 THEN 'CLOSED_NO_FINDING' WHEN 5 THEN 'CONCLUDED_WITH_FINDING' END AS to_status,
CASE WHEN CAST(floor(h / 256) AS BIGINT) % 3 = 0 THEN ' ' WHEN CAST(floor(h / 256) AS BIGINT) % 3 = 1 THEN 'why' END AS note, 'title' AS title, CONCAT('k', CAST(floor(h / 16384) AS BIGINT) % 4) AS idempotency_key, event_id % 2 = 0 AS has_concluded_finding FROM d"""
_FINDING_EVENTS = """SELECT user_id AS finding_id, event_id AS arrival, CASE CAST(floor(h / 65536) AS BIGINT) % 8 WHEN 0 THEN 'CREATE' WHEN 1 THEN 'REVISE' WHEN 2 THEN 'REVISE' WHEN 3 THEN 'SUBMIT' WHEN 4 THEN 'SUBMIT' WHEN 5 THEN 'RETURN' ELSE 'APPROVE' END AS event_type,
CAST(floor(h / 1024) AS BIGINT) % 5 AS actor_id, user_id % 3 AS engagement_id, 1 + CAST(floor(h / 4096) AS BIGINT) % 3 AS version_no, CONCAT('c', CAST(floor(h / 256) AS BIGINT) % 2) AS content_hash, CONCAT('k', CAST(floor(h / 16384) AS BIGINT) % 4) AS idempotency_key, event_id % 2 = 0 AS has_active_link FROM d"""


def _drawn_events(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    drawn = views.table(spark, sf_dir, "events").selectExpr("event_id", "user_id", f"{_DRAWN} AS h")
    return spark.sql(sql.replace("FROM d", "FROM {d}"), d=drawn)


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users 0 to 3 belong to all three engagements that the events have, user 4 to none."""
    engagements = views.table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("engagement_id")).distinct()
    return engagements.withColumn("user_id", F.explode(F.sequence(F.lit(0), F.lit(3)).cast("array<long>")))


_FOLD = """WITH RECURSIVE d AS (SELECT event_id, user_id, {drawn} AS h FROM events), e AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY arrival) AS turn FROM ({events})),
g AS (SELECT *, actor_id < 4 AS actor_is_member, {guards} FROM e),
f AS (SELECT DISTINCT {key} AS own_key, 0::BIGINT AS arrival, 0::BIGINT AS turn, NULL::VARCHAR AS outcome, NULL::VARCHAR AS status, 0::BIGINT AS seq, []::BIGINT[] AS links, 0::BIGINT AS version, NULL::BIGINT AS preparer, MAP {{}}::MAP(VARCHAR, VARCHAR) AS accepted FROM g
UNION ALL SELECT own_key, arrival, turn, outcome, {after}, CASE WHEN ok THEN map_concat(accepted, MAP {{own: payload}}) ELSE accepted END
FROM (SELECT *, outcome = 'ACCEPTED' AS ok FROM (SELECT *, CASE {judge} ELSE 'ACCEPTED' END AS outcome FROM (SELECT own_key, g.arrival, g.turn, status, seq, links, version, preparer, accepted, event_type, actor_id, actor_is_member, {carried}, {own} AS own, {payload} AS payload
FROM f JOIN g ON g.{key} = own_key AND g.turn = f.turn + 1))))
SELECT own_key AS {key}, arrival, outcome, CASE WHEN outcome = 'ACCEPTED' THEN seq END AS event_seq, status, {shown} FROM f WHERE turn > 0"""

_KNOWN = "WHEN accepted[own] = payload THEN 'REPEATED' WHEN accepted[own] IS NOT NULL THEN 'CONFLICT'"


@query(
    _FOLD.format(
        drawn=_DRAWN, key="exception_id", events=_EXCEPTION_EVENTS, guards="CASE WHEN result_id % 10 < 4 THEN engagement_id WHEN result_id % 10 = 4 THEN (engagement_id + 1) % 3 END AS result_engagement",
        carried="engagement_id, result_id, to_status, note, has_concluded_finding, result_engagement",
        own="CASE WHEN event_type = 'CREATE' THEN 'CREATE ' || idempotency_key ELSE concat_ws(' ', event_type, actor_id, idempotency_key) END",
        payload="CASE WHEN event_type = 'CREATE' THEN concat_ws(' ', actor_id, result_id) WHEN event_type IN ('LINK', 'UNLINK') THEN CAST(result_id AS VARCHAR) WHEN to_status = 'CONCLUDED_WITH_FINDING' THEN to_status ELSE to_status || coalesce(note, '-') END",
        judge=f"""WHEN event_type = 'STATUS' AND to_status = 'CLOSED_NO_FINDING' AND trim(coalesce(note, '')) = '' THEN 'NO_RATIONALE' WHEN event_type <> 'CREATE' AND status IS NULL THEN 'NOT_FOUND' {_KNOWN}
WHEN event_type = 'CREATE' AND status IS NOT NULL THEN 'EXISTS' WHEN to_status = 'CONCLUDED_WITH_FINDING' AND NOT has_concluded_finding THEN 'NO_CONCLUDED_FINDING' WHEN event_type IN ('CREATE', 'LINK', 'UNLINK') AND result_engagement IS NULL THEN 'NO_RESULT'
WHEN event_type = 'CREATE' AND NOT actor_is_member THEN 'NOT_MEMBER' WHEN event_type IN ('CREATE', 'LINK', 'UNLINK') AND result_engagement <> engagement_id THEN 'OTHER_ENGAGEMENT' WHEN NOT actor_is_member THEN 'NOT_MEMBER'""",
        after="""CASE WHEN NOT ok THEN status WHEN event_type = 'CREATE' THEN 'UNDER_INVESTIGATION' ELSE coalesce(to_status, status) END, CASE WHEN ok THEN seq + CASE WHEN event_type = 'CREATE' THEN 2 ELSE 1 END ELSE seq END,
CASE WHEN ok AND event_type IN ('CREATE', 'LINK') THEN list_distinct(list_append(links, result_id)) WHEN ok AND event_type = 'UNLINK' THEN [x FOR x IN links IF x <> result_id] ELSE links END, version, preparer""",
        shown="len(links) AS n_links",
    )
)
def exception_events_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of exceptions judged in order: CREATE, LINK, UNLINK, STATUS and REOPEN, with repeats, conflicts and illegal ones."""
    proposed = _drawn_events(spark, sf_dir, _EXCEPTION_EVENTS)
    owner, place = F.floor(F.col("result_id") / 10), F.col("result_id") % 10
    results = proposed.select("result_id").distinct().where(place < 5).withColumn("engagement_id", F.when(place < 4, owner).otherwise((owner + 1) % 3))
    judged = events.judged_in_order(events.with_exception_guards(proposed, _members(spark, sf_dir), results), "exception_id", events.judge_exception)
    return judged.select("exception_id", "arrival", "outcome", "event_seq", "status", "n_links")


@query(
    _FOLD.format(
        drawn=_DRAWN, key="finding_id", events=_FINDING_EVENTS, guards="0 AS unused", carried="version_no, content_hash, has_active_link",
        own="CASE WHEN event_type IN ('CREATE', 'REVISE') THEN event_type || ' ' || idempotency_key ELSE concat_ws(' ', event_type, actor_id, idempotency_key) END",
        payload="CASE event_type WHEN 'CREATE' THEN concat_ws(' ', actor_id, content_hash) WHEN 'REVISE' THEN content_hash WHEN 'SUBMIT' THEN '' ELSE CAST(version_no AS VARCHAR) END",
        judge=f"""WHEN event_type <> 'CREATE' AND status IS NULL THEN 'NOT_FOUND' {_KNOWN} WHEN event_type = 'CREATE' AND status IS NOT NULL THEN 'EXISTS' WHEN event_type = 'CREATE' AND NOT has_active_link THEN 'NO_LINK'
WHEN event_type IN ('REVISE', 'SUBMIT') AND status <> 'DRAFT' THEN 'NOT_DRAFT' WHEN event_type IN ('APPROVE', 'RETURN') AND status <> 'IN_REVIEW' THEN 'NOT_IN_REVIEW' WHEN event_type IN ('APPROVE', 'RETURN') AND version_no <> version THEN 'NOT_CURRENT'
WHEN NOT actor_is_member THEN 'NOT_MEMBER' WHEN event_type IN ('APPROVE', 'RETURN') AND actor_id = preparer THEN 'OWN_WORK'""",
        after="""CASE WHEN NOT ok THEN status WHEN event_type = 'SUBMIT' THEN 'IN_REVIEW' WHEN event_type = 'APPROVE' THEN 'CONCLUDED' ELSE 'DRAFT' END, CASE WHEN ok AND event_type NOT IN ('CREATE', 'REVISE') THEN seq + 1 ELSE seq END, links,
CASE WHEN ok AND event_type IN ('CREATE', 'REVISE') THEN version + 1 ELSE version END, CASE WHEN ok AND event_type IN ('CREATE', 'REVISE') THEN actor_id ELSE preparer END""",
        shown="nullif(version, 0) AS version_no",
    )
)
def finding_events_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of findings judged in order: CREATE, REVISE, SUBMIT, RETURN and APPROVE."""
    proposed = events.with_actors(_drawn_events(spark, sf_dir, _FINDING_EVENTS), _members(spark, sf_dir))
    judged = events.judged_in_order(proposed, "finding_id", events.judge_finding)
    return judged.select("finding_id", "arrival", "outcome", "event_seq", "status", F.col("version_no_now").alias("version_no"))


# Populations

_SHARE = "o_custkey % 3 = 1 AND o_orderkey % 2 = 0 AND o_custkey % 5 < 4 AND o_custkey % 5 > 0 AND o_orderkey % 9 > 0"


@query(f"""SELECT 'member' AS kind, 'd' || o_custkey % 5 AS dataset_id, o_orderkey AS source_row_no, 'h' || o_orderkey AS content_hash, 'DQ_POPULATION_MEMBER' AS result_code FROM orders WHERE {_SHARE}
UNION ALL SELECT 'mismatch', 'd' || o_custkey % 5, o_orderkey, 'h' || o_orderkey, 'DQ_SOURCE_TO_CANONICAL_MISMATCH' FROM orders WHERE {_SHARE} AND o_orderkey % 8 = 0""")
def exe_population_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of the two data-quality tests over a population that four tables make: of three preparations and two tests one is asked for, some datasets are not eligible or not the run's, some members have no record."""
    orders, text = views.table(spark, sf_dir, "orders"), lambda c: F.col(c).cast("string")
    dataset, row = F.concat(F.lit("d"), (F.col("o_custkey") % 5).cast("string")), F.col("o_orderkey")
    hashed = F.concat(F.lit("h"), text("o_orderkey"))
    members = orders.select((F.col("o_custkey") % 3).alias("preparation_id"), (row % 2).alias("test_version_id"), dataset.alias("dataset_id"), row.alias("source_row_no"), hashed.alias("content_hash"), F.lit("eoi").alias("eoi"))
    known = members.select("preparation_id", "test_version_id", "dataset_id").distinct()
    resolutions = known.withColumn("eligibility", F.when(F.col("dataset_id") == "d4", "NOT_ELIGIBLE").otherwise("ELIGIBLE"))
    run_datasets = known.where("dataset_id <> 'd0'").select("preparation_id", "dataset_id", F.concat(F.lit("hash-"), "dataset_id").alias("dataset_hash")).distinct()
    records = orders.where(row % 9 > 0).select(F.concat(F.lit("r"), text("o_orderkey")).alias("record_id"), dataset.alias("dataset_id"), row.alias("source_row_no"), F.when(row % 8 == 0, "other").otherwise(hashed).alias("raw_hash"))
    population = executors.population(members, resolutions, run_datasets, records, 1, 0)
    columns = ["dataset_id", "source_row_no", "content_hash", "result_code"]
    found = executors.executor("DATA_QUALITY", "POPULATION_MEMBER")(population).select(F.lit("member").alias("kind"), *columns)
    return found.unionByName(executors.executor("DATA_QUALITY", "SOURCE_TO_CANONICAL_MISMATCH")(population, records).select(F.lit("mismatch").alias("kind"), *columns))


# Stored tables


@query("""WITH t AS (SELECT 'f' || o_custkey % 3 AS firm_id, 'ds' || o_orderkey % 5 AS scope, 'doc' || o_custkey % 20 AS document_id FROM orders)
SELECT 'transactions' AS part, firm_id, scope, count(*) AS n FROM t WHERE NOT (firm_id = 'f1' AND (scope = 'ds2' OR document_id = 'doc7')) GROUP BY ALL
UNION ALL SELECT 'findings', 'f' || c_custkey % 3, CASE WHEN kept THEN 'kept' ELSE 'rules-open' END, count(*) FROM (SELECT c_custkey, c_custkey % 2 = 0 AS kept FROM customer) WHERE kept OR c_custkey % 3 <> 1 GROUP BY ALL
UNION ALL SELECT 'findings', 'f1', 'rules-open', count(*) FROM supplier HAVING count(*) > 0""")
def stored_replace_and_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three firms' transactions and findings, stored; one firm deletes a dataset and a document, and replaces its open findings."""
    root, text = _folder(spark, "tables"), lambda name, c: F.concat(F.lit(name), c.cast("string"))
    firm = text("f", F.col("o_custkey") % 3)
    transactions = views.table(spark, sf_dir, "orders").select(firm.alias("firm_id"), text("ds", F.col("o_orderkey") % 5).alias("scope"), text("doc", F.col("o_custkey") % 20).alias("document_id"), F.col("o_orderkey").alias("id"))
    customer = views.table(spark, sf_dir, "customer")
    findings = customer.select(text("f", F.col("c_custkey") % 3).alias("firm_id"), F.lit("e1").alias("scope"), F.when(F.col("c_custkey") % 2 == 0, storage.OTHERS).otherwise(storage.OPEN_RULES).alias("origin"), F.col("c_custkey").alias("finding_id"), F.lit("OPEN").alias("status"))
    firms = {f: storage.Catalog(spark, root, f) for f in ("f0", "f1", "f2")}
    for name, own in firms.items():
        own.append("transactions", transactions.where(F.col("firm_id") == name))
        own.append("findings", findings.where(F.col("firm_id") == name))
    own = firms["f1"]
    own.delete_dataset("ds2", transactions.limit(0).select("firm_id", F.col("scope").alias("dataset_id")))
    own.delete_document("doc7")
    own.replace_open_findings("e1", views.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("finding_id"), F.lit("OPEN").alias("status")))
    parts = []
    for c in firms.values():
        parts.append(c.sql("SELECT 'transactions' AS part, firm_id, scope, count(*) AS n FROM transactions GROUP BY firm_id, scope"))
        parts.append(c.sql("SELECT 'findings' AS part, firm_id, origin AS scope, count(*) AS n FROM findings GROUP BY firm_id, origin"))
    return functools.reduce(DataFrame.unionByName, parts)


# Documents


def _draw_sql(seed: str, k: str) -> str:
    """The k-th draw in SQL, whose wide integers need no halves."""
    a = f"CAST((CAST({seed} AS HUGEINT) + ({k}) * 1831565813::BIGINT) % 4294967296 AS BIGINT)"
    wide = lambda x, y: f"CAST((CAST({x} AS HUGEINT) * CAST({y} AS HUGEINT)) % 4294967296 AS BIGINT)"
    t = f"list_transform([{a}], lambda a: {wide('xor(a, a >> 15)', '(a | 1)')})"
    u = f"list_transform({t}, lambda t: xor((t + {wide('xor(t, t >> 7)', '(t | 61)')}) % 4294967296, t))"
    return f"list_transform({u}, lambda u: xor(u, u >> 14) / 4294967296.0::DOUBLE)[1]"


@query(f"""WITH f AS (SELECT 'in/' || c_mktsegment || '-' || c_custkey || '.pdf' AS path, c_mktsegment || '-' || c_custkey || '.pdf' AS name FROM customer),
s AS (SELECT path, list_reduce(list_prepend(2166136261::BIGINT, [CAST(ord(name[i]) AS BIGINT) FOR i IN range(1, len(name) + 1)]), lambda h, c: CAST((CAST(xor(h, c) AS HUGEINT) * 16777619) % 4294967296 AS BIGINT)) AS seed FROM f),
n AS (SELECT path, seed, CAST(3 + floor({_draw_sql('seed', '1')} * 6) AS INTEGER) AS n FROM s), l AS (SELECT path, seed, n, unnest(range(0, n)) AS i FROM n),
c AS (SELECT path, i, seed, n, CAST(floor((500 + {_draw_sql('seed', 'i + 2')} * 90000) * 100 + 0.5) AS BIGINT) AS cents FROM l)
SELECT path, CAST(i + 1 AS INTEGER) AS line_no, 'INV-' || (1000 + i) AS reference, printf('%d.%02d', cents // 100, cents % 100) AS amount, printf('%d.%02d', CAST(floor(cents / 100.0::DOUBLE * 15 + 0.5) AS BIGINT) // 100, CAST(floor(cents / 100.0::DOUBLE * 15 + 0.5) AS BIGINT) % 100) AS vat_amount,
CAST(1 + floor({_draw_sql('seed', 'n + 2')} * 4) AS INTEGER) AS page_count FROM c""")
def stub_document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that the stub parser gives for a file of each customer."""
    path = F.concat(F.lit("in/"), "c_mktsegment", F.lit("-"), F.col("c_custkey").cast("string"), F.lit(".pdf"))
    files = views.table(spark, sf_dir, "customer").select(path.alias("path"), F.lit("INVOICE").alias("document_type"))
    return objects.stub_lines(files).select("path", "line_no", "reference", "amount", "vat_amount", "page_count")


# Authoring


@query("""WITH p AS (SELECT c_custkey AS k, 'f' || c_nationkey AS firm, CASE WHEN c_custkey % 11 = 0 THEN '-' ELSE 't' END || c_custkey AS test_key, c_custkey % 4 AS denom FROM customer),
d AS (SELECT *, CASE WHEN k % 3 = 0 THEN '{"kind":"UNBALANCED_JE"}' ELSE '{"kind":"ROUND_NUMBER_FREQUENCY","params":{"amountBasis":"TRANSACTION","methodVersion":"st.round.1","roundingQuantum":"100","minimumPopulation":' || k || ',"minimumRoundCount":2,"rateThresholdNum":' || CASE WHEN denom = 2 THEN 1 ELSE 2 END || ',"rateThresholdDenom":' || CASE WHEN denom = 2 THEN 1 ELSE denom END || '}}' END AS def,
CASE WHEN k % 11 = 0 THEN 'malformed key' WHEN k % 3 > 0 AND denom < 2 THEN 'unsound parameters' WHEN k % 7 = 0 THEN 'key exists' END AS problem FROM p)
SELECT firm AS firm_id, test_key, problem, CASE WHEN problem IS NULL THEN sha256('{"f":"' || firm || '","key":"' || test_key || '","v":1,"tt":"' || CASE WHEN k % 3 = 0 THEN 'ACCOUNTING_INTEGRITY' ELSE 'STATISTICAL' END || '","def":' || def || ',"req":{"requiredDatasetKinds":["GENERAL_LEDGER"]}}') END AS version_hash FROM d""")
def tests_authored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A test of each customer: some have malformed keys, unsound rates or keys that exist."""
    own, lit, text = F.col("c_custkey"), F.lit, F.col("c_custkey").cast("string")
    rate = F.create_map(lit("roundingQuantum"), lit("100"), lit("minimumPopulation"), text, lit("minimumRoundCount"), lit(" +2 "), lit("rateThresholdNum"), lit("2"), lit("rateThresholdDenom"), (own % 4).cast("string"))
    ledger = own % 3 == 0
    customer = views.table(spark, sf_dir, "customer")
    firm, key = F.concat(lit("f"), F.col("c_nationkey").cast("string")).alias("firm_id"), F.concat(F.when(own % 11 == 0, "-").otherwise("t"), text).alias("test_key")
    proposed = customer.select(firm, key, lit("n").alias("name"), F.when(ledger, "ACCOUNTING_INTEGRITY").otherwise("STATISTICAL").alias("test_type"), F.when(ledger, "UNBALANCED_JE").otherwise("ROUND_NUMBER_FREQUENCY").alias("kind"), F.array(lit("BANK"), lit("GENERAL_LEDGER")).alias("dataset_kinds"), rate.alias("parameters"), lit(False).alias("needs_mapping"))
    existing = customer.where(own % 7 == 0).select(firm, key)
    return preparation.authored_tests(proposed, existing).select("firm_id", "test_key", "problem", "version_hash")

"""Queries of the listings of runs; registered beside those of `catalog`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import listings
from ledgerloom.plans import views
from ledgerloom.plans.catalog import query

# Orders are runs of fifteen engagements of three firms. User 1 is a member of engagements 0 to 9,
# asks for all of the first firm and for one of another; user 2 is a member of none.


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    engagement = F.col("o_custkey") % 15
    return views.table(spark, sf_dir, "orders").select(
        (engagement % 3).alias("firm_id"), engagement.alias("engagement_id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("timestamp").alias("created_at"), "o_custkey"
    )


def _engagements(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    known = orders.select("firm_id", "engagement_id").distinct()
    return known, known.where("engagement_id < 10").select("engagement_id", F.lit(1).alias("user_id"))


def _asked(orders: DataFrame, of: str) -> DataFrame:
    wanted = orders.where((F.col("firm_id") == 0) | (F.col("engagement_id") == 1)).select(of).distinct()
    return wanted.withColumns({"firm_id": F.lit(0).cast("long"), "user_id": F.explode(F.array(F.lit(1), F.lit(2)))})


def _judged_runs(orders: DataFrame) -> DataFrame:
    return listings.run_access(_asked(orders, "run_id"), orders, *_engagements(orders))


_O = "o AS (SELECT *, o_custkey % 15 AS e, o_custkey % 15 % 3 AS f FROM orders)"
_G = "f = 0 AND e < 10"


@query(f"""WITH {_O} SELECT u.user_id, o_orderkey AS run_id, CASE WHEN f <> 0 THEN 'NOT_FOUND' WHEN e < 10 AND u.user_id = 1 THEN 'GRANTED' ELSE 'FORBIDDEN' END AS access FROM o, (VALUES (1), (2)) u(user_id) WHERE f = 0 OR e = 1""")
def run_requests_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who may see which runs: members, others of the firm, and runs of another firm."""
    return _judged_runs(_orders(spark, sf_dir)).select("user_id", "run_id", "access")


@query(f"""WITH {_O}, r AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY o_orderdate DESC, o_orderkey) AS place FROM o) SELECT 1 AS user_id, e AS engagement_id, o_orderkey AS run_id, CAST(place AS INTEGER) AS place FROM r WHERE {_G} AND place <= 200""")
def runs_of_engagements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 200 runs of each engagement that a member asks for."""
    orders = _orders(spark, sf_dir)
    judged = listings.engagement_access(_asked(orders, "engagement_id"), *_engagements(orders))
    return listings.runs_listed(judged, orders).select("user_id", "engagement_id", "run_id", "place")


@query(f"""WITH {_O}, r AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY o_orderdate DESC, o_orderkey) AS place FROM o WHERE o_orderstatus <> 'P') SELECT e AS engagement_id, o_orderkey AS dataset_id, CAST(place AS INTEGER) AS place FROM r WHERE {_G} AND place <= 200""")
def datasets_of_engagements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 200 datasets that runs may use, of each engagement."""
    orders = _orders(spark, sf_dir)
    judged = listings.engagement_access(_asked(orders, "engagement_id"), *_engagements(orders))
    status = F.when(F.col("status") == "O", "COMPLETED").when(F.col("status") == "F", "COMPLETED_WITH_ISSUES").otherwise("READY")
    datasets = orders.select("firm_id", "engagement_id", F.col("run_id").alias("dataset_id"), status.alias("status"), "created_at")
    return listings.datasets_listed(judged, datasets).select("engagement_id", "dataset_id", "place")


@query(f"""WITH {_O} SELECT o_orderkey AS run_id, unnest(range(1, 2 + o_orderkey % 4)) AS attempt_no, CAST(unnest(range(1, 2 + o_orderkey % 4)) AS INTEGER) AS place FROM o WHERE {_G}""")
def jobs_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All attempts of the runs that a member asks for, in their order."""
    orders = _orders(spark, sf_dir)
    jobs = orders.select("firm_id", "run_id", F.explode(F.sequence(F.lit(1).cast("long"), 1 + F.col("run_id") % 4)).alias("attempt_no"))
    return listings.jobs_listed(_judged_runs(orders), jobs).select("run_id", "attempt_no", "place")


@query(f"""WITH {_O}, r AS (SELECT l_orderkey % 40 AS run_id, l_orderkey AS result_id, 'p' || min(l_partkey) % 50 AS print FROM lineitem GROUP BY 1, 2),
p AS (SELECT r.*, row_number() OVER (PARTITION BY run_id ORDER BY print, result_id) AS n FROM r JOIN o ON o_orderkey = run_id WHERE {_G}),
s AS (SELECT *, n - CASE WHEN run_id % 2 = 0 THEN 7 ELSE 0 END AS place FROM p) SELECT run_id, result_id, CAST(place AS INTEGER) AS place FROM s WHERE place BETWEEN 1 AND 20""")
def result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of 20 results by fingerprint, which some share; of every other run the page after the seventh result."""
    orders, lines = _orders(spark, sf_dir), views.table(spark, sf_dir, "lineitem")
    results = lines.groupBy((F.col("l_orderkey") % 40).alias("run_id"), F.col("l_orderkey").alias("result_id")).agg(F.concat(F.lit("p"), (F.min("l_partkey") % 50).cast("string")).alias("semantic_fingerprint"))
    results = results.join(orders.select("run_id", "firm_id"), "run_id")
    judged = _judged_runs(orders)
    last = listings.results_listed(judged, results, most=7).where("place = 7 AND run_id % 2 = 0")
    return listings.results_listed(judged, results, last, most=20).select("run_id", "result_id", "place")


_TYPES = (("STATISTICAL", "ROUND_NUMBER_FREQUENCY", ["GENERAL_LEDGER"]), ("DATA_QUALITY", "POPULATION_MEMBER", ["GENERAL_LEDGER", "TRIAL_BALANCE"]))


@query("""WITH t AS (SELECT c_custkey AS k, c_nationkey AS firm_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY 't' || c_custkey) AS place FROM customer WHERE c_custkey % 5 <> 0)
SELECT firm_id, 't' || k AS test_key, CASE k % 3 WHEN 0 THEN 'GENERAL_LEDGER' WHEN 1 THEN 'GENERAL_LEDGER,TRIAL_BALANCE' ELSE '' END AS dataset_kinds FROM t WHERE k % 2 = 0 AND place <= 500""")
def tests_of_firms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests with an active current version and the dataset kinds that they take; some have no version, some an inactive one, some no executor."""
    key = F.col("c_custkey")
    pick = lambda i: F.when(key % 3 == 0, _TYPES[0][i]).when(key % 3 == 1, _TYPES[1][i]).otherwise("OTHER")
    customer = views.table(spark, sf_dir, "customer").withColumn("firm_id", F.col("c_nationkey"))
    tests = customer.select("firm_id", F.concat(F.lit("t"), key.cast("string")).alias("test_key"), F.col("c_name").alias("name"), pick(0).alias("test_type"), F.when(key % 5 != 0, key).alias("current_version_id"))
    versions = customer.select("firm_id", key.alias("version_id"), F.when(key % 2 == 0, "ACTIVE").otherwise("RETIRED").alias("status"), pick(1).alias("kind"))
    kinds = spark.createDataFrame(_TYPES, "test_type string, kind string, dataset_kinds array<string>")
    return listings.tests_listed(tests, versions, kinds).select("firm_id", "test_key", F.array_join("dataset_kinds", ",").alias("dataset_kinds"))


@query(f"""WITH {_O}, v AS (SELECT l_suppkey % 30 AS result_id, l_orderkey AS line, l_orderkey % 4 AS kind, CASE WHEN l_orderkey % 6 > 0 THEN l_orderkey END AS source_row_no, min(l_linenumber) AS other FROM lineitem GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY source_row_no NULLS LAST, line) AS place FROM v)
SELECT result_id, line AS evidence_id, CAST(place AS INTEGER) AS place, CASE WHEN kind < 3 THEN line END AS traced_id, CASE WHEN kind < 3 THEN 'a=' || line || ',b=' || '-' END AS cells FROM p JOIN o ON o_orderkey = result_id WHERE {_G} AND place <= 200""")
def evidence_of_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 rows of evidence of each result, traced to source cells by record, ledger line or balance row."""
    orders, line = _orders(spark, sf_dir), F.col("l_orderkey")
    of = lambda kind: F.when(line % 4 == kind, line).cast("long")
    rows = views.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 30).alias("result_id"), line.alias("l_orderkey")).distinct()
    evidence = rows.select(line.alias("evidence_id"), "result_id", F.lit("JOURNAL_LINE").alias("evidence_type"), F.when(line % 6 > 0, line).alias("source_row_no"), of(0).alias("record_id"), of(1).alias("line_id"), of(2).alias("balance_id"))
    keys = rows.select(line.alias("k")).distinct()
    cell = lambda i, h, v: F.struct(F.lit(i).alias("i"), F.lit(h).alias("h"), v.alias("v"))
    records = keys.select(F.col("k").alias("record_id"), F.array(cell(1, "b", F.lit(None).cast("string")), cell(0, "a", F.col("k").cast("string"))).alias("cells"))
    traced = lambda name: keys.select(F.col("k").alias(name), F.col("k").alias("record_id"))
    results = orders.select("firm_id", "run_id", F.col("run_id").alias("result_id"))
    shown = F.array_join(F.transform("cells", lambda c: F.concat(c["h"], F.lit("="), F.coalesce(c["v"], F.lit("-")))), ",")
    found = listings.evidence_listed(_judged_runs(orders), results, evidence, traced("line_id"), traced("balance_id"), records)
    return found.select("result_id", "evidence_id", "place", "traced_id", F.when(F.col("cells").isNotNull(), shown).alias("cells"))


@query("""WITH c AS (SELECT c_nationkey AS n, c_custkey AS k FROM customer ORDER BY n, k LIMIT 3 OFFSET 7) SELECT n AS c_nationkey, k AS c_custkey FROM c""")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three customers by nation and key after the seventh."""
    rows = views.table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey")
    order = ["c_nationkey", "c_custkey"]
    seen = listings.page(rows, order, None, 7).collect()  # a page: seven rows
    return listings.page(rows, order, tuple(seen[-1]) if seen else None, 3)

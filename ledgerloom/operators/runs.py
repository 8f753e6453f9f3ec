"""Frozen runs: eligibility, populations and their fingerprints, manifests, and the work queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import framing
from ledgerloom.operators.chains import Chain, hashed_in_order

#: Rows of the work queue per firm and in all.
PER_FIRM, IN_ALL = 50, 200
#: What a test needs of a dataset, and the dataset kinds that provide entries.
CAPABILITIES = ("DATASET_KIND", "JE_GROUPING", "ACCOUNT_MAPPING")


def eligibility(datasets: DataFrame, required_kind: str | None, needs: tuple[str, ...] = (), degradable: tuple[str, ...] = ()) -> DataFrame:
    """Adds unmet (needs not met, in order) and eligibility: ELIGIBLE, DEGRADED if only degradable needs are unmet, else NOT_ELIGIBLE.

    datasets: dataset_id, kind, n_grouped (lines with an entry), n_mapped (accounts with a mapping).
    """
    met = {
        "DATASET_KIND": F.lit(True) if required_kind is None else F.col("kind") == required_kind,
        "JE_GROUPING": F.col("n_grouped") > 0,
        "ACCOUNT_MAPPING": F.col("n_mapped") > 0,
    }
    asked = [c for c in CAPABILITIES if c == "DATASET_KIND" or c in needs]
    unmet = F.array_compact(F.array(*(F.when(~F.coalesce(met[c], F.lit(False)), F.lit(c)) for c in asked)))
    hard = F.filter("unmet", lambda c: ~c.isin(*degradable)) if degradable else F.col("unmet")
    out = datasets.withColumn("unmet", unmet)
    return out.withColumn("eligibility", F.when(F.size("unmet") == 0, "ELIGIBLE").when(F.size(hard) == 0, "DEGRADED").otherwise("NOT_ELIGIBLE"))


def population(records: DataFrame, dataset_hashes: DataFrame) -> DataFrame:
    """Members: accepted records (dataset_id, source_row_no, raw_hash, status) with their identity, frozen content_hash and eoi."""
    accepted = records.where("status <> 'REJECTED'").join(dataset_hashes.select("dataset_id", "dataset_hash"), "dataset_id")
    eoi = framing.record_identity(F.col("dataset_hash"), F.col("source_row_no"), F.col("raw_hash"))
    return accepted.select("dataset_id", "source_row_no", F.col("raw_hash").alias("content_hash"), eoi.alias("eoi"))


def population_fingerprints(members: DataFrame) -> DataFrame:
    """dataset_id, n_members, fingerprint: a chain over members in row order, streamed, so that a dataset may be of any size."""
    chained = hashed_in_order(members, ("dataset_id",), "eoi", Chain)
    return chained.select("dataset_id", F.col("n_rows").alias("n_members"), framing.population_seal(F.col("hashed"), F.col("n_rows")).alias("fingerprint"))


def publish(members: DataFrame, path: str) -> None:
    """Freezes a population: written once, and refused if it is there."""
    members.write.mode("errorifexists").partitionBy("dataset_id").parquet(path)


def latest_attempts(jobs: DataFrame) -> DataFrame:
    """The latest attempt of each run's job: run_id, attempt_no, status, lease_expires_at."""
    latest = F.max_by(F.struct("attempt_no", "status", "lease_expires_at"), "attempt_no").alias("job")
    return jobs.groupBy("run_id").agg(latest).select("run_id", "job.*")


def work_queue(runs: DataFrame, preparations: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """Runs with work to do, oldest first: at most PER_FIRM of a firm and IN_ALL in all.

    runs: firm_id, run_id, status, updated_at; preparations: run_id, status; jobs: run_id,
    attempt_no, status, lease_expires_at. A run that is being prepared, and has a preparation
    that is, waits for preparation; a queued one, or a running one whose latest attempt is
    running on an expired lease, waits for execution.
    """
    prepare = runs.where("status = 'PREPARING'").join(preparations.where("status = 'PREPARING'").select("run_id").distinct(), "run_id", "left_semi")
    expired = latest_attempts(jobs).where((F.col("status") == "RUNNING") & (F.col("lease_expires_at") < now)).select("run_id")
    execute = runs.where("status = 'QUEUED'").unionByName(runs.where("status = 'RUNNING'").join(expired, "run_id", "left_semi"))
    columns = ["firm_id", "run_id", "updated_at"]
    work = prepare.select(*columns, F.lit("PREPARATION").alias("work_type")).unionByName(execute.select(*columns, F.lit("EXECUTION").alias("work_type")))
    turn = F.row_number().over(Window.partitionBy("firm_id").orderBy("updated_at", "run_id"))
    return work.withColumn("turn", turn).where(F.col("turn") <= PER_FIRM).orderBy("updated_at", "run_id").limit(IN_ALL)


def new_results(results: DataFrame, stored: DataFrame) -> DataFrame:
    """Results that aren't stored yet, each occurrence once; inserting again changes nothing."""
    identity = ["firm_id", "run_id", "occurrence_fingerprint"]
    return results.dropDuplicates(identity).join(stored.select(*identity), identity, "left_anti")


def guarded_evidence(evidence: DataFrame, members: DataFrame) -> DataFrame:
    """Evidence, all of which must point at members; else the write fails."""
    marked = evidence.join(members.select("dataset_id", "source_row_no", F.lit(True).alias("is_member")), ["dataset_id", "source_row_no"], "left")
    return marked.where(F.assert_true(F.col("is_member"), F.lit("evidence outside the population")).isNull()).drop("is_member")


def legacy_containers(transactions: DataFrame) -> DataFrame:
    """Transactions without a dataset are given one container per firm and engagement."""
    name = F.concat_ws("/", F.lit("LEGACY_UNVERIFIED"), "firm_id", "engagement_id")
    return transactions.withColumn("dataset_id", F.coalesce("dataset_id", name))


def without_dataset(table: DataFrame, used_in_runs: DataFrame, dataset_id: str) -> DataFrame:
    """`table` after a dataset is deleted; refused if a run uses it."""
    if not used_in_runs.where(F.col("dataset_id") == dataset_id).isEmpty():
        raise ValueError(f"{dataset_id} is used in a run")
    return table.where(~F.col("dataset_id").eqNullSafe(dataset_id))


def tenant_table(spark: SparkSession, path: str, firm_id: str | None) -> DataFrame:
    """Rows of one firm; without a firm it fails. Partitioned by firm_id, only the firm's files are read."""
    if not firm_id:
        raise PermissionError("no firm in context")
    return spark.read.parquet(path).where(F.col("firm_id") == firm_id)

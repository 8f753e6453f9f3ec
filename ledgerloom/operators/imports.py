"""The import lifecycle: retries of failed attempts, and confirmation as one operation.

A confirmation writes the flat transactions, the canonical facts and the dataset's identity into
a folder of its own and seals them together. Readers know what is sealed; an attempt that fails
before leaves nothing that they see, and may be made again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import money
from ledgerloom.operators import accounting, ingest
from ledgerloom.operators.lifecycle import source_identity
from ledgerloom.session import checkpointed, stored
from ledgerloom.sources.sinks import write_sealed

#: Parts of a row's source identity, and the version of the rules that normalise rows.
SOURCE_PARTS = ("sourceSystem", "sourceEntity", "sourceLedger", "sourceEntryId", "sourceLineId", "functionalDebit", "functionalCredit", "functionalCurrency")
NORMALIZER = "g2.1"


def started(proposed: DataFrame, batches: DataFrame, files: DataFrame, stored: DataFrame) -> DataFrame:
    """What each proposed import becomes: firm_id, arrival, outcome, existing_batch_id, duplicate_of.

    proposed: firm_id, arrival (a number, unique in the firm), idempotency_key, sha256, size,
    acknowledged; batches: firm_id, idempotency_key, batch_id; files: firm_id, sha256,
    source_file_id; stored (the objects): firm_id, sha256, length. Judged in the order of
    arrival, within the proposals too:

    * DEDUPED_EXISTING if the firm has a batch of the key; `existing_batch_id` is its id, or
      the arrival of the proposal that starts it;
    * DUPLICATE_BLOCKED if it has a file of these bytes and the user hasn't acknowledged that;
      `duplicate_of` is the least id of such files, or the arrival;
    * STORAGE_FAILED if the store doesn't hold the bytes at their full length;
    * READY else.

    A key that is null is none: the proposal stands by itself. Null bytes aren't stored; a null
    acknowledgement is none.

    Only proposals that may become READY wait for each other. Each round decides those that no
    earlier open one shares the key with, nor the bytes (where that isn't acknowledged), and
    drops the later ones that they rule out. Repeats, however many, go with the first of them;
    only a chain of proposals that share a key with one and bytes with the next takes a round
    for each two.
    """
    names = ["firm_id", "arrival", "idempotency_key", "sha256", "size", "acknowledged"]
    own = proposed.select(*names).withColumn("acknowledged", F.coalesce("acknowledged", F.lit(False)))
    by_key, by_bytes = ["firm_id", "idempotency_key"], ["firm_id", "sha256"]
    known = batches.groupBy(*by_key).agg(F.min(F.col("batch_id").cast("string")).alias("batch_id"))
    held = files.groupBy(*by_bytes).agg(F.min(F.col("source_file_id").cast("string")).alias("source_file_id"))
    whole = stored.select(*by_bytes, F.col("length").alias("size"), F.lit(True).alias("is_stored")).distinct()
    facts = own.join(known, by_key, "left").join(held, by_bytes, "left").join(whole, [*by_bytes, "size"], "left")
    facts = checkpointed(facts.withColumn("is_stored", F.coalesce("is_stored", F.lit(False))))
    may = facts.where(F.col("is_stored") & F.col("batch_id").isNull() & (F.col("acknowledged") | F.col("source_file_id").isNull()))
    still = may.select("firm_id", "arrival", "idempotency_key", "sha256", "acknowledged")
    ready = still.limit(0)
    while True:
        first_key = still.where("idempotency_key is not null").groupBy(*by_key).agg(F.min("arrival").alias("first_key"))
        first_bytes = still.groupBy(*by_bytes).agg(F.min("arrival").alias("first_bytes"))
        placed = still.join(first_key, by_key, "left").join(first_bytes, by_bytes)
        free = (F.coalesce("first_key", "arrival") == F.col("arrival")) & (F.col("acknowledged") | (F.col("first_bytes") == F.col("arrival")))
        judged = checkpointed(placed.withColumn("is_ready", free))
        fresh = judged.where("is_ready").select(*still.columns)
        ready = checkpointed(ready.unionByName(fresh))
        later = judged.where("not is_ready").select(*still.columns)
        taken = fresh.where("idempotency_key is not null").groupBy(*by_key).agg(F.min("arrival").alias("key_at"))
        seen = fresh.groupBy(*by_bytes).agg(F.min("arrival").alias("bytes_at"))
        after = later.join(taken, by_key, "left").join(seen, by_bytes, "left")
        ruled_out = (F.col("key_at") < F.col("arrival")) | (~F.col("acknowledged") & (F.col("bytes_at") < F.col("arrival")))
        still = checkpointed(after.where(~F.coalesce(ruled_out, F.lit(False))).select(*still.columns))
        if still.isEmpty():
            break
    key_at = ready.where("idempotency_key is not null").groupBy(*by_key).agg(F.min("arrival").alias("key_at"))
    bytes_at = ready.groupBy(*by_bytes).agg(F.min("arrival").alias("bytes_at"))
    mine = ready.select("firm_id", "arrival", F.lit(True).alias("is_ready"))
    out = facts.join(mine, ["firm_id", "arrival"], "left").join(key_at, by_key, "left").join(bytes_at, by_bytes, "left")
    before = lambda c: F.when(F.col(c) < F.col("arrival"), F.col(c).cast("string"))
    batch, file = F.coalesce("batch_id", before("key_at")), F.coalesce("source_file_id", before("bytes_at"))
    outcome = F.when(F.col("is_ready"), "READY").when(batch.isNotNull(), "DEDUPED_EXISTING").when(file.isNotNull() & ~F.col("acknowledged"), "DUPLICATE_BLOCKED").otherwise("STORAGE_FAILED")
    judged = out.withColumns({"outcome": outcome, "batch": batch, "file": file})
    return judged.select("firm_id", "arrival", "outcome", F.when(F.col("outcome") == "DEDUPED_EXISTING", F.col("batch")).alias("existing_batch_id"), F.when(F.col("outcome") == "DUPLICATE_BLOCKED", F.col("file")).alias("duplicate_of"))


def retries(batches: DataFrame, attempts: DataFrame) -> DataFrame:
    """What a retry of each batch does: batch_id, outcome, attempt_no of the next attempt, interrupted (the attempt that ends as FAILED).

    batches: batch_id, result_dataset_id, object_key; attempts: batch_id, attempt_no, status. A
    batch with a result is DEDUPED_EXISTING, one whose file isn't stored STORAGE_FAILED, any
    other READY; an attempt that is still RUNNING was interrupted.
    """
    latest = attempts.groupBy("batch_id").agg(F.max("attempt_no").alias("latest"), F.max_by("status", "attempt_no").alias("status"))
    joined = batches.join(latest, "batch_id", "left")
    done, stored = F.col("result_dataset_id").isNotNull(), F.coalesce("object_key", F.lit("")) != ""
    outcome = F.when(done, "DEDUPED_EXISTING").when(~stored, "STORAGE_FAILED").otherwise("READY")
    return joined.select(
        "batch_id",
        outcome.alias("outcome"),
        F.when(~done & stored, F.coalesce("latest", F.lit(0)) + 1).alias("attempt_no"),
        F.when(~done & (F.col("status") == "RUNNING"), F.col("latest")).alias("interrupted"),
    )


def after_retry(attempts: DataFrame, retried: DataFrame) -> DataFrame:
    """Attempts after a retry: interrupted ones FAILED, and the next one of every READY batch RUNNING."""
    broken = retried.where(F.col("interrupted").isNotNull()).select("batch_id", F.col("interrupted").alias("attempt_no"), F.lit(True).alias("is_broken"))
    kept = attempts.join(broken, ["batch_id", "attempt_no"], "left").withColumn("status", F.when(F.col("is_broken"), "FAILED").otherwise(F.col("status"))).drop("is_broken")
    fresh = retried.where("outcome = 'READY'").select("batch_id", "attempt_no", F.lit("RUNNING").alias("status"))
    return kept.unionByName(fresh, allowMissingColumns=True)


def ledger_lines(prepared: DataFrame, dataset_id: str, identity: dict[str, str], convention: str | None = None) -> DataFrame:
    """Canonical lines of accepted ledger rows, from their raw values; identity: field of SOURCE_PARTS to header.

    Amounts keep all their places. A single signed amount is split by the frozen convention
    (see `money.transaction_sides`), and has no side without one.
    """
    accepted = ingest.accepted_rows(prepared)
    named = {part: header for part, header in identity.items() if part in SOURCE_PARTS}
    rows = accepted.withColumn("source", source_identity(F.col("cells"), {header: part for part, header in named.items()}) if named else F.struct(F.lit(None).cast("string").alias("none")))
    part = lambda name: F.nullif(F.col("source")[name], F.lit("")) if name in named else F.lit(None).cast("string")
    exact = lambda c: money.canonical_decimal(c).try_cast("decimal(24,6)")
    mapped = {name: exact(ingest.field_of(prepared, "mapped", name)) for name in ("debit", "credit", "amount")}
    rows = rows.withColumns({f"exact_{name}": value for name, value in mapped.items()})
    debit, credit = money.transaction_sides(F.col("exact_debit"), F.col("exact_credit"), F.col("exact_amount"), convention)
    normal = lambda name: ingest.field_of(prepared, "normalized", name)
    return rows.select(
        F.lit(dataset_id).alias("dataset_id"), "source_row_no", part("sourceEntryId").alias("source_entry_id"), part("sourceLineId").alias("source_line_id"),
        *(part(p).alias(f"source_{p[6:].lower()}") for p in SOURCE_PARTS[:3]),
        normal("accountCode").alias("account"), normal("accountName").alias("account_name"), normal("postingDate").cast("date").alias("entry_date"),
        debit.alias("transaction_debit"), credit.alias("transaction_credit"), normal("currency").alias("transaction_currency"),
        exact(part("functionalDebit")).alias("functional_debit"), exact(part("functionalCredit")).alias("functional_credit"), part("functionalCurrency").alias("functional_currency"),
    )


def balance_rows(prepared: DataFrame, dataset_id: str) -> DataFrame:
    """Trial balance rows of accepted rows with an account, from their raw values."""
    names = {"openingDebit": "opening_debit", "openingCredit": "opening_credit", "periodDebit": "period_debit", "periodCredit": "period_credit", "closingDebit": "closing_debit", "closingCredit": "closing_credit"}
    exact = lambda name: money.canonical_decimal(ingest.field_of(prepared, "mapped", name)).try_cast("decimal(24,6)")
    normal = lambda name: ingest.field_of(prepared, "normalized", name)
    rows = ingest.accepted_rows(prepared).select(F.lit(dataset_id).alias("dataset_id"), F.lit(dataset_id).alias("trial_balance_id"), "source_row_no", normal("accountCode").alias("account"), normal("accountName").alias("account_name"), normal("currency").alias("currency"), *(exact(f).alias(c) for f, c in names.items()))
    return accounting.trial_balance_rows(rows)


def confirmed(prepared: DataFrame, kind: str, dataset_id: str, header: dict[str, str | None], identity: dict[str, str] | None = None, convention: str | None = None) -> dict[str, DataFrame]:
    """Tables of a confirmed import: transactions, dataset (one row: hash, status, row counts) and the canonical facts of ledgers and trial balances.

    header: source file, profile and mapping hashes, as `ingest.dataset_hash` takes them.
    """
    rows = stored(prepared)  # every table is made of the same rows
    rejected = F.count_if(F.col("status") == "REJECTED")
    counted = rows.agg(F.count("*").alias("n_rows"), rejected.alias("n_rejected"))
    hashes = ingest.dataset_hash(rows.select("source_row_no", "raw_hash"), header, is_stored=True).select("dataset_hash")
    status = F.when(F.col("n_rejected") > 0, "COMPLETED_WITH_ISSUES").otherwise("COMPLETED")
    empty = ingest.empty_dataset_hash(header)
    dataset = counted.join(hashes, F.lit(True), "left").select(F.lit(dataset_id).alias("dataset_id"), F.lit(kind).alias("kind"), F.coalesce("dataset_hash", F.lit(empty)).alias("dataset_hash"), status.alias("status"), "n_rows", "n_rejected")  # one row each
    tables = {"records": rows, "issues": ingest.issue_rows(rows), "transactions": ingest.to_transactions(rows, kind), "dataset": dataset}
    if kind == "GENERAL_LEDGER":
        lines = stored(ledger_lines(rows, dataset_id, identity or {}, convention))
        tables |= {"contexts": accounting.contexts(lines), "accounts": accounting.accounts(lines), "entries": accounting.entries(lines), "lines": accounting.numbered_lines(lines)}
    elif kind == "TRIAL_BALANCE":
        balances = stored(balance_rows(rows, dataset_id))
        tables |= {"accounts": accounting.accounts(balances), "balances": balances}
    return tables


def confirm_import(prepared: DataFrame, kind: str, dataset_id: str, header: dict[str, str | None], path: str, identity: dict[str, str] | None = None, convention: str | None = None) -> str:
    """Writes all tables of a confirmed import under one seal, once; gives the attempt's name."""
    return write_sealed(confirmed(prepared, kind, dataset_id, header, identity, convention), path)

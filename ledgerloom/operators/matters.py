"""Findings from draft to conclusion, as event tables: what state events leave, and which proposed events may join them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import trimmed

#: The state that each review action leaves.
STATE_OF_REVIEW = {"SUBMIT": "IN_REVIEW", "APPROVE": "CONCLUDED", "RETURN": "DRAFT"}
REQUIRED = ("category", "condition", "criteria", "cause", "effect", "auditorConclusion")
CURRENCY = "SAR"


def finding_states(versions: DataFrame, reviews: DataFrame) -> DataFrame:
    """finding_id, status, current_version, latest_review_seq; a finding without a review is a DRAFT.

    versions: finding_id, version_no; reviews: finding_id, event_seq, action.
    """
    states = F.create_map(*(F.lit(x) for pair in STATE_OF_REVIEW.items() for x in pair))
    current = versions.groupBy("finding_id").agg(F.max("version_no").alias("current_version"))
    last = reviews.groupBy("finding_id").agg(F.max("event_seq").alias("latest_review_seq"), F.max_by("action", "event_seq").alias("action"))
    joined = current.join(last, "finding_id", "left")
    return joined.select("finding_id", F.coalesce(states[F.col("action")], F.lit("DRAFT")).alias("status"), "current_version", F.coalesce("latest_review_seq", F.lit(0)).alias("latest_review_seq"))


def judged_reviews(proposed: DataFrame, versions: DataFrame, reviews: DataFrame) -> DataFrame:
    """Proposed reviews with an outcome, and the event_seq of accepted ones.

    proposed: finding_id, actor_id, action, version_no (of APPROVE and RETURN), idempotency_key,
    one per finding; versions: finding_id, version_no, preparer_id; reviews: finding_id,
    event_seq, action, actor_id, version_no, idempotency_key. An event that is there already is
    REPEATED, or a CONFLICT if it was about another version. A draft may be submitted; what is in
    review may be approved or returned in its current version, by another than its preparer.
    """
    states = finding_states(versions, reviews)
    same = ["finding_id", "actor_id", "action", "idempotency_key"]
    known = reviews.groupBy(*same).agg(F.max("version_no").alias("known_version"), F.lit(True).alias("is_known"))
    preparers = versions.select("finding_id", F.col("version_no").alias("current_version"), "preparer_id")
    joined = proposed.join(states, "finding_id", "left").join(known, same, "left").join(preparers, ["finding_id", "current_version"], "left")
    submits = F.col("action") == "SUBMIT"
    outcome = (
        F.when(F.col("is_known") & (submits | (F.col("known_version") == F.col("version_no"))), "REPEATED")
        .when(F.col("is_known"), "CONFLICT")
        .when(F.col("status").isNull(), "NO_VERSION")
        .when(submits & (F.col("status") != "DRAFT"), "NOT_DRAFT")
        .when(submits, "ACCEPTED")
        .when(F.col("status") != "IN_REVIEW", "NOT_IN_REVIEW")
        .when(~F.col("version_no").eqNullSafe(F.col("current_version")), "NOT_CURRENT")
        .when(F.col("actor_id") == F.col("preparer_id"), "OWN_WORK")
        .otherwise("ACCEPTED")
    )
    judged = joined.withColumn("outcome", outcome)
    return judged.select(*proposed.columns, "outcome", F.when(F.col("outcome") == "ACCEPTED", F.col("latest_review_seq") + 1).alias("event_seq"))


def judged_revisions(proposed: DataFrame, versions: DataFrame, reviews: DataFrame) -> DataFrame:
    """Proposed revisions (finding_id, idempotency_key, content_hash) with an outcome, and the version_no that they have or get.

    Only drafts are revised. A key that is there already is REPEATED if its content is the same, else a CONFLICT.
    """
    known = versions.select("finding_id", "idempotency_key", F.col("content_hash").alias("known_hash"), F.col("version_no").alias("known_version"))
    joined = proposed.join(finding_states(versions, reviews), "finding_id", "left").join(known, ["finding_id", "idempotency_key"], "left")
    outcome = (
        F.when(F.col("known_hash") == F.col("content_hash"), "REPEATED")
        .when(F.col("known_hash").isNotNull(), "CONFLICT")
        .when(F.coalesce("status", F.lit("DRAFT")) != "DRAFT", "NOT_DRAFT")
        .otherwise("ACCEPTED")
    )
    turn = F.row_number().over(Window.partitionBy("finding_id", "outcome").orderBy("idempotency_key"))
    judged = joined.withColumn("outcome", outcome).withColumn("turn", turn)
    number = F.when(F.col("outcome") == "REPEATED", F.col("known_version")).when(F.col("outcome") == "ACCEPTED", F.coalesce("current_version", F.lit(0)) + F.col("turn"))
    return judged.select(*proposed.columns, "outcome", number.cast("long").alias("version_no"))


def finding_content(raw: Column) -> Column:
    """Struct of a finding's content from a map of submitted texts; null if a required text is missing.

    Texts are trimmed and empty ones null. An amount without a currency is in SAR, a currency
    without an amount is dropped.
    """
    value = lambda name: F.nullif(trimmed(F.coalesce(F.try_element_at(raw, F.lit(name)), F.lit(""))), F.lit(""))
    pairs = {}
    for kind in ("observed", "estimatedExposure"):
        amount = value(f"{kind}Amount")
        pairs |= {f"{kind}Amount": amount, f"{kind}Currency": F.when(amount.isNotNull(), F.coalesce(value(f"{kind}Currency"), F.lit(CURRENCY)))}
    texts = {name: value(name) for name in (*REQUIRED, "recommendation")}
    missing = F.lit(False)
    for name in REQUIRED:
        missing = missing | texts[name].isNull()
    return F.when(~missing, F.struct(*(c.alias(n) for n, c in (texts | pairs).items())))

"""Workflow projections: dispositions, exceptions, findings, feeds and listings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import any_holds, holds

#: State that each action of a reviewer leaves, and rows of a feed.
STATE_OF_ACTION = {
    "MARK_UNDER_REVIEW": "UNDER_REVIEW",
    "MARK_NOT_RELEVANT": "DISPOSED",
    "MARK_FALSE_POSITIVE": "DISPOSED",
    "MARK_EXPLAINED": "DISPOSED",
    "REQUIRE_INVESTIGATION": "INVESTIGATING",
    "LINK_TO_EXCEPTION": "LINKED",
    "UNLINK_FROM_EXCEPTION": "INVESTIGATING",
}
FEED_ROWS = 200


def dispositions(events: DataFrame) -> DataFrame:
    """Current state of each result: result_id, event_seq, state; repeated events change nothing."""
    states = F.create_map(*(F.lit(x) for pair in STATE_OF_ACTION.items() for x in pair))
    latest = events.dropDuplicates(["result_id", "event_seq"]).groupBy("result_id").agg(F.max("event_seq").alias("event_seq"), F.max_by("action", "event_seq").alias("action"))
    return latest.select("result_id", "event_seq", states[F.col("action")].alias("state"))


def with_disposition(results: DataFrame, events: DataFrame) -> DataFrame:
    """Results with their state; those without an event are UNREVIEWED."""
    return results.join(dispositions(events).select("result_id", "state"), "result_id", "left").withColumn("state", F.coalesce("state", F.lit("UNREVIEWED")))


def active_links(events: DataFrame) -> DataFrame:
    """Results linked to exceptions: the last LINK or UNLINK of each pair is a LINK."""
    last = events.where(F.col("action").isin("LINK", "UNLINK")).groupBy("exception_id", "result_id").agg(F.max_by("action", "event_seq").alias("action"))
    return last.where("action = 'LINK'").select("exception_id", "result_id")


def exception_counts(exceptions: DataFrame, links: DataFrame, findings: DataFrame) -> DataFrame:
    """Exceptions with their numbers of active links and findings."""
    linked = links.groupBy("exception_id").agg(F.count("*").alias("n_links"))
    found = findings.groupBy("exception_id").agg(F.count("*").alias("n_findings"))
    out = exceptions.join(linked, "exception_id", "left").join(found, "exception_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_links", "n_findings")})


def current_versions(findings: DataFrame, versions: DataFrame) -> DataFrame:
    """Findings with the version that they point at; a finding may have none."""
    return findings.join(versions, (findings.finding_id == versions.finding_id) & (findings.current_version == versions.version_no), "left").drop(versions.finding_id)


@dataclass(frozen=True)
class FeedFilter:
    """Filters of a feed; ALL or None doesn't filter."""

    severity: str | None = None
    rule: str | None = None
    status: str | None = None
    search: str | None = None
    since: str | None = None
    until: str | None = None

    @classmethod
    def from_query(cls, query: dict[str, str]) -> FeedFilter:
        names = {"severity": "severity", "rule": "rule", "status": "status", "q": "search", "from": "since", "to": "until"}
        return cls(**{names[k]: v.strip() for k, v in query.items() if k in names and v.strip()})


def _wanted(value: str | None) -> bool:
    return value not in (None, "", "ALL")


def filtered(anomalies: DataFrame, by: FeedFilter, stored: bool = False) -> DataFrame:
    """Anomalies that pass; searches look at the stored columns one by one, or at all shown text joined."""
    out = anomalies
    for value, column in ((by.severity, "severity"), (by.rule, "rule_code"), (by.status, "status")):
        if _wanted(value):
            out = out.where(F.col(column) == value)
    if by.search:
        shown = ("title_ar", "title", "description_ar", "reference")
        out = out.where(any_holds(by.search, *map(F.col, shown)) if stored else holds(by.search, *map(F.col, (*shown, "description", "counterparty"))))
    if by.since:
        out = out.where(F.col("detected_at") >= F.lit(by.since).cast("timestamp"))
    if by.until:
        out = out.where(F.col("detected_at") <= F.lit(by.until).cast("timestamp"))
    return out


def feed(anomalies: DataFrame, by: FeedFilter = FeedFilter(), rows: int = FEED_ROWS) -> DataFrame:
    """The feed's first rows: highest score, then newest, then least id."""
    return filtered(anomalies, by, stored=True).orderBy(F.desc("score"), F.desc("detected_at"), "anomaly_id").limit(rows)


def anomaly_listing(anomalies: DataFrame, transactions: DataFrame, users: DataFrame, rules: DataFrame) -> DataFrame:
    """Anomalies with reference, amount and counterparty of their transaction, who resolved them, and the name of their rule.

    anomalies: transaction_id, resolver_id, rule_id; transactions: transaction_id, reference,
    amount, counterparty; users: resolver_id, resolver_name; rules: rule_id, rule_name.
    """
    out = anomalies
    for other, on, columns in ((transactions, "transaction_id", ("reference", "amount", "counterparty")), (users, "resolver_id", ("resolver_name",)), (rules, "rule_id", ("rule_name",))):
        out = out.join(other.select(on, *columns), on, "left")
    return out


def listed(rows: DataFrame, order: dict[str, bool], most: int | None = FEED_ROWS) -> DataFrame:
    """A listing ordered by columns, each ascending (True) or descending; its first `most` rows, or all."""
    ordered = rows.orderBy(*(F.asc(c) if up else F.desc(c) for c, up in order.items()))
    return ordered if most is None else ordered.limit(most)


def newest(rows: DataFrame, at: str, tie: str, most: int = FEED_ROWS) -> DataFrame:
    """The newest rows of a listing."""
    return listed(rows, {at: False, tie: True}, most)


def engagements(rows: DataFrame, most: int | None = FEED_ROWS) -> DataFrame:
    """Engagements by fiscal year, then by when they were made, newest first."""
    return listed(rows, {"fiscal_year": False, "created_at": False, "engagement_id": True}, most)


def outcome_counts(results: DataFrame) -> DataFrame:
    """Rows of each outcome."""
    return results.groupBy("outcome").agg(F.count("*").alias("n"))


def stat_cards(anomalies: DataFrame) -> DataFrame:
    """One row: critical, high, open (with those in review), resolved."""
    is_ = lambda column, *values: F.count_if(F.col(column).isin(*values))
    return anomalies.agg(is_("severity", "CRITICAL").alias("critical"), is_("severity", "HIGH").alias("high"), is_("status", "OPEN", "IN_REVIEW").alias("open"), is_("status", "RESOLVED").alias("resolved"))


def evidence_trace(evidence: DataFrame, lines: DataFrame, balances: DataFrame, records: DataFrame) -> DataFrame:
    """Evidence with the source row it leads to, by line, trial balance row or record."""
    out = evidence.join(lines.select(F.col("line_id").alias("target_line"), F.col("source_row_no").alias("line_row")), F.col("line_id") == F.col("target_line"), "left")
    out = out.join(balances.select(F.col("row_id").alias("target_row"), F.col("source_row_no").alias("balance_row")), F.col("balance_id") == F.col("target_row"), "left")
    out = out.withColumn("traced_row", F.coalesce("source_row_no", "line_row", "balance_row"))
    return out.join(records.select(F.col("source_row_no").alias("traced_row"), "raw_hash"), "traced_row", "left").drop("target_line", "target_row", "line_row", "balance_row")


def resolved(status: Column, action: Column) -> Column:
    """Status of an anomaly after RESOLVE, DISMISS or ESCALATE; other actions leave it."""
    return F.when(action == "RESOLVE", "RESOLVED").when(action == "DISMISS", "DISMISSED").when(action == "ESCALATE", "IN_REVIEW").otherwise(status)


def attempts_in_window(log: DataFrame, who: str, at: str, minutes: int = 15) -> DataFrame:
    """Log rows with the number of attempts by the same account or address in the minutes up to each.

    Time is cut into blocks as long as the window; a row counts in its own block and in the next
    one, so a task orders two blocks of an account, however many rows it has. Rows without a
    time count among themselves.
    """
    width = minutes * 60_000_000
    rows = log.withColumn("at_micros", F.unix_micros(at)).withColumn("at_block", F.floor(F.col("at_micros") / width))
    turns = F.when(F.col("at_micros").isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    rows = rows.withColumn("at_turn", F.explode(turns)).withColumn("at_block", F.col("at_block") + F.col("at_turn"))
    window = Window.partitionBy(who, "at_block").orderBy("at_micros").rangeBetween(-width, 0)
    return rows.withColumn("attempts", F.count("*").over(window)).where("at_turn = 0").drop("at_micros", "at_block", "at_turn")

"""Declarative rules: specifications compiled to column predicates and grouped plans.

A rule is data: {"type": ..., parameters}. Row rules become one predicate each, and a set of them
is evaluated in one pass over the transactions; aggregate rules become one grouped plan each.
Findings: rule, severity, score, amount of ids and the ids themselves in input order.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import money
from ledgerloom.functions.money import rounded_half_up
from ledgerloom.functions.text import filled, is_blank, key
from ledgerloom.functions.timeparts import local_hour, local_weekday, rounded_days
from ledgerloom.session import broadcast_if_small, checkpointed

ZONE, OPENS, CLOSES, WEEKEND = "Asia/Riyadh", 7, 19, (5, 6)
#: Rows of a group that one task takes in.
GROUP_ROWS = 100_000
#: The score that a finding of each severity is stored with.
STORED_SCORES = {"CRITICAL": 95, "HIGH": 80, "MEDIUM": 60, "LOW": 40, "INFO": 20}


@dataclass(frozen=True)
class Rule:
    """A named rule; definition holds its type and parameters."""

    code: str
    severity: str
    definition: dict[str, Any]
    enabled: bool = True
    engagement_id: str | None = None

    @classmethod
    def from_json(cls, code: str, severity: str, definition: str, **more: Any) -> Rule:
        return cls(code, severity, json.loads(definition), **more)


def compare(value: Column, op: str, bound: Any, upper: Any = None) -> Column:
    """One of gt, gte, lt, lte, eq, neq and between (inclusive; false without an upper bound); unknown operators are false."""
    if op == "between":
        return value.between(bound, upper) if upper is not None else F.lit(False)
    tests = {"gt": value > bound, "gte": value >= bound, "lt": value < bound, "lte": value <= bound, "eq": value == bound, "neq": value != bound}
    return tests.get(op, F.lit(False))


def _minor() -> Column:
    return money.minor_units(F.col("amount"))


def _fields() -> dict[str, Column]:
    vat = money.minor_units(F.col("vat_amount"))
    return {
        "amount": _minor(),
        "vatAmount": vat,
        "hour": local_hour(F.col("posted_at"), ZONE),
        "weekday": local_weekday(F.col("posted_at"), ZONE),
        "vatRatioPct": money.vat_ratio_pct(_minor(), vat),
        "valueVsPostedDays": rounded_days(F.col("posted_at"), F.col("value_date")),
    }


def _bound(field: str, value: float | None) -> float | int | None:
    return round(value * 100) if value is not None and field in ("amount", "vatAmount") else value


def _field_compare(d: dict[str, Any]) -> Column:
    return compare(_fields()[d["field"]], d["op"], _bound(d["field"], d["value"]), _bound(d["field"], d.get("value2")))


def _round_amount(d: dict[str, Any]) -> Column:
    return (_minor() != 0) & (_minor() % 10 ** (d["minTrailingZeros"] + 2) == 0)


def _threshold_avoidance(d: dict[str, Any]) -> Column:
    limit = d["limit"] * 100
    return (_minor() >= round(limit * (1 - d["marginPct"] / 100))) & (_minor() < limit)


def _value_list(d: dict[str, Any]) -> Column:
    listed = key(F.col(d["field"])).isin(*{str(v).strip().lower() for v in d["values"]})
    return listed if d["mode"] == "deny" else ~listed


def _missing_field(d: dict[str, Any]) -> Column:
    return {
        "counterparty": is_blank(F.col("counterparty")),
        "account": is_blank(F.col("account")),
        "vatAmount": F.col("vat_amount").isNull(),
        "document": ~F.col("has_document"),
        "valueDate": F.col("value_date").isNull(),
    }[d["field"]]


def _time_window(d: dict[str, Any]) -> Column:
    zone = d.get("tz", ZONE)
    if d["mode"] == "weekend":
        return local_weekday(F.col("posted_at"), zone).isin(*d.get("weekend", WEEKEND))
    hour = local_hour(F.col("posted_at"), zone)
    return (hour < d.get("startHour", OPENS)) | (hour >= d.get("endHour", CLOSES))


ROW_RULES: dict[str, Callable[[dict[str, Any]], Column]] = {
    "field_compare": _field_compare,
    "round_amount": _round_amount,
    "threshold_avoidance": _threshold_avoidance,
    "value_list": _value_list,
    "missing_field": _missing_field,
    "time_window": _time_window,
}


def predicate(rule: Rule) -> Column:
    """Whether a transaction breaks a row rule; null counts as no."""
    return F.coalesce(ROW_RULES[rule.definition["type"]](rule.definition), F.lit(False))


def matching(transactions: DataFrame, rule: Rule) -> DataFrame:
    """The transactions that break a row rule."""
    return transactions.where(predicate(rule))


def _group_keys(fields: list[str]) -> dict[str, Column]:
    known = {"counterparty": key(F.col("counterparty")), "account": key(F.col("account")), "reference": key(F.col("reference")), "amount": _minor()}
    return {f"key_{name}": known[name] for name in fields}


def _since_first(rows: DataFrame, keys: list[str], group_rows: int) -> DataFrame:
    """Adds since: microseconds after the first of a row's group. Groups are never sorted.

    The first is an aggregate that is joined back. Groups of more than group_rows rows, which one
    task would have to take in whole, get theirs where they lie, from a list sent to all tasks.
    """
    at = F.unix_micros("posted_at")
    firsts = checkpointed(rows.groupBy(*keys).agg(F.min(at).alias("first_at"), F.count("*").alias("group_size")).withColumnsRenamed({k: f"own_{k}" for k in keys}))
    same = lambda: functools.reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"own_{k}")) for k in keys))
    hot, others = firsts.where(F.col("group_size") > group_rows), firsts.where(F.col("group_size") <= group_rows)
    if hot.isEmpty():
        return rows.join(firsts, same()).withColumn("since", at - F.col("first_at"))
    marked = rows.join(broadcast_if_small(hot), same(), "left")  # a row per group_rows rows at most
    rest = marked.where("group_size is null").select(*rows.columns).join(others, same())
    whole = marked.where("group_size is not null").unionByName(rest)
    return whole.withColumn("since", at - F.col("first_at"))


def grouped(transactions: DataFrame, rule: Rule, with_ids: bool = True, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Groups that break an aggregate rule: key columns, n, total (minor units), first_row, first_id, and ids if asked for.

    ids holds a whole group in one row; without it a group of any size is a few numbers.
    With windowDays, only rows within that many days of the group's first count.
    """
    d = rule.definition
    keys = _group_keys(d["groupBy"])
    rows = transactions.withColumns(keys | {"minor": _minor()})
    if d.get("windowDays") is not None:
        rows = _since_first(rows, list(keys), group_rows).where(F.col("since") <= int(d["windowDays"] * 86_400_000_000))
    measured = [F.count("*").alias("n"), F.sum("minor").alias("total"), F.min("row_no").alias("first_row"), F.min(F.struct("row_no", "id"))["id"].alias("first_id")]
    ids = [F.array_sort(F.collect_list(F.struct("row_no", "id")))["id"].alias("ids")] if with_ids else []
    groups = rows.groupBy(*keys).agg(*measured, *ids)
    by_sum = d["metric"] == "sum"
    scale = 100 if by_sum else 1
    upper = d.get("value2")
    return groups.where(compare(F.col("total" if by_sum else "n"), d["op"], round(d["value"] * scale), None if upper is None else round(upper * scale)))


def evaluate(transactions: DataFrame, rules: list[Rule], with_ids: bool = True) -> DataFrame:
    """Findings of all rules: rule, severity, ids (without with_ids only the first), seq. Rules of unknown type find nothing.

    Row rules share one pass: each row explodes to the rules that it breaks.
    """
    row_rules = [r for r in rules if r.definition.get("type") in ROW_RULES]
    broken = F.array_compact(F.array(*(F.when(predicate(r), F.struct(F.lit(r.code).alias("rule"), F.lit(r.severity).alias("severity"))) for r in row_rules)))
    parts = []
    if row_rules:
        parts.append(transactions.select("row_no", "id", F.explode(broken).alias("b")).select("b.rule", "b.severity", F.array("id").alias("ids"), F.col("row_no").alias("seq")))
    for rule in rules:
        if rule.definition.get("type") == "aggregate":
            ids = F.col("ids") if with_ids else F.array("first_id").alias("ids")
            parts.append(grouped(transactions, rule, with_ids).select(F.lit(rule.code).alias("rule"), F.lit(rule.severity).alias("severity"), ids, F.col("first_row").alias("seq")))
    if not parts:
        return transactions.sparkSession.createDataFrame([], "rule string, severity string, ids array<string>, seq long")
    out = parts[0]
    for other in parts[1:]:
        out = out.unionByName(other)
    return out


def in_scope(rules: list[Rule], engagement_id: str) -> list[Rule]:
    """Enabled rules of the engagement or of the whole firm."""
    return [r for r in rules if r.enabled and r.engagement_id in (None, engagement_id)]


def stored(findings: DataFrame) -> DataFrame:
    """Findings as they are stored: rule, severity, score and the first transaction only."""
    scores = F.create_map(*(F.lit(x) for pair in STORED_SCORES.items() for x in pair))
    return findings.select("rule", "severity", F.coalesce(scores[F.col("severity")], F.lit(STORED_SCORES["MEDIUM"])).alias("score"), F.col("ids")[0].alias("transaction_id"))


def replace_open(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored findings after a run: open findings of rules give way to the fresh ones."""
    gone = (F.col("rule_code") == "CUSTOM_RULE") & (F.col("status") == "OPEN")
    return existing.where(~F.coalesce(gone, F.lit(False))).unionByName(fresh, allowMissingColumns=True)


#: Arabic words for operators and fields, and the descriptions of what breaks a rule.
OPERATOR_TEXTS = {"gt": "أكبر من", "gte": "أكبر من أو يساوي", "lt": "أقل من", "lte": "أقل من أو يساوي", "eq": "يساوي", "neq": "لا يساوي", "between": "بين"}
FIELD_TEXTS = {
    "amount": "المبلغ",
    "vatAmount": "ضريبة القيمة المضافة",
    "hour": "ساعة القيد",
    "weekday": "يوم الأسبوع",
    "vatRatioPct": "نسبة الضريبة %",
    "valueVsPostedDays": "الفارق بين تاريخ القيد وتاريخ القيمة (أيام)",
}
RULE_TEXTS = {
    "field_compare": "{reference}: {field} ({actual}) {op} {bound}.",
    "round_amount": "{reference}: مبلغ مُدوَّر ({amount}) بأصفار تتبع لا تقل عن {zeros}.",
    "threshold_avoidance": "{reference}: المبلغ ({amount}) أقل بقليل من حد الاعتماد ({limit}) — قد يشير لتقسيم/التفاف على الحد.",
}


def described(transactions: DataFrame, rule: Rule) -> DataFrame:
    """The transactions that break a row rule, with description_ar where the rule's type has one."""
    d, kind = rule.definition, rule.definition["type"]
    plain = lambda v: str(int(v)) if float(v).is_integer() else repr(float(v))
    values = {"reference": F.col("reference"), "amount": money.from_minor_units(_minor())}
    if kind == "field_compare":
        actual, is_money = _fields()[d["field"]], d["field"] in ("amount", "vatAmount")
        shown = money.from_minor_units(actual) if is_money else F.regexp_replace(rounded_half_up(actual * 100).cast("double").__truediv__(100).cast("string"), r"\.0$", "")
        bound = f"{plain(d['value'])} و {plain(d['value2'])}" if d["op"] == "between" else plain(d["value"])
        values |= {"field": F.lit(FIELD_TEXTS[d["field"]]), "actual": shown, "op": F.lit(OPERATOR_TEXTS[d["op"]]), "bound": F.lit(bound)}
    elif kind == "round_amount":
        values["zeros"] = F.lit(plain(d["minTrailingZeros"]))
    elif kind == "threshold_avoidance":
        values["limit"] = F.lit(plain(d["limit"]))
    text = filled(RULE_TEXTS[kind], values) if kind in RULE_TEXTS else F.lit(None).cast("string")
    return matching(transactions, rule).withColumn("description_ar", text)


#: The starter library.
LIBRARY: tuple[Rule, ...] = (
    Rule("LARGE-ITEMS", "HIGH", {"type": "field_compare", "field": "amount", "op": "gte", "value": 100000}),
    Rule("THRESHOLD-AVOID", "HIGH", {"type": "threshold_avoidance", "limit": 10000, "marginPct": 5}),
    Rule("ROUND-AMOUNTS", "MEDIUM", {"type": "round_amount", "minTrailingZeros": 3}),
    Rule("VAT-UNDER", "MEDIUM", {"type": "field_compare", "field": "vatRatioPct", "op": "lt", "value": 14.5}),
    Rule("OFF-HOURS", "MEDIUM", {"type": "time_window", "mode": "off_hours"}),
    Rule("WEEKEND", "LOW", {"type": "time_window", "mode": "weekend"}),
    Rule("FUTURE-DATE", "HIGH", {"type": "field_compare", "field": "valueVsPostedDays", "op": "lt", "value": 0}),
    Rule("BACKDATED", "MEDIUM", {"type": "field_compare", "field": "valueVsPostedDays", "op": "gt", "value": 30}),
    Rule("MISSING-DOC", "MEDIUM", {"type": "missing_field", "field": "document"}),
    Rule("MISSING-CP", "MEDIUM", {"type": "missing_field", "field": "counterparty"}),
    Rule("DUP-PAYMENTS", "HIGH", {"type": "aggregate", "groupBy": ["amount", "counterparty"], "metric": "count", "op": "gte", "value": 2}),
    Rule("SPLIT-PAY", "HIGH", {"type": "aggregate", "groupBy": ["counterparty"], "metric": "sum", "op": "gte", "value": 50000, "windowDays": 1}),
)

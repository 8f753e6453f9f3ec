"""Statistical and forensic analyzers over a table of transactions.

Transactions: row_no, id, reference, amount decimal(15,2), vat_amount, counterparty, account,
posted_at, value_date, has_document. row_no is the input order and settles every tie.
Findings: code, severity, score, ids (transactions, in order), seq (order within the analyzer).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import money
from ledgerloom.functions.text import filled, key
from ledgerloom.functions.timeparts import local_hour, local_weekday, rounded_hours
from ledgerloom.session import broadcast_if_small, checkpointed

#: 95 % quantile of chi-square with 8 degrees of freedom, and the defaults.
CHI_SQUARE_LIMIT = 15.507
BENFORD_SAMPLE, NEAR_HOURS, VAT_RATE, VAT_TOLERANCE = 50, 72, 0.15, 1
ZONE, OPENS, CLOSES, WEEKEND = "Asia/Riyadh", 7, 19, (5, 6)
#: Rows of a time slot's amount and counterparty that one task compares with each other.
SLOT_ROWS = 10_000
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
#: What a VAT discrepancy is called and how it is described.
VAT_TEXTS = {
    "title": "VAT discrepancy",
    "title_ar": "فرق في ضريبة القيمة المضافة",
    "description": "Declared VAT {declared} does not match the expected {percent}% ({expected}) for reference {reference}; delta {delta}.",
    "description_ar": "ضريبة القيمة المضافة المصرّح بها {declared} لا تطابق المتوقع {percent}% ({expected}) للمرجع {reference}؛ الفرق {delta}.",
}


def severity_rank(severity: Column) -> Column:
    """0 for INFO or unknown, then LOW 1 to CRITICAL 4."""
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity)


def benford_digits(transactions: DataFrame) -> DataFrame:
    """digit, observed, expected, proportion and chi_term of digits 1 to 9, by leading digit of minor units; zeros don't count."""
    digits = transactions.select(money.leading_digit(money.minor_units(F.col("amount"))).alias("digit")).where("digit is not null")
    counted = digits.groupBy("digit").agg(F.count("*").alias("observed"))
    every = transactions.sparkSession.range(1, 10).select(F.col("id").cast("int").alias("digit")).join(F.broadcast(counted), "digit", "left").withColumn("observed", F.coalesce("observed", F.lit(0)))
    total = F.sum("observed").over(Window.partitionBy())  # nine rows
    expected = F.log10(1 + 1 / F.col("digit"))
    return every.select(
        "digit",
        "observed",
        (expected * total).alias("expected"),
        F.when(total > 0, F.col("observed") / total).otherwise(0.0).alias("proportion"),
        F.when(total > 0, (F.col("observed") - expected * total) ** 2 / (expected * total)).otherwise(0.0).alias("chi_term"),
    )


def benford_summary(transactions: DataFrame) -> DataFrame:
    """One row: sample_size, chi_square, rejects, and severity and score of the excess."""
    total = benford_digits(transactions).agg(F.sum("observed").alias("sample_size"), F.sum("chi_term").alias("chi_square"))
    excess = F.col("chi_square") / CHI_SQUARE_LIMIT
    return total.select(
        "sample_size",
        "chi_square",
        (F.col("chi_square") > CHI_SQUARE_LIMIT).alias("rejects"),
        F.when(excess >= 3, "CRITICAL").when(excess >= 2, "HIGH").otherwise("MEDIUM").alias("severity"),
        F.least(F.lit(100), F.floor(40 + 20 * excess + 0.5)).cast("int").alias("score"),
    )


def benford_findings(transactions: DataFrame, least: int = BENFORD_SAMPLE) -> DataFrame:
    """A finding if the distribution is rejected; needs `least` transactions, zeros included."""
    enough = transactions.agg(F.count("*").alias("n")).where(F.col("n") >= least)
    found = benford_summary(transactions).where("rejects").crossJoin(F.broadcast(enough))  # one row each
    return found.select(F.lit("BENFORD").alias("code"), "severity", "score", F.array().cast("array<string>").alias("ids"), F.lit(0).cast("long").alias("seq"))


def keyed(transactions: DataFrame) -> DataFrame:
    """Adds minor, party and ref: the keys that duplicates share."""
    return transactions.withColumns({"minor": money.minor_units(F.col("amount")), "party": key(F.col("counterparty")), "ref": key(F.col("reference"))})


def exact_duplicates(transactions: DataFrame, with_ids: bool = True) -> DataFrame:
    """Groups of two or more of equal amount (not 0), counterparty and reference: minor, party, ref, n, first_row, ids.

    ids holds a whole group in one row; without with_ids only its first, so that a group may be of any size.
    """
    groups = keyed(transactions).where("minor <> 0").groupBy("minor", "party", "ref")
    member = F.struct("row_no", "id")
    members = F.array_sort(F.collect_list(member)) if with_ids else F.array(F.min(member))
    return groups.agg(F.count("*").alias("n"), members.alias("members")).where("n >= 2").select("minor", "party", "ref", "n", F.col("members")[0]["row_no"].alias("first_row"), F.col("members.id").alias("ids"))


def slotted(transactions: DataFrame, hours: int, slot_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows as firsts and as seconds of near duplicates, with slot, part and other_part: what meets shares all three.

    A first stands in its own slot and the next. A slot with more than slot_rows rows is dealt to
    parts by a hash, and each part of its firsts meets each part of its seconds.
    """
    rows = keyed(transactions).where("minor <> 0").select("minor", "party", "ref", "id", "row_no", "posted_at", F.unix_micros("posted_at").alias("at"))
    rows = rows.withColumn("slot", F.floor(F.col("at") / (hours * 3_600_000_000)))
    own = ["minor", "party", "slot"]
    counted = rows.groupBy(*own).count().where(F.col("count") > slot_rows).withColumn("parts", F.ceil(F.col("count") / slot_rows))
    hot = checkpointed(counted.withColumn("slot", F.explode(F.array("slot", F.col("slot") + 1))).groupBy(*own).agg(F.max("parts").alias("parts")))  # two rows per slot_rows rows at most
    first = rows.withColumn("slot", F.explode(F.array(F.col("slot"), F.col("slot") + 1)))
    if hot.isEmpty():
        return tuple(side.withColumns({"part": F.lit(0), "other_part": F.lit(0)}) for side in (first, rows))
    hot = broadcast_if_small(hot)
    sides = []
    for side, mine, theirs in ((first, "part", "other_part"), (rows, "other_part", "part")):
        parts = F.coalesce("parts", F.lit(1)).cast("int")
        dealt = side.join(hot, own, "left").withColumn(mine, F.pmod(F.xxhash64("row_no", "id"), parts).cast("int"))
        sides.append(dealt.withColumn(theirs, F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts"))
    return tuple(sides)


def near_duplicates(transactions: DataFrame, hours: int = NEAR_HOURS, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Pairs of equal amount (not 0) and counterparty, but other references, posted within `hours`: minor, party, first_id, second_id, hours_apart, first_row, second_row.

    Time is cut into slots as long as the window, so a row meets only rows of its own and of the
    next slot, and a full slot is split, so that no task has more than the rows of two parts for
    each pair of parts that it is dealt.
    """
    window = hours * 3_600_000_000
    first, second = slotted(transactions, hours, slot_rows)
    a, b = first.alias("a"), second.alias("b")
    ordered = (F.col("b.at") > F.col("a.at")) | ((F.col("b.at") == F.col("a.at")) & (F.col("b.row_no") > F.col("a.row_no")))
    near = (F.col("b.at") - F.col("a.at")) <= window
    pairs = a.join(b, (F.col("a.minor") == F.col("b.minor")) & (F.col("a.party") == F.col("b.party")) & (F.col("a.slot") == F.col("b.slot")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.other_part") == F.col("b.other_part")) & ordered & near & (F.col("a.ref") != F.col("b.ref")))
    return pairs.select(
        "a.minor",
        "a.party",
        F.col("a.id").alias("first_id"),
        F.col("b.id").alias("second_id"),
        rounded_hours(F.col("b.posted_at"), F.col("a.posted_at")).alias("hours_apart"),
        F.col("a.row_no").alias("first_row"),
        F.col("b.row_no").alias("second_row"),
    )


def weekend_postings(transactions: DataFrame, zone: str = ZONE, weekend: tuple[int, ...] = WEEKEND) -> DataFrame:
    """Transactions posted on a weekend day (Sunday 0), with that weekday."""
    day = local_weekday(F.col("posted_at"), zone)
    return transactions.where(day.isin(*weekend)).withColumn("weekday", day)


def off_hours_postings(transactions: DataFrame, zone: str = ZONE, opens: int = OPENS, closes: int = CLOSES, weekend: tuple[int, ...] = WEEKEND) -> DataFrame:
    """Transactions posted outside [opens, closes) on other days than the weekend, with that hour."""
    hour = local_hour(F.col("posted_at"), zone)
    return transactions.where(~local_weekday(F.col("posted_at"), zone).isin(*weekend) & ((hour < opens) | (hour >= closes))).withColumn("hour", hour)


def _with_vat(transactions: DataFrame, rate: float) -> DataFrame:
    """Adds minor, declared, expected and delta; each a column that the next one reads."""
    both = transactions.withColumns({"minor": money.minor_units(F.col("amount")), "declared": money.minor_units(F.col("vat_amount"))})
    expected = both.withColumn("expected", money.expected_vat(F.col("minor"), rate))
    return expected.withColumn("delta", F.col("declared") - F.col("expected"))


def _vat_is_off(tolerance: int) -> Column:
    return F.col("declared").isNotNull() & (F.col("minor") != 0) & (F.abs("delta") > tolerance)


def vat_discrepancies(transactions: DataFrame, rate: float = VAT_RATE, tolerance: int = VAT_TOLERANCE) -> DataFrame:
    """Transactions whose declared VAT is off by more than `tolerance` minor units: adds expected, delta, severity, score."""
    wrong = _with_vat(transactions, rate).where(_vat_is_off(tolerance)).drop("minor", "declared")
    return wrong.withColumns({"severity": money.vat_severity(F.col("delta"), F.col("expected")), "score": money.vat_score(F.col("delta"), F.col("expected"))})


def vat_texts(transactions: DataFrame, rate: float = VAT_RATE, tolerance: int = VAT_TOLERANCE) -> DataFrame:
    """VAT discrepancies with their title and description, in English and Arabic."""
    shown = lambda c: money.from_minor_units(F.col(c))
    rows = vat_discrepancies(transactions, rate, tolerance)
    declared = money.from_minor_units(F.col("delta") + F.col("expected"))
    percent = f"{rate * 100:g}"
    values = {"declared": declared, "percent": F.lit(percent), "expected": shown("expected"), "reference": F.col("reference"), "delta": shown("delta")}
    titles = {"title": F.lit(VAT_TEXTS["title"]), "title_ar": F.lit(VAT_TEXTS["title_ar"])}
    return rows.withColumns(titles | {name: filled(VAT_TEXTS[name], values) for name in ("description", "description_ar")})


def _row_findings(transactions: DataFrame, vat_rate: float, zone: str, analyzers: tuple[str, ...], tolerance: int = VAT_TOLERANCE) -> DataFrame:
    """Findings of the analyzers that judge a row by itself, in one pass: each row explodes to its findings."""
    rows = _with_vat(transactions.withColumn("local", F.from_utc_timestamp("posted_at", zone)), vat_rate)
    rows = rows.withColumns({"weekday": F.dayofweek("local") - 1, "hour": F.hour("local")})
    weekend = F.col("weekday").isin(*WEEKEND)
    off = ~weekend & ((F.col("hour") < OPENS) | (F.col("hour") >= CLOSES))

    def finding(when: Column, code: str, severity: Column, score: Column, analyzer: int) -> Column:
        return F.when(when, F.struct(F.lit(code).alias("code"), severity.alias("severity"), score.cast("int").alias("score"), F.lit(analyzer).alias("analyzer")))

    found = []
    if "off_hours" in analyzers:
        found += [finding(weekend, "WEEKEND", F.lit("LOW"), F.lit(45), 3), finding(off, "OFF_HOURS", F.lit("MEDIUM"), F.lit(55), 4)]
    if "vat" in analyzers:
        found.append(finding(_vat_is_off(tolerance), "VAT_DISCREPANCY", money.vat_severity(F.col("delta"), F.col("expected")), money.vat_score(F.col("delta"), F.col("expected")), 5))
    each = rows.select("id", "row_no", F.explode(F.array_compact(F.array(*found))).alias("x"))
    return each.select("x.code", "x.severity", "x.score", F.array("id").alias("ids"), F.col("row_no").alias("seq"), "x.analyzer", F.lit(1).alias("n_ids"))


def audit_findings(transactions: DataFrame, vat_rate: float = VAT_RATE, zone: str = ZONE, analyzers: tuple[str, ...] = ("benford", "duplicates", "off_hours", "vat"), with_ids: bool = True) -> DataFrame:
    """Findings of the chosen analyzers: code, severity, score, ids (of exact duplicates only the first, without with_ids), n_ids, analyzer, seq."""
    parts = []
    if "benford" in analyzers:
        parts.append((0, benford_findings(transactions)))
    if "duplicates" in analyzers:
        exact = exact_duplicates(transactions, with_ids).select(F.lit("DUPLICATE").alias("code"), F.lit("HIGH").alias("severity"), F.lit(85).alias("score"), "ids", F.col("first_row").alias("seq"), F.col("n").cast("int").alias("n_ids"))
        near = near_duplicates(transactions).select(F.lit("NEAR_DUPLICATE").alias("code"), F.lit("MEDIUM").alias("severity"), F.lit(65).alias("score"), F.array("first_id", "second_id").alias("ids"), F.col("first_row").alias("seq"))
        parts += [(1, exact), (2, near)]
    marked = [found.withColumns({"analyzer": F.lit(number), "n_ids": F.col("n_ids") if "n_ids" in found.columns else F.size("ids")}) for number, found in parts]
    if {"off_hours", "vat"} & set(analyzers):
        marked.append(_row_findings(transactions, vat_rate, zone, analyzers))
    out = marked[0]
    for other in marked[1:]:
        out = out.unionByName(other)
    return out


def audit_engine(transactions: DataFrame, vat_rate: float = VAT_RATE, zone: str = ZONE, with_ids: bool = True) -> DataFrame:
    """All findings, ranked: score, then severity, then the analyzers' order, then input order."""
    return audit_findings(transactions, vat_rate, zone, with_ids=with_ids).orderBy(F.desc("score"), F.desc(severity_rank(F.col("severity"))), "analyzer", "seq", "ids")

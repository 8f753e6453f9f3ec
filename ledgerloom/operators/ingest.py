"""Import: headers to fields, strict validation of rows, issues, and content hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from ledgerloom.functions import framing, money
from ledgerloom.functions.text import is_blank, trimmed
from ledgerloom.functions.timeparts import parse_date_strict
from ledgerloom.operators.chains import Running, hashed_in_order
from ledgerloom.session import checkpointed

#: Fields of each kind of dataset with their types, required ones, and groups of which one must be there.
FIELDS: dict[str, dict[str, str]] = {
    "GENERAL_LEDGER": {
        "documentNumber": "string", "reference": "string", "accountCode": "string", "accountName": "string",
        "postingDate": "date", "documentDate": "date", "debit": "decimal", "credit": "decimal", "amount": "decimal",
        "currency": "string", "description": "string", "counterparty": "string", "costCenter": "string",
        "profitCenter": "string", "userId": "string", "sourceType": "string",
    },
    "TRIAL_BALANCE": {
        "accountCode": "string", "accountName": "string", "openingDebit": "decimal", "openingCredit": "decimal",
        "periodDebit": "decimal", "periodCredit": "decimal", "closingDebit": "decimal", "closingCredit": "decimal",
        "currency": "string",
    },
    "BANK": {
        "transactionDate": "date", "valueDate": "date", "amount": "decimal", "currency": "string",
        "description": "string", "reference": "string", "counterparty": "string", "bankAccount": "string",
    },
    "OTHER": {},
}
REQUIRED: dict[str, tuple[str, ...]] = {"GENERAL_LEDGER": ("accountCode", "postingDate"), "TRIAL_BALANCE": ("accountCode",), "BANK": ("transactionDate", "amount"), "OTHER": ()}
ONE_OF: dict[str, tuple[str, ...]] = {
    "GENERAL_LEDGER": ("debit", "credit", "amount"),
    "TRIAL_BALANCE": ("openingDebit", "openingCredit", "periodDebit", "periodCredit", "closingDebit", "closingCredit"),
}
#: Header names that suggest a field.
ALIASES: dict[str, dict[str, tuple[str, ...]]] = {
    "GENERAL_LEDGER": {
        "accountCode": ("account", "accountcode", "account code", "gl account", "الحساب", "رقم الحساب"),
        "accountName": ("account name", "اسم الحساب"),
        "postingDate": ("posting date", "postingdate", "date", "التاريخ", "تاريخ القيد"),
        "documentDate": ("document date", "تاريخ المستند"),
        "debit": ("debit", "مدين"),
        "credit": ("credit", "دائن"),
        "amount": ("amount", "المبلغ", "القيمة"),
        "currency": ("currency", "العملة"),
        "description": ("description", "الوصف", "البيان"),
        "counterparty": ("counterparty", "vendor", "الطرف", "الطرف المقابل"),
        "reference": ("reference", "ref", "المرجع"),
        "documentNumber": ("document number", "voucher", "رقم المستند"),
        "costCenter": ("cost center", "مركز التكلفة"),
        "profitCenter": ("profit center", "مركز الربح"),
        "userId": ("user", "userid", "المستخدم"),
        "sourceType": ("source", "المصدر"),
    },
    "TRIAL_BALANCE": {
        "accountCode": ("account", "accountcode", "الحساب", "رقم الحساب"),
        "accountName": ("account name", "اسم الحساب"),
        "openingDebit": ("opening debit", "رصيد افتتاحي مدين"),
        "openingCredit": ("opening credit", "رصيد افتتاحي دائن"),
        "periodDebit": ("period debit", "حركة مدين"),
        "periodCredit": ("period credit", "حركة دائن"),
        "closingDebit": ("closing debit", "رصيد ختامي مدين"),
        "closingCredit": ("closing credit", "رصيد ختامي دائن"),
        "currency": ("currency", "العملة"),
    },
    "BANK": {
        "transactionDate": ("transaction date", "date", "تاريخ العملية", "التاريخ"),
        "valueDate": ("value date", "تاريخ القيمة"),
        "amount": ("amount", "المبلغ"),
        "currency": ("currency", "العملة"),
        "description": ("description", "الوصف"),
        "reference": ("reference", "المرجع"),
        "counterparty": ("counterparty", "الطرف"),
        "bankAccount": ("bank account", "رقم الحساب البنكي"),
    },
    "OTHER": {},
}
ISSUE = "struct<field:string,code:string,raw_value:string>"


def suggest_mapping(kind: str, headers: list[str | None]) -> dict[str, str]:
    """Header to field, for the headers that are an alias of one."""
    known = {alias: field for field, aliases in ALIASES[kind].items() for alias in aliases}
    return {h: known[h.strip().lower()] for h in headers if h and h.strip().lower() in known}


def raw_cells(headers: list[str | None], values: Column) -> Column:
    """Lossless cells (i, h, v) of a row's array of values; empty counts as null, repeated headers stay apart.

    There are as many cells as headers or values, whichever are more.
    """

    def cell(i: Column, header: Column, value: Column) -> Column:
        return F.struct(i.cast("int").alias("i"), header.cast("string").alias("h"), F.when(value != "", value).alias("v"))

    known = F.array(*(cell(F.lit(i), F.lit(h), F.get(values, F.lit(i))) for i, h in enumerate(headers)))
    n = len(headers)
    more = F.transform(F.slice(values, n + 1, F.greatest(F.size(values) - n, F.lit(0))), lambda v, i: cell(i + n, F.lit(None), v))
    return F.when(F.size(values) <= n, known).otherwise(F.concat(known, more))


def apply_mapping(rows: DataFrame, mapping: dict[str, str], cells: str = "cells", headers: list[str | None] | None = None) -> DataFrame:
    """Adds mapped (struct of each field's raw value; the first column of a field wins) and duplicate_issues.

    headers: those of all rows in order, if they are known; then fields are taken by position.
    """
    fields = list(dict.fromkeys(mapping.values()))

    def duplicate(field: Column, value: Column) -> Column:
        return F.struct(field.alias("field"), F.lit("DUPLICATE_SOURCE_COLUMN").alias("code"), value.alias("raw_value"))

    if headers is not None:
        places = [(mapping[h], i) for i, h in enumerate(headers) if h in mapping]
        first = {field: min(i for f, i in places if f == field) for field in fields if any(f == field for f, _ in places)}
        value = lambda i: F.get(cells, F.lit(i))["v"]
        mapped = {field: value(first[field]) if field in first else F.lit(None).cast("string") for field in fields}
        more = [duplicate(F.lit(f), value(i)) for f, i in places if i != first[f]]
        out, issues = rows, F.array(*more) if more else F.array()
    else:
        known = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair)) if mapping else F.create_map().cast("map<string,string>")
        ordered = F.array_sort(cells, lambda a, b: a["i"] - b["i"])
        named = F.filter(F.transform(ordered, lambda c: F.struct(F.try_element_at(known, c["h"]).alias("field"), c["v"].alias("v"))), lambda x: x["field"].isNotNull())
        # each value is marked with whether it is its field's first; `named` and its fields are bound once per row
        marked = let(named, lambda n: let(F.transform(n, lambda x: x["field"]), lambda seen: F.transform(n, lambda x, i: F.struct(x["field"].alias("field"), x["v"].alias("v"), (F.array_position(seen, x["field"]) == i + 1).alias("first")))))
        out = rows.withColumn("marked", marked)
        mapped = {field: F.get(F.filter("marked", lambda x: x["first"] & (x["field"] == field)), F.lit(0))["v"] for field in fields}  # noqa: B023
        issues = F.transform(F.filter("marked", lambda x: ~x["first"]), lambda x: duplicate(x["field"], x["v"]))
    struct = F.struct(*(value.alias(field) for field, value in mapped.items())) if mapped else F.create_map().cast("map<string,string>")
    return out.withColumns({"mapped": struct, "duplicate_issues": issues.cast(f"array<{ISSUE}>")}).drop("marked")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def field_of(rows: DataFrame, column: str, name: str) -> Column:
    """A value of a struct or map column by name; null where it has none."""
    kind = rows.schema[column].dataType
    if isinstance(kind, MapType):
        return F.try_element_at(column, F.lit(name))
    return F.col(column)[name] if name in kind.fieldNames() else F.lit(None).cast("string")


def validate(rows: DataFrame, kind: str, date_order: str = "DMY", mapped: str = "mapped") -> DataFrame:
    """Adds normalized (struct of each field's text, null if rejected), issues and status to rows with a mapped column.

    Amounts are read as binary doubles and rounded to two places, exact ties away from zero;
    those of 10**21 and more are invalid, as they have no plain text of two places.
    """
    fields = FIELDS[kind]
    # every step is a column of its own, so that the next one reads it without evaluating it again
    out = rows.withColumns({f"raw_{f}": field_of(rows, mapped, f) for f in fields}) if fields else rows
    raw = {f: F.col(f"raw_{f}") for f in fields}
    out = out.withColumns({f"there_{f}": ~is_blank(raw[f]) for f in fields}) if fields else out
    there = {f: F.col(f"there_{f}") for f in fields}
    amounts = [f for f, k in fields.items() if k == "decimal"]
    for step, value in (
        ("kept", lambda f: F.when(there[f] & ~raw[f].rlike(money.PLAIN_PATTERN), money.kept_signs(raw[f]))),
        ("number", lambda f: money.double_of(F.col(f"kept_{f}"))),
        ("cents", lambda f: money.exact_cents(F.col(f"number_{f}"))),
    ):
        out = out.withColumns({f"{step}_{f}": value(f) for f in amounts}) if amounts else out
    parse = {
        "date": lambda f: parse_date_strict(raw[f], date_order).cast("string"),
        "decimal": lambda f: F.when(F.col(f"kept_{f}").isNull(), raw[f].cast("decimal(15,2)").cast("string")).otherwise(money.binary_rounded(F.col(f"number_{f}"), F.col(f"cents_{f}"))),
        "string": lambda f: trimmed(raw[f]),
    }
    out = out.withColumns({f"parsed_{f}": F.when(there[f], parse[k](f)) for f, k in fields.items()}) if fields else out
    parsed = {f: F.col(f"parsed_{f}") for f in fields}

    def issue(when: Column, field: str | None, code: str, value: Column) -> Column:
        return F.when(when, F.struct(F.lit(field).cast("string").alias("field"), F.lit(code).alias("code"), value.cast("string").alias("raw_value")))

    codes = {"date": "INVALID_DATE", "decimal": "INVALID_AMOUNT"}
    checks = [issue(there[f] & parsed[f].isNull(), f, codes[k], raw[f]) for f, k in fields.items() if k in codes]
    checks += [issue(~there[f], f, "MISSING_REQUIRED", F.lit(None)) for f in REQUIRED[kind]]
    if kind in ONE_OF:
        none = reduce(lambda a, b: a & b, (parsed[f].isNull() for f in ONE_OF[kind]))
        checks.append(issue(none, None, "MISSING_VALUE_GROUP", F.lit(None)))
    out = out.withColumn("issues", F.array_compact(F.array(*checks)).cast(f"array<{ISSUE}>") if checks else F.array().cast(f"array<{ISSUE}>"))
    status = F.when(F.size("issues") > 0, "REJECTED")
    if "duplicate_issues" in rows.columns:
        status = status.when(F.size("duplicate_issues") > 0, "ACCEPTED_WITH_WARNING")
    normalized = F.struct(*(value.alias(f) for f, value in parsed.items())) if parsed else F.create_map().cast("map<string,string>")
    out = out.withColumns({"normalized": F.when(F.size("issues") == 0, normalized), "status": status.otherwise("ACCEPTED")})
    return out.drop(*(f"{step}_{f}" for step in ("raw", "there", "kept", "number", "cents", "parsed") for f in fields))


def prepare_rows(rows: DataFrame, kind: str, mapping: dict[str, str], date_order: str = "DMY", headers: list[str | None] | None = None) -> DataFrame:
    """Rows (source_row_no, cells) with raw_hash, mapped, normalized, issues and status; headers as in `apply_mapping`."""
    return validate(apply_mapping(rows.withColumn("raw_hash", framing.raw_hash(F.col("cells"))), mapping, headers=headers), kind, date_order)


def counts(prepared: DataFrame) -> DataFrame:
    """One row: total, accepted, rejected, blocking."""
    rejected = F.col("status") == "REJECTED"
    return prepared.agg(F.count("*").alias("total"), F.count_if(~rejected).alias("accepted"), F.count_if(rejected).alias("rejected"), F.coalesce(F.sum(F.size("issues")), F.lit(0)).alias("blocking"))


def issue_rows(prepared: DataFrame) -> DataFrame:
    """One row per issue: source_row_no, field, code, raw_value."""
    return prepared.select("source_row_no", F.explode(F.concat("issues", "duplicate_issues")).alias("x")).select("source_row_no", "x.field", "x.code", "x.raw_value")


def accepted_rows(prepared: DataFrame) -> DataFrame:
    """Rows that aren't rejected.

    The status is read from a generator: a filter on the column itself is put before the steps of
    `validate`, each written into the next one, which makes a condition of many megabytes.
    """
    return prepared.withColumn("status_read", F.explode(F.array("status"))).where("status_read <> 'REJECTED'").drop("status_read")


def to_transactions(prepared: DataFrame, kind: str) -> DataFrame:
    """Flat transactions of accepted ledger or bank rows; other kinds have none."""
    field = lambda name: field_of(prepared, "normalized", name)
    accepted = accepted_rows(prepared)
    if kind == "GENERAL_LEDGER":
        amount, credit = F.coalesce(field("debit"), field("credit"), field("amount")), field("credit").isNotNull() & field("debit").isNull()
        reference = F.coalesce(field("reference"), field("documentNumber"), F.concat(F.lit("R-"), F.col("source_row_no").cast("string")))
        posted, value = field("postingDate"), field("documentDate")
    elif kind == "BANK":
        amount, credit = field("amount"), field("amount").cast("decimal(28,2)") > 0
        reference = F.coalesce(field("reference"), F.concat(F.lit("B-"), F.col("source_row_no").cast("string")))
        posted, value = field("transactionDate"), field("valueDate")
    else:
        accepted = accepted.limit(0)
        amount = credit = reference = posted = value = F.lit(None).cast("string")
        credit = F.lit(False)
    return accepted.select("source_row_no", reference.alias("reference"), F.abs(amount.cast("decimal(15,2)")).alias("amount"), F.when(credit, "CREDIT").otherwise("DEBIT").alias("type"), F.coalesce(field("currency"), F.lit("SAR")).alias("currency"), field("counterparty").alias("counterparty"), field("accountCode").alias("account"), posted.cast("timestamp").alias("posted_at"), value.cast("timestamp").alias("value_date"))


# Hashes of configuration: a handful of strings each, framed on the driver.


def _leb128(n: int) -> bytes:
    out = bytearray()
    while True:
        n, low = n >> 7, n & 0x7F
        out.append(low | (0x80 if n else 0))
        if not n:
            return bytes(out)


def frame(value: str | None) -> bytes:
    """Frame of a string, as the column expression of the same name gives it."""
    return b"\x00" if value is None else b"\x01" + _leb128(len(data := value.encode())) + data


def _object(values: dict[str, str | None]) -> bytes:
    ordered = sorted(values.items(), key=lambda x: x[0].encode("utf-16-be"))
    return _leb128(len(ordered)) + b"".join(frame(k) + frame(v) for k, v in ordered)


def profile_hash(profile: dict[str, str | None]) -> str:
    """Identity of an effective parse profile."""
    return hashlib.sha256(_object(profile)).hexdigest()


def mapping_hash(kind: str, mapping: dict[str, str], field_set_version: str = "g2.1") -> str:
    """Identity of a header mapping."""
    return hashlib.sha256(_object({"datasetKind": kind, "targetFieldSetVersion": field_set_version}) + _object(mapping)).hexdigest()


def dataset_hash(rows: DataFrame, header: dict[str, str | None], by: tuple[str, ...] = (), is_stored: bool = False) -> DataFrame:
    """Identity of datasets' content: `header`, the number of rows, and raw_hash of every row in order of source_row_no.

    rows: the `by` columns, source_row_no, raw_hash. Rows are streamed, so a dataset may be of any
    size; one without rows has no row here, its hash is `empty_dataset_hash`. is_stored: as in
    `hashed_in_order`.
    """
    hashed = hashed_in_order(rows, by, "raw_hash", Running, lambda n: _object(header) + _leb128(n), is_stored)
    return hashed.select(*by, F.col("hashed").alias("dataset_hash"), "n_rows")


def empty_dataset_hash(header: dict[str, str | None]) -> str:
    """Identity of a dataset without rows."""
    return hashlib.sha256(_object(header) + _leb128(0)).hexdigest()


def content_numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds source_row_no, 1 to n in order of the given columns: by ranges, so that no task sorts all rows."""
    parts = rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    parts = checkpointed(parts)  # range bounds come from a sample: both uses below must see the same ones
    parts = parts.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    before = parts.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n"))  # one row per partition
    return parts.join(F.broadcast(before.select("part", "before")), "part").withColumn("source_row_no", (F.col("before") + F.col("at")).cast("long")).drop("part", "at", "before")

"""Money as column expressions: exact decimals and integer minor units, never floats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import trimmed

MINOR_PATTERN = r"^-?[0-9]+(\.[0-9]{1,2})?$"
#: Amounts that a double holds closely enough for two places to stay as they are written.
PLAIN_PATTERN = r"^-?[0-9]{1,13}(\.[0-9]{1,2})?\z"
CANONICAL_PATTERN = r"^-?[0-9]+(\.[0-9]+)?\z"
_CANONICAL_ALREADY = r"^(-?[1-9][0-9]*(\.[0-9]+)?|0(\.[0-9]+)?)\z"
_ARABIC_INDIC = "٠١٢٣٤٥٦٧٨٩"


def minor_units(amount: Column) -> Column:
    """Minor units of a decimal with two places."""
    return (amount.cast("decimal(15,2)") * 100).cast("long")


def parse_minor_units(text: Column) -> Column:
    """Minor units of a decimal string; anything but digits with up to two places raises."""
    clean = trimmed(text)
    return F.when(clean.rlike(MINOR_PATTERN), (clean.try_cast("decimal(17,2)") * 100).cast("long")).when(text.isNotNull(), F.raise_error(F.concat(F.lit("not an amount: "), text)).cast("long"))


def from_minor_units(minor: Column) -> Column:
    """Minor units as text with two places."""
    return (minor.cast("decimal(20,0)") / 100).cast("decimal(20,2)").cast("string")


def leading_digit(minor: Column) -> Column:
    """Most significant digit of |minor|; null for 0."""
    return F.when(minor != 0, F.substring(F.abs(minor).cast("string"), 1, 1).cast("int"))


def expected_vat(minor: Column, rate: float) -> Column:
    """VAT in minor units, halves away from zero, in integer arithmetic at basis-point precision."""
    points = round(rate * 10_000)
    doubled = F.abs(minor * points) + 5_000
    return F.when(minor < 0, -1).otherwise(1) * (doubled - doubled % 10_000).cast("decimal(20,0)").__truediv__(10_000).cast("long")


def vat_severity(delta: Column, expected: Column) -> Column:
    relative = F.abs(delta) / F.greatest(F.abs(expected), F.lit(1))
    return F.when(relative >= 0.5, "CRITICAL").when(relative >= 0.1, "HIGH").otherwise("MEDIUM")


def vat_score(delta: Column, expected: Column) -> Column:
    relative = F.abs(delta) / F.greatest(F.abs(expected), F.lit(1))
    return F.least(F.lit(100), F.floor(60 + 60 * relative + 0.5)).cast("int")


def kept_signs(text: Column) -> Column:
    """Digits, points and minus signs of an amount as written, Arabic digits as Western ones."""
    return F.regexp_replace(F.translate(text, _ARABIC_INDIC, "0123456789"), r"[^0-9.\-]", "")


def canonical_decimal(text: Column) -> Column:
    """Canonical form of a decimal as written: Arabic digits, grouping marks and units are dropped, no rounding; null if none is left."""
    kept = kept_signs(text)
    body = F.regexp_replace(F.regexp_replace(kept, "^-", ""), r"^0+(?=[0-9])", "")
    negative = kept.startswith("-") & body.rlike("[1-9]")
    cleaned = F.when(kept.rlike(CANONICAL_PATTERN), F.concat(F.when(negative, "-").otherwise(""), body))
    return F.when(text.rlike(_CANONICAL_ALREADY), text).otherwise(cleaned)


def micros(text: Column) -> Column:
    """Canonical decimal with six places, halves away from zero; a value beyond 18 digits raises."""
    return canonical_decimal(text).cast("decimal(24,6)")


def canon_amount(amount: Column) -> Column:
    """Text with six places, so that 50 and 50.00 are equal."""
    return amount.cast("decimal(24,6)").cast("string")


def double_of(kept: Column) -> Column:
    """The nearest double of what `kept_signs` leaves; null if that is no number."""
    return F.when(kept.rlike(CANONICAL_PATTERN), kept.cast("double"))


def exact_cents(number: Column) -> Column:
    """Hundredths (0 to 100) of a double's fraction, by its exact value, ties away from zero.

    Every step is exact: the fraction is cut at 2**-30, and a hundred times either part has
    at most 53 bits. So 1.005, which as a double lies below it, has none.
    """
    fraction = F.abs(number) - F.floor(F.abs(number))
    high = F.floor(fraction * (1 << 30)) / F.lit(float(1 << 30))
    whole = F.floor(high * 100)
    return whole + F.when((fraction - high) * 100 >= 0.5 - (high * 100 - whole), 1).otherwise(0)


def binary_rounded(number: Column, cents: Column) -> Column:
    """Two-place text of a double and its `exact_cents`; null from 10**21 on."""
    size, sign = F.abs(number), F.when(number < 0, "-").otherwise("")
    small = F.concat(sign, (F.floor(size) + F.when(cents == 100, 1).otherwise(0)).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    upper = F.floor(size / float(1 << 32))
    whole = upper.cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(11,0)") + (size - upper * float(1 << 32)).cast("decimal(20,0)")
    large = F.concat(sign, whole.cast("decimal(22,0)").cast("string"), F.lit(".00"))
    return F.when(size < float(1 << 53), small).when(size < 1e21, large)


def float_rounded(text: Column) -> Column:
    """Two-place text of an amount read as a binary double, as the import's strict parser gives it; null if not a number."""
    return F.transform(F.array(double_of(kept_signs(text))), lambda n: binary_rounded(n, exact_cents(n)))[0]


def single_sided(debit: Column, credit: Column) -> Column:
    """The one positive side, if the other is null or zero."""
    none = lambda c: F.coalesce(c, F.lit(0)) == 0
    return F.when((debit > 0) & none(credit), debit).when((credit > 0) & none(debit), credit)


def transaction_sides(debit: Column, credit: Column, amount: Column, convention: str | None) -> tuple[Column, Column]:
    """Debit and credit: as given, else the signed amount split by the frozen convention, else neither.

    convention: POSITIVE_DEBIT_NEGATIVE_CREDIT, POSITIVE_CREDIT_NEGATIVE_DEBIT or None.
    """
    given = debit.isNotNull() | credit.isNotNull()
    none = F.lit(None).cast("decimal(24,6)")
    if convention is None:
        return F.when(given, debit).otherwise(none), F.when(given, credit).otherwise(none)
    plus, minus = F.when(amount >= 0, amount), F.when(amount < 0, -amount)
    to_debit, to_credit = (plus, minus) if convention == "POSITIVE_DEBIT_NEGATIVE_CREDIT" else (minus, plus)
    return F.when(given, debit).otherwise(to_debit), F.when(given, credit).otherwise(to_credit)


def vat_ratio_pct(minor: Column, vat_minor: Column) -> Column:
    """VAT as a percentage of the amount, a double; null without VAT or for amount 0."""
    return F.when((minor != 0) & vat_minor.isNotNull(), vat_minor.cast("double") / minor.cast("double") * 100)


def rounded_half_up(value: Column) -> Column:
    """Nearest integer, halves towards plus infinity."""
    return F.floor(value + 0.5)

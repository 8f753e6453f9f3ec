"""Dates and wall-clock parts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import BLANKS

#: The date forms that are read, year first and year last.
_YEAR_FIRST = r"((?!00)\d{4})[-/.](\d{1,2})[-/.](\d{1,2})"
_YEAR_LAST = r"(\d{1,2})[-/.](\d{1,2})[-/.]((?!00)\d{4})"

_DAY_MICROS, _HOUR_MICROS = 86_400_000_000, 3_600_000_000


def local_hour(instant: Column, zone: str) -> Column:
    """Hour of the day (0 to 23) in a time zone."""
    return F.hour(F.from_utc_timestamp(instant, zone))


def local_weekday(instant: Column, zone: str) -> Column:
    """Day of the week in a time zone, Sunday 0."""
    return F.dayofweek(F.from_utc_timestamp(instant, zone)) - 1


def days_between(later: Column, earlier: Column) -> Column:
    """Days as a fraction."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / _DAY_MICROS


def rounded_days(later: Column, earlier: Column) -> Column:
    """Whole days, halves towards plus infinity; null if either is."""
    return F.floor(days_between(later, earlier) + 0.5).cast("int")


def rounded_hours(later: Column, earlier: Column) -> Column:
    """Whole hours, halves towards plus infinity."""
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / _HOUR_MICROS + 0.5).cast("int")


def parse_date_strict(text: Column, order: str = "DMY") -> Column:
    """Date of `Y-M-D`, or of `D-M-Y` (`M-D-Y` if order is MDY), with -, / or . between; null if there is no such day."""
    around = lambda body: f"^[{BLANKS}]*{body}[{BLANKS}]*$"
    first, second = around(_YEAR_FIRST), around(_YEAR_LAST)
    back = "$3-$1-$2" if order == "MDY" else "$3-$2-$1"
    return F.when(text.rlike(second), F.regexp_replace(text, second, back)).when(text.rlike(first), F.regexp_replace(text, first, "$1-$2-$3")).try_cast("date")

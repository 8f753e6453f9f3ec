"""Text keys and searches as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that trimming drops, beyond ASCII too.
BLANKS = r"\s   -     　﻿"


def trimmed(text: Column) -> Column:
    """`text` without white space of any kind at its ends."""
    return F.regexp_replace(text, f"^[{BLANKS}]+|[{BLANKS}]+$", "")


def key(text: Column) -> Column:
    """Comparison key: trimmed and lower-cased, null as empty."""
    return F.lower(trimmed(F.coalesce(text, F.lit(""))))


def is_blank(text: Column) -> Column:
    """Null, or nothing but white space."""
    return ~F.coalesce(text.rlike(f"[^{BLANKS}]"), F.lit(False))


def holds(needle: str, *columns: Column) -> Column:
    """Whether the columns, joined by a space, hold `needle` in any case."""
    return F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(needle.lower()))


def any_holds(needle: str, *columns: Column) -> Column:
    """Whether one of the columns holds `needle` in any case."""
    found = F.lit(False)
    for column in columns:
        found = found | F.coalesce(F.contains(F.lower(column), F.lit(needle.lower())), F.lit(False))
    return found


def filled(template: str, values: dict[str, Column]) -> Column:
    """`template` with each {name} replaced by that value as text; null counts as empty."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(F.lit(p) if i % 2 == 0 else F.coalesce(values[p].cast("string"), F.lit("")) for i, p in enumerate(parts)))

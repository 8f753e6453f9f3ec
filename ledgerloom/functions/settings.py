"""Firm settings as stored JSON: every value of the wrong kind gives way to its default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The defaults.
VAT_PERCENT, OPENS, CLOSES, WEEKEND, ZONE = 15.0, 7.0, 19.0, (5.0, 6.0), "Asia/Riyadh"


def firm_settings(stored: Column) -> Column:
    """struct<vat_rate_pct, opens, closes, weekend, zone> of a JSON text; null or no JSON gives the defaults."""
    parsed = F.try_parse_json(stored)

    def part(name: str) -> Column:
        return F.try_variant_get(parsed, f"$.{name}", "variant")

    def number(value: Column) -> Column:
        return F.when(F.schema_of_variant(value).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(value, "$", "double"))

    days = F.try_variant_get(parsed, "$.weekendDays", "array<variant>")
    zone = part("timeZone")
    text = F.when(F.schema_of_variant(zone) == "STRING", F.try_variant_get(zone, "$", "string"))
    return F.struct(
        F.coalesce(number(part("vatRatePct")), F.lit(VAT_PERCENT)).alias("vat_rate_pct"),
        F.coalesce(number(part("businessStartHour")), F.lit(OPENS)).alias("opens"),
        F.coalesce(number(part("businessEndHour")), F.lit(CLOSES)).alias("closes"),
        F.coalesce(F.array_compact(F.transform(days, number)), F.array(*map(F.lit, WEEKEND))).alias("weekend"),
        F.coalesce(F.nullif(text, F.lit("")), F.lit(ZONE)).alias("zone"),
    )

"""Groups that hold much of a table are split, and the results stay those of brute force."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.operators import analyzers, rules

TX = "row_no long, id string, reference string, amount decimal(15,2), vat_amount decimal(15,2), counterparty string, account string, posted_at timestamp, value_date timestamp, has_document boolean"


def transactions(spark, n, hot=0.5):
    draw = random.Random(8)
    start = datetime(2025, 1, 1)
    rows = []
    for i in range(n):
        common = draw.random() < hot
        at = start + timedelta(hours=draw.randint(0, 100 if common else 900))
        rows.append((i, f"t{i}", f"r{draw.randint(0, 40)}", Decimal("5.00") if common else Decimal(draw.randint(100, 300)) / 100, None, None if common else draw.choice("abc"), "acc", at, None, None))
    return rows, spark.createDataFrame(rows, TX)


def test_near_duplicates_of_a_hot_slot_are_split(spark):
    rows, df = transactions(spark, 400)
    found = sorted((r.first_row, r.second_row) for r in analyzers.near_duplicates(df, slot_rows=20).collect())
    expected = []
    for a in rows:
        for b in rows:
            same = a[3] == b[3] and (a[5] or "") == (b[5] or "") and a[2] != b[2]
            if same and (a[7], a[0]) < (b[7], b[0]) and b[7] - a[7] <= timedelta(hours=72):
                expected.append((a[0], b[0]))
    assert found == sorted(expected) and len(found) > 5_000
    assert found == sorted((r.first_row, r.second_row) for r in analyzers.near_duplicates(df).collect())


def test_no_pair_of_parts_has_much_more_than_its_share(spark):
    _, df = transactions(spark, 20_000)
    for side in analyzers.slotted(df, 72, 500):
        sizes = sorted(r["count"] for r in side.groupBy("minor", "party", "slot", "part", "other_part").count().collect())
        hot = [n for n in sizes if n > 250]
        assert hot and hot[-1] < 2 * hot[len(hot) // 2]


def test_a_window_from_the_first_row_sorts_no_group(spark):
    rows, df = transactions(spark, 3_000)
    rule = rules.Rule("R", "HIGH", {"type": "aggregate", "groupBy": ["counterparty", "amount"], "metric": "count", "op": "gte", "value": 2, "windowDays": 2})
    key = lambda found: sorted((r.key_counterparty, r.key_amount, r.n, r.total, r.first_row) for r in found.collect())
    groups = {}
    for r in rows:
        groups.setdefault((r[5] or "", int(r[3] * 100)), []).append(r)
    expected = []
    for (party, minor), own in groups.items():
        first = min(r[7] for r in own)
        inside = [r for r in own if r[7] - first <= timedelta(days=2)]
        if len(inside) >= 2:
            expected.append((party, minor, len(inside), minor * len(inside), min(r[0] for r in inside)))
    for group_rows in (100_000, 50):
        found = rules.grouped(df, rule, with_ids=False, group_rows=group_rows)
        assert key(found) == sorted(expected)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan
    assert rules.grouped(df.where(F.lit(False)), rule).count() == 0

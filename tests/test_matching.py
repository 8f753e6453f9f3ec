"""Matching by blocks gives the greedy choice over all pairs, without a table of them."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from ledgerloom.operators import reconcile

REC = "idx long, id string, reference string, amount decimal(15,2), counterparty string, value_date timestamp"


def records(spark, draw, n, cents, days, refs, parties):
    at = lambda: datetime(2025, 1, 1) + timedelta(days=draw.randint(0, days))
    return spark.createDataFrame([(i, f"x{i}", draw.choice(refs), Decimal(draw.randint(1, cents)) / 100, draw.choice(parties), at()) for i in range(n)], REC)


def greedy(pairs):
    sources, targets, taken = set(), set(), []
    for r in sorted(pairs, key=lambda r: (-r.confidence, r.source_idx, r.target_idx)):
        if r.source_idx not in sources and r.target_idx not in targets:
            sources.add(r.source_idx)
            targets.add(r.target_idx)
            taken.append((r.source_idx, r.target_idx, r.delta, r.days, r.confidence))
    return sorted(taken)


@pytest.mark.parametrize(
    "cents, days, tolerance, least, refs, parties",
    [(20, 30, 0, 0.5, ["", "a", "b"], ["", "p", "q"]), (3000, 60, 20, 0.7, [""], ["", "p", "q"]), (40, 300, 20, 0.5, ["r"], [""])],
)
def test_blocks_of_any_size_give_the_greedy_choice(spark, cents, days, tolerance, least, refs, parties):
    draw = random.Random(cents)
    source, target = (records(spark, draw, n, cents, days, refs, parties) for n in (400, 450))
    settings = reconcile.Settings(5, tolerance, least)
    expected = greedy(reconcile.candidates(source, target, settings).collect())
    for most_pairs in (1_000_000, 600, 0):
        found = reconcile.matched(source, target, settings, most_pairs).collect()
        assert sorted((r.source_idx, r.target_idx, r.delta, r.days, r.confidence) for r in found) == expected


def test_copies_are_matched_without_their_pairs(spark, monkeypatch):
    """Four million pairs of equal records on each of two days: by rank, and no pair is made a row."""
    monkeypatch.setattr(reconcile, "candidates", lambda *_: pytest.fail("all pairs were made"))
    n = 2_000
    side = lambda n: spark.createDataFrame([(i, f"x{i}", "", Decimal(5), "", datetime(2025, 1, 1 + i % 2)) for i in range(n)], REC)
    found = reconcile.reconcile(side(n), side(n + 10), reconcile.Settings(5, 3)).collect()
    assert sorted((int(r.source_id[1:]), int(r.target_id[1:])) for r in found) == [(i, i) for i in range(n)]


def test_empty_sides_and_missing_values(spark):
    rows = spark.createDataFrame([(1, "a", "", Decimal(5), "", None), (2, "b", "", None, "", datetime(2025, 1, 1)), (3, "c", None, Decimal(5), None, datetime(2025, 1, 1))], REC)
    assert reconcile.matched(rows, rows.limit(0), reconcile.Settings()).count() == 0
    assert [(r.source_id, r.target_id) for r in reconcile.matched(rows, rows, reconcile.Settings()).collect()] == [("c", "c")]

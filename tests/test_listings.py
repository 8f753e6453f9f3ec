"""Who sees what in listings, pages that go on, and identities of whole runs."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import lifecycle, listings, preparation

ASKS = "firm_id string, user_id string, engagement_id string"


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@pytest.fixture
def firm(spark):
    engagements = spark.createDataFrame([("f", "e1"), ("f", "e2"), ("g", "e3"), ("f", "e1")], "firm_id string, engagement_id string")
    members = spark.createDataFrame([("e1", "u"), ("e1", "u"), ("e3", "u"), (None, "u")], "engagement_id string, user_id string")
    return engagements, members


def test_access(spark, firm):
    asks = spark.createDataFrame([("f", "u", "e1"), ("f", "u", "e1"), ("f", "u", "e2"), ("f", "u", "e3"), ("f", None, "e1"), ("f", "u", None)], ASKS)
    judged = listings.engagement_access(asks, *firm)
    assert rows_of(judged, "user_id", "engagement_id", "access") == [("u", "e1", "GRANTED"), ("u", "e2", "FORBIDDEN"), ("u", "e3", "NOT_FOUND"), ("u", None, "NOT_FOUND"), (None, "e1", "FORBIDDEN")]
    runs = spark.createDataFrame([("f", "r1", "e1"), ("g", "r1", "e3"), ("f", "r2", None)], "firm_id string, run_id string, engagement_id string")
    asked = spark.createDataFrame([("f", "u", r) for r in ("r1", "r2", "r3", None)], "firm_id string, user_id string, run_id string")
    assert rows_of(listings.run_access(asked, runs, *firm), "run_id", "engagement_id", "access") == [("r1", "e1", "GRANTED"), ("r2", None, "NOT_FOUND"), ("r3", None, "NOT_FOUND"), (None, None, "NOT_FOUND")]
    assert listings.engagement_access(asks.limit(0), *firm).count() == 0


def test_runs_carry_extra_columns_and_only_granted_ones(spark, firm):
    judged = listings.engagement_access(spark.createDataFrame([("f", "u", "e1"), ("f", "u", "e2")], ASKS), *firm)
    runs = spark.createDataFrame([("f", e, f"{e}-{i}", i // 2, "label") for e in ("e1", "e2") for i in range(6)], "firm_id string, engagement_id string, run_id string, created_at long, access string")
    assert rows_of(listings.runs_listed(judged, runs, 3), "place", "run_id", "access") == [(1, "e1-4", "label"), (2, "e1-5", "label"), (3, "e1-2", "label")]
    assert "WindowGroupLimit" in listings.runs_listed(judged, runs)._jdf.queryExecution().executedPlan().toString()


def test_pages_go_on_over_ties(spark):
    judged = spark.createDataFrame([("f", "u", "r", "GRANTED"), ("f", "w", "r", "FORBIDDEN")], "firm_id string, user_id string, run_id string, access string")
    results = spark.createDataFrame([("f", "r", "same" if i < 7 else f"z{i}", f"{i:02}") for i in range(10)], "firm_id string, run_id string, semantic_fingerprint string, result_id string")
    seen, after = [], None
    while (page := listings.results_listed(judged, results, after, 3).orderBy("place").collect()) and len(seen) < 20:
        seen += [r.result_id for r in page]
        after = spark.createDataFrame([page[-1]]).drop("place")
    assert seen == [f"{i:02}" for i in range(10)]
    assert listings.results_listed(judged, results, most=0).count() == 1


def test_keyset_pages_hold_every_row_once(spark):
    rows = spark.createDataFrame([(a, b) for a in (None, 1, 2) for b in (None, "x", "y")], "a int, b string")
    seen, after = [], None
    while page := listings.page(rows, ["a", "b"], after, 2).collect():
        seen += map(tuple, page)
        after = tuple(page[-1])
    assert seen == [tuple(r) for r in rows.orderBy("a", "b").collect()]
    with pytest.raises(ValueError):
        listings.page(rows, ["a", "b"], (1,), 2)


def test_evidence_without_record_or_number(spark):
    judged = spark.createDataFrame([("f", "u", "r", "GRANTED")], "firm_id string, user_id string, run_id string, access string")
    results = spark.createDataFrame([("f", "r", "x")], "firm_id string, run_id string, result_id string")
    evidence = spark.createDataFrame(
        [("e1", "x", "T", None, None, None, None), ("e2", "x", "T", 5, "rec", None, None), ("e3", "x", "T", 5, None, "line", None), ("e4", "x", "T", 1, None, None, "gone")],
        "evidence_id string, result_id string, evidence_type string, source_row_no long, record_id string, line_id string, balance_id string",
    )
    lines = spark.createDataFrame([("line", "rec")], "line_id string, record_id string")
    balances = spark.createDataFrame([], "balance_id string, record_id string")
    records = spark.createDataFrame([("rec", [(1, "b", None), (0, None, "v")])], "record_id string, cells array<struct<i:int,h:string,v:string>>")
    found = listings.evidence_listed(judged, results, evidence, lines, balances, records).orderBy("place").collect()
    assert [(r.evidence_id, r.traced_id) for r in found] == [("e4", None), ("e2", "rec"), ("e3", "rec"), ("e1", None)]
    assert found[0].cells is None and [tuple(c) for c in found[1].cells] == [("", "v"), ("b", None)]


def test_configurations_equal_those_of_the_driver(spark):
    datasets = [{"datasetHash": h, "datasetKind": "BANK", "lineageClass": None} for h in ("h2", "h1")]
    tests = [{"testKey": k, "version": 1, "versionHash": "v", "ruleKey": None, "ruleVersion": None, "ruleVersionHash": None, "effectiveParametersHash": "p"} for k in ("b", "a")]
    resolutions = [{"testKey": t["testKey"], "datasetHash": d["datasetHash"], "eligibility": "ELIGIBLE", "resolutionAlgorithmVersion": 1, "eligiblePopulationFingerprint": None} for t in tests for d in datasets]
    mappings = ["m" * 200, "a", "a"]

    def table(rows, kinds):
        return spark.createDataFrame([("r", *row.values()) for row in rows], f"run_id string, {kinds}")

    found = preparation.configurations(
        spark.createDataFrame([("r", "anchor", "build", None, "risk"), ("empty", None, "build", None, None)], "run_id string, anchor string, build string, materiality string, risk_model string"),
        table(datasets, "datasetHash string, datasetKind string, lineageClass string"),
        table(tests, "testKey string, version int, versionHash string, ruleKey string, ruleVersion string, ruleVersionHash string, effectiveParametersHash string"),
        table(resolutions, "testKey string, datasetHash string, eligibility string, resolutionAlgorithmVersion int, eligiblePopulationFingerprint string"),
        spark.createDataFrame([("r", m) for m in mappings], "run_id string, mapping_hash string"),
    )
    expected = {"r": lifecycle.config_fingerprint("anchor", datasets, tests, resolutions, mappings, "build", None, "risk"), "empty": lifecycle.config_fingerprint(None, [], [], [], [], "build")}
    assert {r.run_id: r.config_hash for r in found.collect()} == expected


def test_manifests_equal_the_seal(spark):
    resolutions = spark.createDataFrame([("r", "2", "ELIGIBLE", "f2"), ("r", "1", "DEGRADED", "f1"), ("r", "3", "NOT_ELIGIBLE", None), ("left", "1", "ELIGIBLE", None)], "run_id string, resolution_id string, eligibility string, fingerprint string")
    prepared = spark.createDataFrame([("r", "b"), ("left", "b"), ("bare", ""), ("none", None)], "run_id string, build string").withColumns({c: F.lit(i) for i, c in enumerate(preparation.COUNTED)})
    found = {r.run_id: r for r in preparation.manifests(prepared, resolutions).collect()}
    sealed = preparation.seal(resolutions.where("run_id = 'r'"), {c: i for i, c in enumerate(preparation.COUNTED)}, "b")
    assert found["r"].manifest_hash == sealed["hash"] and found["r"].problem is None
    assert (found["left"].manifest_hash, found["left"].problem) == (None, "1 resolutions without a fingerprint")
    assert {found[n].problem for n in ("bare", "none")} == {"no build identity"}

"""A firm's stored tables, the event push and the stub parser."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import objects, storage
from ledgerloom.streaming import push

ROW = "firm_id string, scope string, document_id string, id long"


@pytest.fixture
def firms(spark, tmp_path):
    """Two firms with transactions of three datasets each; ids look like numbers."""
    root = str(tmp_path / "tables")
    catalogs = {f: storage.Catalog(spark, root, f) for f in ("007", "7")}
    for f, c in catalogs.items():
        c.append("transactions", spark.createDataFrame([(f, f"d/{i % 3}", f"doc{i % 4}", i) for i in range(24)], ROW))
    return catalogs


def ids(df):
    return sorted(r.id for r in df.collect())


def test_reads_are_of_the_firm_by_partition(firms):
    own = firms["007"].read("transactions")
    assert own.count() == 24 and {r.firm_id for r in own.select("firm_id").distinct().collect()} == {"007"}
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(firm_id" in plan and "firm_id#" in plan.split("PartitionFilters")[1]
    assert {p.split("firm_id=")[1][:4] for p in own.inputFiles() if "firm_id=007" in p} == {"007/"}
    assert firms["7"].sql("SELECT count(*) AS n, min(firm_id) AS f FROM transactions WHERE scope = 'd/1'").first()[:] == (8, "7")


def test_what_is_not_the_firms_is_refused(spark, firms, tmp_path):
    own = firms["7"]
    with pytest.raises(PermissionError):
        storage.Catalog(spark, "x", "")
    with pytest.raises(PermissionError):
        own.read("secrets")
    for query in (f"SELECT * FROM parquet.`{own.root}/transactions`", "SELECT * FROM others"):
        with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND|UNSUPPORTED|cannot be found"):
            own.sql(query)
    spark.createDataFrame([(1,)], "id int").createOrReplaceTempView("of_another_session")
    with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND"):
        own.sql("SELECT * FROM of_another_session")
    for write in (own.append, own.replace):
        for firm in ("007", None):
            with pytest.raises(Exception, match="another firm"):
                write("transactions", spark.createDataFrame([("7", "d/0", "x", 1), (firm, "d/0", "x", 2)], ROW))
    assert ids(own.read("transactions")) == list(range(24)) and ids(firms["007"].read("transactions")) == list(range(24))


def test_replacing_touches_its_partitions_only(spark, firms):
    firms["7"].replace("transactions", spark.createDataFrame([("7", "d/0", "new", 100)], ROW))
    assert ids(firms["7"].read("transactions")) == sorted([100, *(i for i in range(24) if i % 3)])
    assert ids(firms["007"].read("transactions")) == list(range(24))


def test_a_dataset_goes_with_all_that_is_its(spark, firms):
    own, runs = firms["7"], spark.createDataFrame([("7", "d/1"), ("007", "d/0")], "firm_id string, dataset_id string")
    for name in ("records", "evidence"):
        own.append(name, spark.createDataFrame([("7", f"d/{i % 3}", None, i) for i in range(6)], ROW))
    with pytest.raises(ValueError, match="used in a run"):
        own.delete_dataset("d/1", runs)
    assert sorted(own.delete_dataset("d/0", runs)) == ["evidence", "records", "transactions"]
    assert own.delete_dataset("d/0", runs) == []
    assert ids(own.read("records")) == [1, 2, 4, 5] and own.read("transactions").where("scope = 'd/0'").isEmpty()
    assert ids(firms["007"].read("transactions")) == list(range(24))


def test_a_document_goes_with_its_transactions(spark, firms):
    own = firms["7"]
    own.append("transactions", spark.createDataFrame([("7", "alone", "doc1", 50), ("7", "d/0", None, 51)], ROW))
    assert own.delete_document("doc1") == 7 and own.delete_document("doc1") == 0
    assert ids(own.read("transactions")) == sorted([51, *(i for i in range(24) if i % 4 != 1)])
    assert own.read("transactions").where("scope = 'alone'").isEmpty() and firms["007"].read("transactions").count() == 24


def test_a_run_replaces_open_findings_of_rules(spark, firms):
    own = firms["7"]
    finding = lambda *numbers: spark.createDataFrame([(n, "OPEN") for n in numbers], "finding_id long, status string")
    shown = lambda: sorted((r.scope, r.finding_id, r.status) for r in own.read("findings").collect())
    own.replace_open_findings("e1", finding(1, 2, 3))
    own.replace_open_findings("e2", finding(9))
    own.settle_findings("e1", spark.createDataFrame([(2, "DISMISSED")], "finding_id long, status string"))
    own.replace_open_findings("e1", finding(4))
    assert shown() == [("e1", 2, "DISMISSED"), ("e1", 4, "OPEN"), ("e2", 9, "OPEN")]
    own.replace_open_findings("e1", finding(4).limit(0))
    assert shown() == [("e1", 2, "DISMISSED"), ("e2", 9, "OPEN")]


def test_events_are_pushed_once_each(spark, tmp_path):
    log, out, state = (str(tmp_path / n) for n in ("log", "out", "state"))
    add = lambda *rows: spark.createDataFrame(rows, "engagement_id string, what string").coalesce(1).write.mode("append").parquet(log)
    told, broken = [], [True]

    def tell(batch, number):
        if number == 1 and broken:
            broken.clear()
            raise RuntimeError("killed after the write")
        told.extend(r.what for r in batch.collect())

    def run():
        stream = spark.readStream.schema("engagement_id string, what string").parquet(log)
        push.push_events(stream, out, state, tell).trigger(availableNow=True).start().awaitTermination(120)

    assert push.channel_events(spark, out, "e1") is None
    add(("e1", "a"), ("e2", "b"), (None, "c"))
    run()
    add(("e1", "d"), ("", "e"))
    with pytest.raises(Exception, match="killed"):
        run()
    add(("e1", "f"))
    run()
    found = lambda engagement, after=-1: sorted(r.what for r in push.channel_events(spark, out, engagement, after).collect())
    assert (found("e1"), found("e2"), found(""), found("e1", 0), found("e1", 1)) == (["a", "d", "f"], ["b"], ["c", "e"], ["d", "f"], ["f"])
    assert sorted(told) == list("abcdef")


def test_stub_lines_follow_the_name(spark):
    # worked out by hand with 32-bit arithmetic for the empty name, whose seed is the basis, and one of two signs
    product = lambda a, b: a * b % 2**32
    seeds = {"": 2166136261, "a": product(2166136261 ^ 0x61, 16777619), "é😀": None}
    units = [0xE9, 0xD83D, 0xDE00]
    h = 2166136261
    for u in units:
        h = product(h ^ u, 16777619)
    seeds["é😀"] = h
    df = spark.createDataFrame([(n,) for n in seeds], "name string")
    assert {r.name: r.seed for r in df.select("name", objects.name_seed(F.col("name")).alias("seed")).collect()} == seeds
    files = spark.createDataFrame([("x/a.pdf", "BANK_STATEMENT"), ("y/a.pdf", "BANK_STATEMENT"), ("b.pdf", "VAT")], "path string, document_type string")
    lines = {}
    for r in objects.stub_lines(files).orderBy("path", "line_no").collect():
        lines.setdefault(r.path, []).append(r)
    assert [r[1:] for r in lines["x/a.pdf"]] == [r[1:] for r in lines["y/a.pdf"]] != [r[1:] for r in lines["b.pdf"]]
    assert all(3 <= len(x) <= 8 and 1 <= x[0].page_count <= 4 and [r.line_no for r in x] == list(range(1, len(x) + 1)) for x in lines.values())
    assert lines["x/a.pdf"][0].reference == "BAN-1000"
    assert objects.stub_lines(files.limit(0)).count() == 0

"""Documents and workbooks as data sources, in batches and streams."""

import io
import os
import tracemalloc
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import documents, objects, sinks

PARSER = documents.separated_lines("|", ("reference", "description", "amount", "vat_amount"))


def put(folder, name, text, at=None):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")
    if at is not None:
        os.utime(folder / name, (at, at))


def shown(df, *columns):
    return sorted(tuple(os.path.basename(r[c]) if c == "path" else r[c] for c in columns) for r in df.collect())


def test_many_small_files_and_one_large_one(spark, tmp_path):
    folder = tmp_path / "in"
    for i in range(200):
        put(folder, f"s{i:03}", f"r{i}|d|{i}|\nr|d||\n|d|1|\n")
    put(folder, "t-large", "".join(f"R{i}|d|{i}|5\n" for i in range(50_000)))
    put(folder, "_hidden", "x|y|1|\n")
    name = documents.document_format(spark, "some_documents", PARSER)
    read = spark.read.format(name).option("partitionBytes", 1 << 20).option("openCostBytes", 1 << 14)
    df = read.load(str(folder))
    assert df.count() == 50_200
    assert 3 <= df.rdd.getNumPartitions() <= 7  # 200 files are 4 parts, the large one its own
    assert df.where("line_no > 1").select("path").distinct().count() == 1
    assert shown(df.where("amount = '7'"), "path", "reference", "vat_amount") == [("s007", "r7", None), ("t-large", "R7", "5")]
    assert df.where("reference = 'R49999'").first().line_no == 50_000


def test_columns_are_pruned_and_files_by_name(spark, tmp_path):
    folder = tmp_path / "in"
    for i in range(5):
        put(folder, f"f{i}", f"r|d|{i}|\n")

    def parse(path, stream):
        if path.endswith("f3"):
            raise ValueError("opened")
        return PARSER(path, stream)

    name = documents.document_format(spark, "guarded_documents", parse)
    df = spark.read.format(name).schema("path string, amount string").load(str(folder))
    assert df.columns == ["path", "amount"]
    some = spark.read.format(name).schema("path string, amount string").option("pathGlobFilter", "f[14]").load(str(folder))
    assert shown(some, "path", "amount") == [("f1", "1"), ("f4", "4")]
    with pytest.raises(Exception, match="f3: opened"):
        df.collect()


def test_a_filtered_plan_leaves_other_plans_whole(spark, tmp_path):
    for i in range(5):
        put(tmp_path / "in", f"f{i}", f"r|d|{i}|\n")
    df = spark.read.format(documents.document_format(spark, "shared_documents", PARSER)).load(str(tmp_path / "in"))
    one = df.where(F.col("path") == str(tmp_path / "in" / "f1"))
    assert (one.count(), df.count(), one.unionByName(df).count()) == (1, 5, 6)


def test_no_files_empty_files_and_no_folder(spark, tmp_path):
    name = documents.document_format(spark, "few_documents", PARSER)
    (tmp_path / "none").mkdir()
    assert spark.read.format(name).load(str(tmp_path / "none")).count() == 0
    put(tmp_path / "in", "empty", "")
    assert spark.read.format(name).load(f"file://{tmp_path}/in").collect() == []
    with pytest.raises(Exception, match="FileNotFoundError"):
        spark.read.format(name).load(str(tmp_path / "nowhere")).count()


def test_parse_documents_gives_all_columns(spark, tmp_path):
    put(tmp_path / "in", "a", "x")
    df = objects.parse_documents(spark, str(tmp_path / "in"), lambda name, data: [{"reference": "r", "description": data.decode(), "amount": "1", "date": "2024-01-01", "other": "dropped"}])
    assert df.select("line_no", "description", "date", "counterparty").first()[:] == (1, "x", "2024-01-01", None)


def test_stream_takes_each_file_once_over_restarts(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    name = documents.document_format(spark, "streamed_documents", PARSER)

    def run():
        rows = spark.readStream.format(name).option("settleSeconds", 0).load(str(folder))
        query = rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(out)
        query.awaitTermination(120)
        return shown(spark.read.parquet(out), "path", "amount")

    put(folder, "b", "r|d|1|\nr|d|2|\n", 1_000)
    put(folder, "a", "r|d|3|\n", 1_000)  # of the same time
    first = [("a", "3"), ("b", "1"), ("b", "2")]
    assert run() == first
    assert run() == first
    put(folder, "0", "r|d|4|\n", 2_000)  # later, though its name comes first
    assert run() == [("0", "4"), *first]


def test_unsettled_files_wait(tmp_path):
    put(tmp_path / "in", "old", "x", 1_000)
    put(tmp_path / "in", "new", "x")

    class Source(documents.FileSource):
        pass

    stream = documents.FileStream(Source({"path": str(tmp_path / "in"), "settleSeconds": "3600"}), documents.StructType())
    assert stream.latestOffset()["path"].endswith("old")
    assert [p.paths for p in stream.partitions(stream.initialOffset(), stream.latestOffset())] == [[str(tmp_path / "in" / "old")]]
    assert stream.partitions(stream.latestOffset(), stream.latestOffset()) == []


def test_packing_by_size():
    files = [documents.Found(str(i), size, 0) for i, size in enumerate((5, 5, 5, 100, 1, 1))]
    assert [p.paths for p in documents.packed(files, 12, 1)] == [["0", "1"], ["2"], ["3"], ["4", "5"]]
    assert documents.packed([], 12, 1) == []


def test_workbooks_are_streamed():
    data = io.BytesIO(sinks.workbook([["h", "n"], *([f"v{i}", "x" * 50] for i in range(30_000))]))
    tracemalloc.start()
    n = sum(1 for _ in documents.sheet_rows(data))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 30_001 and peak < 4 << 20  # the sheet alone is over 6 MB of XML


def test_workbooks_pruned_and_broken(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(sinks.workbook([["h", "", "h"], ["1", "x", "2"], ["", "", ""], ["3"]]))
    name = documents.workbook_format(spark)
    assert spark.read.format(name).schema("source_row_no long").load(str(tmp_path)).count() == 3
    assert [r.cells for r in spark.read.format(name).load(str(tmp_path)).orderBy("source_row_no").collect()] == [["h", "", "h"], ["1", "x", "2"], ["3", "", ""]]
    values = spark.read.format(name).option("as", "objects").load(str(tmp_path)).orderBy("source_row_no")
    assert [(r.source_row_no, r["values"]) for r in values.collect()] == [(1, {"h": "2"})]  # the last row has nothing under the last h
    (tmp_path / "b.xlsx").write_bytes(b"no workbook")
    with pytest.raises(Exception, match="b.xlsx"):
        spark.read.format(name).load(str(tmp_path)).collect()
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as book:
        book.writestr("other.xml", "<x/>")
    with pytest.raises(Exception, match="without a sheet"):
        spark.read.format(name).load(str(tmp_path)).collect()

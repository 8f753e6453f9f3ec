"""Queries of the sources: files made of the tables, read back; registered beside those of `catalog`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans import views
from ledgerloom.plans.catalog import query
from ledgerloom.plans.stored_queries import _folder
from ledgerloom.sources import delimited, documents, objects, sinks

#: Customers of a document.
_A_DOCUMENT = 100


def _line(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _customer_documents(spark: SparkSession, sf_dir: str) -> str:
    """A folder of documents, each of the lines of up to a hundred customers; some lines lack a reference or an amount."""
    key = F.col("c_custkey")
    line = _line(F.when(key % 7 == 0, "").otherwise(key.cast("string")), "|", F.col("c_name"), "|", F.when(key % 5 == 0, "").otherwise(F.floor(F.col("c_acctbal")).cast("string")), "|", F.when(key % 2 == 0, "15").otherwise(""), "\n")
    rows = views.table(spark, sf_dir, "customer").select(F.floor(key / _A_DOCUMENT).alias("document"), key.alias("at"), line.alias("line"))
    lists = rows.groupBy("document").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("lines"))
    folder = _folder(spark, "documents")
    documents.write_files(lists.select(_line("d", F.col("document")).alias("name"), F.array_join("lines.line", "").alias("content")), folder)
    return folder


_LINES = """l AS (SELECT c_custkey // 100 AS document, c_custkey AS place, CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey AS VARCHAR) END AS reference, c_name AS description,
CASE WHEN c_custkey % 5 <> 0 THEN CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) END AS amount, CASE WHEN c_custkey % 2 = 0 THEN '15' END AS vat_amount FROM customer)"""
_PARSER = documents.separated_lines("|", ("reference", "description", "amount", "vat_amount"))


@query(f"""WITH {_LINES} SELECT 'd' || document AS document, CAST(row_number() OVER (PARTITION BY document ORDER BY place) AS INTEGER) AS line_no, reference, description, amount, vat_amount FROM l WHERE reference IS NOT NULL AND amount IS NOT NULL""")
def document_lines_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents of a hundred customers each, written as files and read through the source of their parser."""
    folder = _customer_documents(spark, sf_dir)
    name = documents.document_format(spark, "ledgerloom_separated", _PARSER)
    return spark.read.format(name).load(folder).select(F.element_at(F.split("path", "/"), -1).alias("document"), "line_no", "reference", "description", "amount", "vat_amount")


@query(f"""WITH {_LINES} SELECT 'd' || document AS document, count(*) AS n_lines, sum(CAST(amount AS BIGINT)) AS total FROM l WHERE reference IS NOT NULL AND amount IS NOT NULL GROUP BY 1""")
def document_stream_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the same documents read as a stream, stopped and started again: each file comes once."""
    folder, out = _customer_documents(spark, sf_dir), _folder(spark, "streamed")
    name = documents.document_format(spark, "ledgerloom_separated", _PARSER)
    for _ in range(2):
        lines = spark.readStream.format(name).option("settleSeconds", 0).load(folder).select("path", "amount")
        lines.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/lines").awaitTermination()
    read = spark.read.schema("path string, amount string").parquet(f"{out}/lines")
    return read.groupBy(F.element_at(F.split("path", "/"), -1).alias("document")).agg(F.count("*").alias("n_lines"), F.sum(F.col("amount").cast("long")).alias("total"))


@query("""WITH l AS (SELECT c_custkey // 200 AS pair, c_custkey // 100 % 2 AS half, string_agg(c_custkey || '|' || c_name || chr(10), '' ORDER BY c_custkey) AS content FROM customer GROUP BY 1, 2)
SELECT DISTINCT sha256(content) AS sha256, CAST(octet_length(encode(content)) AS BIGINT) AS length FROM l""")
def objects_stored_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of a store into which the same files were put twice, half of them under two names."""
    key = F.col("c_custkey")
    lists = views.table(spark, sf_dir, "customer").groupBy(F.floor(key / _A_DOCUMENT).alias("document")).agg(F.array_sort(F.collect_list(F.struct(key, _line(key, "|", F.col("c_name"), "\n").alias("line")))).alias("lines"))
    copies = F.when(F.col("document") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    source, store = _folder(spark, "files"), _folder(spark, "objects")
    named = lists.withColumn("copy", F.explode(copies)).select(_line("d", F.col("document"), "-", F.col("copy")).alias("name"), F.array_join("lines.line", "").alias("content"))
    documents.write_files(named, source)
    for _ in range(2):
        objects.put_objects(spark, source, store)
    return objects.stat_objects(spark, store)


@query("""WITH s AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS source_row_no, s_name FROM supplier WHERE s_suppkey % 7 <> 0)
SELECT source_row_no, CAST(s_suppkey AS VARCHAR) AS id, s_name || ';' || CASE WHEN s_suppkey % 3 = 0 THEN chr(10) ELSE '' END || '"x"' AS note, CASE WHEN s_suppkey % 2 = 0 THEN 'last' ELSE '' END AS amount FROM s""")
def csv_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as a file with semicolons, quotes and line breaks within cells, blank rows, short rows and a header twice, read by header.

    One file is one task's to write; reading it is parallel.
    """
    key = F.col("s_suppkey")
    text = _line(key, ';"', F.col("s_name"), ";", F.when(key % 3 == 0, "\n").otherwise(""), '""x"""', F.when(key % 2 == 0, ";first;last\r").otherwise("\r"))
    rows = views.table(spark, sf_dir, "supplier").select(key.alias("at"), F.when(key % 7 == 0, " ; ;\r").otherwise(text).alias("value"))
    header = spark.range(1).select(F.lit(-1).alias("at"), F.lit("﻿ id;note ;amount; amount\r").alias("value"))
    path = _folder(spark, "csv")
    header.unionByName(rows).repartition(1).sortWithinPartitions("at").select("value").write.text(path)
    return delimited.read_objects(spark, path)


@query("""WITH r AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS place, s_name FROM supplier)
SELECT place // 40 AS book, place % 40 + 1 AS source_row_no, CAST(s_suppkey AS VARCHAR) AS id, CASE WHEN s_suppkey % 3 = 0 THEN '—' ELSE '<' || s_name || '>' END AS name FROM r""")
def workbook_rows_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers exported to workbooks of 40 rows, whose files are read back by header."""
    key = F.col("s_suppkey")
    rows = views.table(spark, sf_dir, "supplier").select(key.alias("at"), key.alias("id"), F.when(key % 3 != 0, _line("<", F.col("s_name"), ">")).alias("name"))
    folder = _folder(spark, "workbooks")
    documents.write_files(sinks.export_workbooks(rows, {"id": "المعرف", "name": "الاسم"}, ["at"], rows_per_book=40).select(_line(F.col("book"), ".xlsx").alias("name"), "content"), folder)
    read = delimited.read_workbook_objects(spark, folder)
    return read.select(F.regexp_extract("path", r"(\d+)\.xlsx$", 1).cast("long").alias("book"), "source_row_no", F.col("values")["المعرف"].alias("id"), F.col("values")["الاسم"].alias("name"))

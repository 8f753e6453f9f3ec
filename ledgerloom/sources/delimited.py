"""Delimited text and spreadsheets as positional rows: nothing is inferred, nothing is lost."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import is_blank, trimmed
from ledgerloom.operators.ingest import content_numbered
from ledgerloom.session import checkpointed
from ledgerloom.sources.documents import workbook_format

#: Delimiters in order of preference.
DELIMITERS = (",", ";", "\t")


def detect_delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter that the first line holds most often; of equals the first in order."""
    line = spark.read.text(path).select("value").first()
    return max(DELIMITERS, key=lambda d: (line.value.count(d), -DELIMITERS.index(d))) if line else DELIMITERS[0]


def _records(spark: SparkSession, path: str) -> DataFrame:
    """(at, value): the records of one file in order; a line break within quotes doesn't end one.

    Whether a line begins within quotes follows from the number of quotes before it. That is
    summed by part of the file and then over the parts, so a large file is read in parallel.
    """
    lines = spark.read.text(path, lineSep="\n").select(F.monotonically_increasing_id().alias("at"), "value")
    if lines.where(F.contains("value", F.lit('"'))).isEmpty():
        return lines
    lines = lines.withColumns({"part": F.shiftrightunsigned("at", 33), "quotes": F.regexp_count("value", F.lit('"'))})
    lines = checkpointed(lines)  # read three times below
    over_parts = Window.orderBy("part")  # one row per part of the file
    before = lines.groupBy("part").agg(F.sum("quotes").alias("n")).select("part", (F.sum("n").over(over_parts) - F.col("n")).alias("before"))
    inside = Window.partitionBy("part").orderBy("at")
    marked = lines.join(F.broadcast(before), "part").withColumn("is_open", (F.col("before") + F.sum("quotes").over(inside) - F.col("quotes")) % 2 == 1)
    begun = marked.withColumn("record", F.max(F.when(~F.col("is_open"), F.col("at"))).over(inside))
    last = marked.groupBy("part").agg(F.max(F.when(~F.col("is_open"), F.col("at"))).alias("last"))
    carried = last.select("part", F.max("last").over(over_parts.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    whole = begun.join(F.broadcast(carried), "part").withColumn("record", F.coalesce("record", "carried"))
    lists = whole.groupBy(F.col("record").alias("at")).agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("lines"))
    return lists.select("at", F.array_join(F.col("lines.value"), "\n").alias("value"))


def cells_of(record: str, delimiter: str) -> list[str]:
    """Cells of a record: quotes may open anywhere, a doubled quote within them stands for one, carriage returns count only within them."""
    if '"' not in record:
        return record.replace("\r", "").split(delimiter)
    cells, at = [""], 0
    while at < len(record):
        start = record.find('"', at)
        plain = record[at:] if start < 0 else record[at:start]
        first, *more = plain.replace("\r", "").split(delimiter)
        cells[-1] += first
        cells += more
        if start < 0:
            break
        end = start + 1
        while (end := record.find('"', end)) >= 0 and record[end + 1 : end + 2] == '"':
            end += 2
        text = record[start + 1 :] if end < 0 else record[start + 1 : end]
        cells[-1] += text.replace('""', '"')
        at = len(record) if end < 0 else end + 1
    return cells


def read_positional(spark: SparkSession, path: str, delimiter: str | None = None) -> tuple[list[str | None], DataFrame]:
    """Headers, and the rows of one file as (source_row_no, cells): cells is an array of strings in column order.

    Quotes, doubled quotes and line breaks within them as in RFC 4180; a byte order mark and
    carriage returns outside quotes are dropped. Headers and rows are padded to the widest row.
    Rows without any value are left out before numbering, from 1.
    """
    mark = delimiter or detect_delimiter(spark, path)

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [cells_of(value, mark) for value in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.list_(pa.string()))], ["at", "cells"])

    records = checkpointed(_records(spark, path).mapInArrow(tokenised, "at long, cells array<string>"))
    width, start = records.agg(F.max(F.size("cells")), F.min("at")).first()
    if width is None:
        return [], spark.createDataFrame([], "source_row_no long, cells array<string>")
    first = records.where(F.col("at") == start).first().cells
    first[0] = first[0].removeprefix("\ufeff")
    headers = [h.strip() or None for h in first] + [None] * (width - len(first))
    padded = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.get("cells", i), F.lit("")))
    rows = records.where(F.col("at") > start).where(F.exists("cells", lambda c: ~is_blank(c))).select("at", padded.alias("cells"))
    return headers, content_numbered(rows, ["at"]).select("source_row_no", "cells")


def read_objects(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """Rows keyed by trimmed header; of repeated headers the last column stays."""
    headers, rows = read_positional(spark, path, delimiter)
    last = {h: i for i, h in enumerate(headers) if h}
    return rows.select("source_row_no", *(trimmed(F.get("cells", F.lit(i))).alias(h) for h, i in last.items()))


def read_workbook_objects(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the first sheet of every workbook at a path, keyed by header: path, source_row_no from 1, values (map).

    Of repeated headers the last column stays; columns without a header and rows without any
    value are left out.
    """
    return spark.read.format(workbook_format(spark)).option("as", "objects").load(path)


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the first sheet of every workbook at a path: path, source_row_no (0 is the header), cells padded to the widest row."""
    return spark.read.format(workbook_format(spark)).load(path)


RULE_COLUMNS = ("code", "nameAr", "severity", "scope", "descriptionAr", "definition")
_SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")


def read_rules(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules of a table with RULE_COLUMNS, and the rows that are no rules with a reason. An unknown severity becomes MEDIUM."""
    kind = F.get_json_object("definition", "$.type")
    reason = F.when(is_blank(F.col("code")), "MISSING_CODE").when(is_blank(F.col("nameAr")), "MISSING_NAME").when(F.try_parse_json("definition").isNull(), "INVALID_JSON").when(kind.isNull(), "MISSING_TYPE")
    severity = F.upper(trimmed(F.coalesce("severity", F.lit(""))))
    marked = rows.withColumns({"reason": reason, "severity": F.when(severity.isin(*_SEVERITIES), severity).otherwise("MEDIUM"), "category": kind})
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")

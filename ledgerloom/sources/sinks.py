"""Sinks: staged writes, exports, templates and the append-only log."""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.ingest import content_numbered, issue_rows
from ledgerloom.session import checkpointed
from ledgerloom.sources import commits

def write_import(prepared: DataFrame, path: str) -> None:
    """Writes prepared rows and their issues from one evaluation."""
    once = checkpointed(prepared)
    once.write.mode("errorifexists").parquet(f"{path}/records")
    issue_rows(once).write.mode("errorifexists").parquet(f"{path}/issues")


def write_sealed(tables: dict[str, DataFrame], path: str) -> str:
    """Writes several tables as one: into a folder of this attempt, then as the only commit of the path.

    Readers know the committed attempt only. One that fails leaves nothing that they see, and the
    next one starts afresh; a second seal is refused, also where two writers seal at once.
    """
    spark = next(iter(tables.values())).sparkSession
    attempt = commits.written(tables, path)
    if not commits.claimed(spark, path, 1, attempt, list(tables)):
        raise commits.Conflict(f"{path}: a seal already exists")
    return attempt


def read_sealed(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the sealed attempt; without a seal there is none, and reading fails."""
    table = commits.snapshot(spark, path).table(name)
    if table is None:
        raise FileNotFoundError(f"{path} has no sealed {name}")
    return table


def append_log(actions: DataFrame, path: str) -> None:
    """Appends actions to the audit log."""
    actions.withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)


def export_csv(rows: DataFrame, path: str, labels: dict[str, str]) -> None:
    """Writes rows as quoted CSV with a header of labels, one per column in order."""
    rows.select(*(F.col(c).cast("string").alias(label) for c, label in labels.items())).write.mode("errorifexists").csv(path, header=True, quoteAll=True, escape='"')


def template(columns: tuple[str, ...], rows: list[tuple[str, ...]] = ()) -> bytes:
    """An import template: byte order mark, quoted values, carriage returns."""
    quoted = lambda values: ",".join('"' + v.replace('"', '""') + '"' for v in values)
    return ("﻿" + "\r\n".join(map(quoted, [columns, *rows])) + "\r\n").encode()


def without_document(transactions: DataFrame, document_id: str) -> tuple[DataFrame, int]:
    """Transactions after a document is deleted, and how many of them went with it."""
    own = F.col("document_id").eqNullSafe(document_id)
    return transactions.where(~own), transactions.where(own).count()


#: The parts of a workbook besides its sheet, and what a sheet begins and ends with.
_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}
_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")
_SHEET = ('<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetViews><sheetView rightToLeft="1" workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><sheetData>', "</sheetData></worksheet>")


def workbook(rows: list[list[str | None]]) -> bytes:
    """A workbook of one sheet from right to left, its first row kept in view; all cells are text."""
    letters = [chr(65 + i) if i < 26 else chr(64 + i // 26) + chr(65 + i % 26) for i in range(max(map(len, rows), default=0))]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in _PARTS.items():
            book.writestr(name, text)
        cell = lambda at, v: f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape("—" if v is None else _ILLEGAL.sub("", v))}</t></is></c>'
        lines = ("<row r=\"%d\">%s</row>" % (n, "".join(cell(f"{letters[i]}{n}", v) for i, v in enumerate(row))) for n, row in enumerate(rows, 1))
        book.writestr("xl/worksheets/sheet1.xml", _SHEET[0] + "".join(lines) + _SHEET[1])
    return out.getvalue()


def export_workbooks(rows: DataFrame, labels: dict[str, str], order: list[str], rows_per_book: int = 100_000) -> DataFrame:
    """Rows as workbooks (book, content) in the given order, at most `rows_per_book` rows each, under a header of labels."""
    shown = rows.select(*order, *(F.col(c).cast("string").alias(f"shown_{i}") for i, c in enumerate(labels)))
    numbered = content_numbered(shown, order).select(F.floor((F.col("source_row_no") - 1) / rows_per_book).alias("book"), "source_row_no", F.array(*(f"shown_{i}" for i in range(len(labels)))).alias("cells"))

    def made(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        cells = [list(labels.values()), *map(list, table.sort_values("source_row_no").cells)]
        return pd.DataFrame({"book": [key[0]], "content": [workbook(cells)]})

    return numbered.groupBy("book").applyInPandas(made, "book long, content binary")

"""Documents and workbooks as data sources: `spark.read.format(...)` and `spark.readStream.format(...)`.

Files are packed into partitions by size, each partition opens its own files and yields Arrow
batches of bounded rows; a large file is streamed, never held as one value. Asking for fewer
columns (`.schema("path string, amount string")`) makes only those; the option `pathGlobFilter`
leaves files out by name before any is opened. Filters aren't pushed into the source: Spark 4.1.2
keeps what one plan pushed for other plans of the same frame, which would then lack rows.
"""

from __future__ import annotations

import fnmatch
import io
import re
import time
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import CaseInsensitiveDict, DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A parser of documents: the lines of a file, given its name and its bytes as a stream.
Parser = Callable[[str, BinaryIO], Iterable[dict[str, str | None]]]

LINE = "path string, line_no int, reference string, description string, amount string, vat_amount string, date string, counterparty string"
CELLS = "path string, source_row_no long, cells array<string>"
OBJECTS = "path string, source_row_no long, values map<string,string>"
WORKBOOKS = "ledgerloom_workbook"

#: Defaults of the options partitionBytes and openCostBytes, and rows of a batch.
PARTITION_BYTES, OPEN_COST_BYTES, BATCH_ROWS = 128 << 20, 4 << 20, 4_096
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


# Files


@dataclass(frozen=True)
class Found:
    """A file: its name, bytes, and when it was last changed in nanoseconds."""

    path: str
    size: int
    at: int


@dataclass
class Files(InputPartition):
    """The files that one task reads."""

    paths: list[str]


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and name in it of a path, which is local or has a scheme that Arrow knows."""
    local = path.removeprefix("file://").removeprefix("file:")
    return (fs.LocalFileSystem(), local) if "://" not in local else fs.FileSystem.from_uri(path)


def found_files(path: str) -> list[Found]:
    """The files at or below a path by name; those whose name, or folder's name, begins with a point or an underscore are left out."""
    store, root = _store(path)
    info = store.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    inside = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
    shown = lambda name: not re.search(r"(^|/)[._]", name.removeprefix(root))
    return sorted((Found(f.path, f.size, f.mtime_ns or 0) for f in inside if f.type == fs.FileType.File and shown(f.path)), key=lambda f: f.path)


def packed(files: Iterable[Found], partition_bytes: int, open_cost: int) -> list[Files]:
    """Files in order, in partitions of about so many bytes; opening one counts as reading `open_cost` bytes."""
    parts: list[Files] = []
    room = 0
    for file in files:
        cost = file.size + open_cost
        if not parts or cost > room:
            parts.append(Files([]))
            room = partition_bytes
        parts[-1].paths.append(file.path)
        room -= cost
    return parts


class _Opener:
    """What readers of batches and of streams share: options, columns, and the rows of a file."""

    def __init__(self, source: FileSource, schema: StructType):
        self.options, self.schema, self.records = CaseInsensitiveDict(source.options), schema, source.records
        self.path = self.options.get("path") or ""
        self.glob = self.options.get("pathGlobFilter", "*")
        self.sizes = int(self.options.get("partitionBytes", PARTITION_BYTES)), int(self.options.get("openCostBytes", OPEN_COST_BYTES))

    def files(self) -> list[Found]:
        return [f for f in found_files(self.path) if fnmatch.fnmatchcase(f.path.rsplit("/", 1)[-1], self.glob)]

    def batches(self, part: InputPartition | None) -> Iterator[pa.RecordBatch]:
        kind, names = to_arrow_schema(self.schema), self.schema.names
        store, _ = _store(self.path)
        rows: list[dict] = []
        for path in part.paths if isinstance(part, Files) else ():
            with store.open_input_file(path) as stream:
                try:
                    for row in self.records(path, stream, set(names)):
                        rows.append(row)
                        if len(rows) == BATCH_ROWS:
                            yield pa.RecordBatch.from_pylist(rows, kind)
                            rows = []
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as error:
                    raise ValueError(f"{path}: {error}") from error
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kind)


class FileReader(_Opener, DataSourceReader):
    """Reads all files once."""

    def partitions(self) -> list[InputPartition]:
        return packed(self.files(), *self.sizes)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return self.batches(partition)


class FileStream(_Opener, DataSourceStreamReader):
    """Reads files as they come, in the order of their times; an offset is the time and name of the last file.

    A file counts once it is `settleSeconds` old (5 by default), so that files of one time come
    together. It should be moved in whole, and not with a time older than that.
    """

    def _settled(self) -> list[Found]:
        until = time.time_ns() - int(float(self.options.get("settleSeconds", "5")) * 1e9)
        return [f for f in self.files() if f.at <= until]

    def initialOffset(self) -> dict:
        return {"at": -1, "path": ""}

    def latestOffset(self) -> dict:
        at, path = max(((f.at, f.path) for f in self._settled()), default=(-1, ""))
        return {"at": at, "path": path}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        first, last = (start["at"], start["path"]), (end["at"], end["path"])
        return packed((f for f in self.files() if first < (f.at, f.path) <= last), *self.sizes)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return self.batches(partition)


class FileSource(DataSource):
    """A source of files; `records` gives a file's rows with the columns wanted."""

    @staticmethod
    def records(path: str, stream: BinaryIO, wanted: set[str]) -> Iterator[dict]:
        raise NotImplementedError

    def reader(self, schema: StructType) -> FileReader:
        return FileReader(self, schema)

    def streamReader(self, schema: StructType) -> FileStream:
        return FileStream(self, schema)


def _register(spark: SparkSession, name: str, base: type[FileSource], **members: object) -> str:
    spark.dataSource.register(type(base.__name__, (base,), {"name": classmethod(lambda cls: name), **members}))
    return name


# Documents


class _Documents(FileSource):
    def schema(self) -> str:
        return LINE


def document_format(spark: SparkSession, name: str, parser: Parser) -> str:
    """Makes a parser the format `name`: lines of documents, those without amount, reference or description left out before numbering."""

    def records(path: str, stream: BinaryIO, wanted: set[str]) -> Iterator[dict]:
        whole = (line for line in parser(path, stream) if all(line.get(k) for k in ("reference", "description", "amount")))
        for number, line in enumerate(whole, 1):
            yield {**line, "path": path, "line_no": number}

    return _register(spark, name, _Documents, records=staticmethod(records))


# Workbooks


def sheet_rows(stream: BinaryIO) -> Iterator[list[str]]:
    """Rows of a workbook's first sheet as trimmed text, one after another; formulas give their stored value.

    Held at a time are a row and the texts that cells share, which the format keeps in one table.
    """
    with zipfile.ZipFile(stream) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as file:
                shared = ["".join(t.text or "" for t in item.iter(f"{_SHEET}t")) for item in _elements(file, f"{_SHEET}si")]
        sheets = [n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)]
        if not sheets:
            raise ValueError("a workbook without a sheet")
        with book.open(min(sheets, key=lambda n: int(re.findall(r"\d+", n)[-1]))) as file:
            for row in _elements(file, f"{_SHEET}row"):
                yield _cells(row, shared)


def _elements(file: BinaryIO, tag: str) -> Iterator[ElementTree.Element]:
    """Elements of a tag as they end; what was read before is let go."""
    above: list[ElementTree.Element] = []
    for event, element in ElementTree.iterparse(file, events=("start", "end")):
        if event == "start":
            above.append(element)
            continue
        above.pop()
        if element.tag == tag:
            yield element
            above[-1].remove(element)


def _cells(row: ElementTree.Element, shared: list[str]) -> list[str]:
    cells: dict[int, str] = {}
    for cell in row.iter(f"{_SHEET}c"):
        column = 0
        for letter in re.match(r"[A-Z]+", cell.get("r", "A"))[0]:
            column = column * 26 + ord(letter) - 64
        value = cell.find(f"{_SHEET}v")
        text = "".join(t.text or "" for t in cell.iter(f"{_SHEET}t")) if cell.get("t") == "inlineStr" else (value.text or "") if value is not None else ""
        cells[column - 1] = shared[int(text)].strip() if cell.get("t") == "s" and text else text.strip()
    return [cells.get(i, "") for i in range(max(cells, default=-1) + 1)]


class _Workbooks(FileSource):
    """First sheets. As cells: padded to the workbook's widest row, row 0 the header, blank rows left out.
    With the option `as` = objects: rows from 1 by header, of repeated headers the last column."""

    def schema(self) -> str:
        return OBJECTS if self.options.get("as") == "objects" else CELLS

    @staticmethod
    def records(path: str, stream: BinaryIO, wanted: set[str]) -> Iterator[dict]:
        if "values" in wanted:
            rows = sheet_rows(stream)
            headers = next(rows, [])
            objects = ({h: row[i] if i < len(row) else "" for i, h in enumerate(headers) if h} for row in rows)
            for number, values in enumerate((o for o in objects if any(o.values())), 1):
                yield {"path": path, "source_row_no": number, "values": list(values.items())}
            return
        width = 0
        if "cells" in wanted:  # a first pass for the widest row
            width = max((len(r) for r in sheet_rows(stream) if any(r)), default=0)
            stream.seek(0)
        for number, row in enumerate(r for r in sheet_rows(stream) if any(r)):
            yield {"path": path, "source_row_no": number, "cells": row + [""] * (width - len(row))}


def workbook_format(spark: SparkSession) -> str:
    """Makes workbooks the format WORKBOOKS."""
    return _register(spark, WORKBOOKS, _Workbooks)


# Parsers


def separated_lines(separator: str, columns: tuple[str, ...]) -> Parser:
    """A parser of text whose lines hold the named columns between separators; empty ones are null."""

    def parse(name: str, stream: BinaryIO) -> Iterator[dict[str, str | None]]:
        for line in io.TextIOWrapper(io.BufferedReader(stream), encoding="utf-8-sig"):
            yield {c: v or None for c, v in zip(columns, line.rstrip("\r\n").split(separator))}

    return parse


# Writing


def write_files(files: DataFrame, folder: str) -> int:
    """Writes rows (name, content) as files of a folder, from the tasks that hold them; gives how many.

    A file gets its name once it is whole, so a task that is run again changes nothing. Contents
    are values of a column, hence of at most 2 GB; names are told apart by their rows.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for batch in batches:
            store.create_dir(root, recursive=True)
            for name, content in zip(*(c.to_pylist() for c in batch.columns)):
                draft = f"{root}/.{uuid.uuid4().hex}"
                with store.open_output_stream(draft) as out:
                    out.write(content)
                store.move(draft, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    written = files.select("name", F.col("content").cast("binary")).mapInArrow(put, "n long")
    return written.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

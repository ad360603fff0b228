"""Workbooks (XLSX) as a data source: ``spark.read.format("workbook").load(folder)``, and a writer that gives each task its own files.

A reader's partition is one worksheet; rows are read as a stream of XML, so that a task holds a few rows at a time. All columns are
text, named by the first row of the first worksheet; blank cells and missing trailing cells are null.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

# The name spaces of the format.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_TYPE = "application/vnd.openxmlformats-"


def _column(i: int) -> str:
    return chr(65 + i) if i < 26 else _column(i // 26 - 1) + _column(i % 26)


def _place(ref: str) -> int:
    """The number of a cell's column, from 0."""
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def workbook(header: list[str], rows: list[list[str | None]]) -> bytes:
    """The bytes of a file with one worksheet of text cells."""
    cell = lambda r, i, v: "" if v is None else f'<c r="{_column(i)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'
    body = "".join(f'<row r="{r}">' + "".join(cell(r, i, v) for i, v in enumerate(row)) + "</row>" for r, row in enumerate([header, *rows], 1))
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="{_TYPE}package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{_TYPE}officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{_TYPE}officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="r1" Type="{RELATIONS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{RELATIONS}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="r1" Type="{RELATIONS}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{MAIN}"><sheetData>{body}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + text)
    return out.getvalue()


def sheet_rows(file, sheet: str) -> Iterator[list[str | None]]:
    """The rows of a worksheet as text; shared, inline and plain values."""
    tag = lambda t: f"{{{MAIN}}}{t}"
    with zipfile.ZipFile(file) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(tag("t"))) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        with z.open(sheet) as xml:
            for _, row in ElementTree.iterparse(xml):
                if row.tag != tag("row"):
                    continue
                out: list[str | None] = []
                for n, c in enumerate(row.iter(tag("c"))):
                    at = _place(c.get("r")) if c.get("r") else n
                    value = c.find(tag("v"))
                    text = "".join(t.text or "" for t in c.iter(tag("t"))) if c.get("t") == "inlineStr" else value.text if value is not None else None
                    text = shared[int(text)] if c.get("t") == "s" and text is not None else text
                    out += [None] * (at - len(out)) + [text or None]
                row.clear()
                yield out


def _sheets(file) -> list[str]:
    with zipfile.ZipFile(file) as z:
        return sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n))


def _open(uri: str):
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    return where.open_input_file(path)


def _files(uri: str) -> list[str]:
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    if where.get_file_info(path).type == fs.FileType.File:
        return [uri]
    return sorted(f"{uri.rstrip('/')}/{f.base_name}" for f in where.get_file_info(fs.FileSelector(path)) if f.base_name.endswith(".xlsx"))


class _Sheet(InputPartition):
    def __init__(self, uri: str, sheet: str):
        self.uri, self.sheet = uri, sheet


class _Reader(DataSourceReader):
    def __init__(self, names: list[str], uri: str):
        self.names, self.uri = names, uri

    def partitions(self) -> list[InputPartition]:
        return [_Sheet(f, s) for f in _files(self.uri) for s in _sheets(_open(f))]

    def read(self, part: _Sheet) -> Iterator[tuple]:
        rows = sheet_rows(_open(part.uri), part.sheet)
        at = {name: i for i, name in enumerate(next(rows, []))}
        for row in rows:
            if any(v is not None for v in row):
                yield tuple(row[at[n]] if n in at and at[n] < len(row) else None for n in self.names)


class WorkbookSource(DataSource):
    """``format("workbook")``: one file, or all ``.xlsx`` files of a folder, with their columns found by name."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> StructType:
        first = _files(self.options["path"])[0]
        header = next(sheet_rows(_open(first), _sheets(_open(first))[0]), [])
        return StructType([StructField(n, StringType()) for n in header if n])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema.names, self.options["path"])


def read_workbooks(spark: SparkSession, uri: str, columns: dict[str, str] | None = None) -> DataFrame:
    """The rows of the workbooks at ``uri``; ``columns`` (theirs to ours) renames and picks."""
    from pyspark.sql import functions as F

    spark.dataSource.register(WorkbookSource)
    df = spark.read.format("workbook").load(uri)
    return df.select(*(F.trim(F.col(f"`{theirs}`")).alias(ours) for theirs, ours in columns.items())) if columns else df


def write_workbooks(rows: DataFrame, uri: str, per_file: int = 50_000) -> DataFrame:
    """Writes each partition as workbooks of at most ``per_file`` rows, all cells as text; returns ``(file, rows)`` lazily: an action writes."""
    from pyspark.sql import functions as F

    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, path = fs.FileSystem.from_uri(uri)
        where.create_dir(path, recursive=True)
        part, seq, held = TaskContext.get().partitionId(), 0, []

        def put(some: list) -> pa.RecordBatch:
            name = f"part-{part:05d}-{seq:04d}.xlsx"
            hidden = f"{path}/.{uuid.uuid4().hex}"
            with where.open_output_stream(hidden) as out:
                out.write(workbook(names, some))
            where.move(hidden, f"{path}/{name}")  # a second try of a task replaces the file by the same rows
            return pa.RecordBatch.from_pylist([{"file": name, "rows": len(some)}])

        for b in batches:
            held += [list(r) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            while len(held) >= per_file:
                yield put(held[:per_file])
                held, seq = held[per_file:], seq + 1
        if held:
            yield put(held)

    return rows.select(*(F.col(f"`{c}`").cast("string") for c in names)).mapInArrow(run, "file string, rows long")

"""Sheets of .xlsx workbooks as a Spark data source and sink.

    spark.read.format("loom_workbook").option("sheet", "taxa").option("header", 2).load(path)
    df.write.format("loom_workbook").option("sheet", "taxa").mode("append").save(folder)

A workbook is a zip archive of XML parts: the workbook lists sheets and their parts, shared strings hold texts, and each
sheet's part holds its cells row by row. A task streams one sheet of one file; the driver reads no cell but the header row of
the first file, and only where no schema is given.

path: a file, a folder of *.xlsx files or a pattern, which all executors can open. sheet: names of sheets (comma-separated; a part of
a name may be *); the first sheet by default. header: how many rows stand above the header row (default 0). Columns of a given
schema are found by their header; those that the sheet lacks are null. Without a schema all columns are text, by the header's names.
Rows without any cell are left out. Cells are read as the column's type; others, and error cells, are null. Dates are
serial days, in the workbook's own date system.
"""

from __future__ import annotations

import datetime
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase
from xml.etree.ElementTree import iterparse
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .folder import FolderWriter, files_at

ENDING = ".xlsx"
ROWS = 10_000
#: Fixed names of the format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
SPACE = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
KINDS = "application/vnd.openxmlformats-officedocument.spreadsheetml"
#: Characters that XML cannot hold; the format writes them as _xHHHH_.
UNFIT = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\r]|_(?=x[0-9A-Fa-f]{4}_)")


def elements(book: zipfile.ZipFile, part: str, tag: str) -> Iterator:
    """Elements of a part that end with the tag, one at a time; what was read is let go."""
    with book.open(part) as f:
        steps = iterparse(f, ("start", "end"))
        above = [next(steps)[1]]
        for event, e in steps:
            if event == "start":
                above.append(e)
                continue
            above.pop()
            if e.tag == tag:
                yield e
                above[-1].clear()


def text_in(e) -> str:
    """The text of a string item: plain or in runs, without phonetic hints."""
    said = [t.text or "" for t in e.findall(f"{MAIN}t")] + [t.text or "" for t in e.findall(f"{MAIN}r/{MAIN}t")]
    return re.sub("_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), "".join(said))


def sheets(book: zipfile.ZipFile) -> dict[str, str]:
    """Part of each sheet, by name, in the workbook's order."""
    target = {}
    for e in elements(book, "xl/_rels/workbook.xml.rels", f"{{{PACKAGE}/relationships}}Relationship"):
        to = e.get("Target")
        target[e.get("Id")] = to[1:] if to.startswith("/") else f"xl/{to}"
    return {e.get("name"): target[e.get(LINK)] for e in elements(book, "xl/workbook.xml", f"{MAIN}sheet")}


def chosen(book: zipfile.ZipFile, wanted: str | None) -> list[tuple[str, str]]:
    """(name, part) of the wanted sheets, or the first."""
    found = list(sheets(book).items())
    if not wanted:
        return found[:1]
    kept = [(n, p) for n, p in found if any(fnmatchcase(n, w.strip()) for w in wanted.split(","))]
    if not kept:
        raise ValueError(f"no sheet {wanted} among {[n for n, _ in found]}")
    return kept


def place_of(reference: str) -> int:
    """Column of a cell such as AB12, from 0."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def rows_of(book: zipfile.ZipFile, part: str) -> Iterator[tuple[int, dict[int, object]]]:
    """(row from 1, cells) of a sheet: text, number or boolean by column; empty and error cells are left out."""
    shared = [text_in(e) for e in elements(book, "xl/sharedStrings.xml", f"{MAIN}si")] if "xl/sharedStrings.xml" in book.namelist() else []
    number = 0
    for row in elements(book, part, f"{MAIN}row"):
        number = int(row.get("r") or number + 1)
        cells, at = {}, -1
        for c in row.findall(f"{MAIN}c"):
            at = place_of(c.get("r")) if c.get("r") else at + 1
            kind, v, inline = c.get("t", "n"), c.find(f"{MAIN}v"), c.find(f"{MAIN}is")
            if kind == "inlineStr" and inline is not None:
                cells[at] = text_in(inline)
            elif v is not None and v.text is not None and kind != "e":
                cells[at] = shared[int(v.text)] if kind == "s" else v.text if kind in ("str", "d") else v.text == "1" if kind == "b" else float(v.text)
        if cells:
            yield number, cells


def first_day(book: zipfile.ZipFile) -> datetime.datetime:
    """Day zero of the workbook's dates."""
    late = any(e.get("date1904") in ("1", "true") for e in elements(book, "xl/workbook.xml", f"{MAIN}workbookPr"))
    return datetime.datetime(1904, 1, 1) if late else datetime.datetime(1899, 12, 30)


def number_text(v: float) -> str:
    return str(int(v)) if v.is_integer() and abs(v) < 1e15 else repr(v)


def as_kind(v: object, kind: T.DataType, zero: datetime.datetime) -> object:
    """A cell as a value of the type, or None."""
    try:
        if isinstance(kind, T.StringType):
            return ("TRUE" if v else "FALSE") if isinstance(v, bool) else number_text(v) if isinstance(v, float) else v
        if isinstance(kind, T.BooleanType):
            return v if isinstance(v, bool) else {"true": True, "false": False}.get(v.strip().lower()) if isinstance(v, str) else None
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            at = zero + datetime.timedelta(days=v) if isinstance(v, float) else datetime.datetime.fromisoformat(v.strip()) if isinstance(v, str) else None
            at = at and at + datetime.timedelta(microseconds=500)
            at = at and at.replace(microsecond=at.microsecond // 1000 * 1000)
            return at.date() if at and isinstance(kind, T.DateType) else at
        if isinstance(v, bool):
            return None
        n = float(v)
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return n
        return int(v) if isinstance(v, str) and v.strip().lstrip("+-").isdigit() else int(n) if n.is_integer() else None
    except (ValueError, OverflowError):
        return None


def header_of(path: str, sheet: str | None, skip: int) -> list[str]:
    """Names of the header row of the first wanted sheet; blank ones get their column's number."""
    with zipfile.ZipFile(path) as book:
        for number, cells in rows_of(book, chosen(book, sheet)[0][1]):
            if number > skip:
                return [str(as_kind(cells[i], T.StringType(), None)) if i in cells else f"_{i}" for i in range(max(cells) + 1)]
    return []


@dataclass
class Sheet(D.InputPartition):
    """A sheet of a file."""

    path: str
    part: str

    def __post_init__(self):
        super().__init__((self.path, self.part))


class WorkbookReader(D.DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.sheet, self.skip, self.path = schema, options.get("sheet"), int(options.get("header", "0")), options["path"]

    def partitions(self) -> list[Sheet]:
        out = []
        for path in files_at(self.path, ENDING):
            with zipfile.ZipFile(path) as book:
                out += [Sheet(path, part) for _, part in chosen(book, self.sheet)]
        return out

    def read(self, partition: Sheet) -> Iterator[pa.RecordBatch]:
        arrow, kinds = to_arrow_schema(self.schema), [f.dataType for f in self.schema.fields]

        def batch(rows: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, k.type) for v, k in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

        with zipfile.ZipFile(partition.path) as book:
            zero, places, rows = first_day(book), None, []
            for number, cells in rows_of(book, partition.part):
                if number <= self.skip:
                    continue
                if places is None:
                    names = {}
                    for i, v in cells.items():
                        names.setdefault(as_kind(v, T.StringType(), zero), i)
                    places = [names.get(f.name, place_of_unnamed(f.name)) for f in self.schema.fields]
                    continue
                rows.append([as_kind(cells[i], k, zero) if i in cells else None for i, k in zip(places, kinds, strict=True)])
                if len(rows) >= ROWS:
                    yield batch(rows)
                    rows = []
            if rows and kinds:
                yield batch(rows)


def place_of_unnamed(name: str) -> int:
    """The column that header_of called by its number, or none."""
    return int(name[1:]) if re.fullmatch("_[0-9]+", name) else -1


class WorkbookWriter(FolderWriter):
    ending = ENDING

    def __init__(self, schema: T.StructType, options: dict[str, str], overwrite: bool):
        super().__init__(options["path"], overwrite)
        self.sheet, self.title, self.schema = options.get("sheet") or "Sheet1", options.get("title"), schema

    def fill(self, path: str, batches: Iterator[pa.RecordBatch]) -> None:
        """A workbook with one sheet; title, if there is one, is a row above the header. Texts are written in the cells."""
        names = {
            "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{KINDS}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{KINDS}.worksheet+xml"/></Types>',
            "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{LINKS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{LINKS}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/workbook.xml": f'<workbook xmlns="{SPACE}" xmlns:r="{LINKS}"><sheets><sheet name={quoteattr(self.sheet)} sheetId="1" r:id="rId1"/></sheets></workbook>',
        }
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
            for name, text in names.items():
                book.writestr(name, text)
            with book.open("xl/worksheets/sheet1.xml", "w") as f:
                f.write(f'<worksheet xmlns="{SPACE}"><sheetData>'.encode())
                for cells in ([[self.title]] if self.title else []) + [self.schema.names]:
                    f.write(row_xml(cells))
                for b in batches:
                    for cells in zip(*(c.to_pylist() for c in b.columns), strict=True):
                        f.write(row_xml(cells))
                f.write(b"</sheetData></worksheet>")


def row_xml(cells: list) -> bytes:
    return ("<row>" + "".join(map(cell_xml, cells)) + "</row>").encode()


def cell_xml(v: object) -> str:
    if v is None:
        return "<c/>"
    if isinstance(v, bool):
        return f'<c t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)) and (not isinstance(v, int) or abs(v) < 1 << 53):
        return f"<c><v>{v!r}</v></c>" if v == v and abs(v) != float("inf") else '<c t="e"><v>#NUM!</v></c>'
    if isinstance(v, (datetime.date, datetime.datetime)):
        return f'<c t="d"><v>{v.isoformat()}</v></c>'
    said = escape(UNFIT.sub(lambda m: f"_x{ord(m[0]):04X}_", str(v)))
    return f'<c t="inlineStr"><is><t xml:space="preserve">{said}</t></is></c>'


class WorkbookSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "loom_workbook"

    def schema(self) -> T.StructType:
        names = header_of(files_at(self.options["path"], ENDING)[0], self.options.get("sheet"), int(self.options.get("header", "0")))
        return T.StructType([T.StructField(n, T.StringType()) for n in names])

    def reader(self, schema: T.StructType) -> WorkbookReader:
        return WorkbookReader(schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(schema, self.options, overwrite)


def read_sheet(spark: SparkSession, path: str, sheet: str | None = None, header: int = 0, schema: str | None = None) -> DataFrame:
    """Rows of a sheet of one or more workbooks; see the module."""
    spark.dataSource.register(WorkbookSource)
    reader = spark.read.format("loom_workbook").option("header", header)
    reader = reader.option("sheet", sheet) if sheet else reader
    return (reader.schema(schema) if schema else reader).load(path)


def write_sheet(df: DataFrame, path: str, sheet: str = "Sheet1", title: str | None = None, mode: str = "append") -> None:
    """df as workbooks of one sheet in a folder, one file a partition; title: a row above the header."""
    df.sparkSession.dataSource.register(WorkbookSource)
    writer = df.write.format("loom_workbook").option("sheet", sheet)
    (writer.option("title", title) if title else writer).mode(mode).save(path)

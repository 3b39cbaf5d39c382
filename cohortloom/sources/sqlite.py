"""SQLite files as a Spark data source and sink.

    spark.read.format("loom_sqlite").option("table", "samples").load(path)
    df.write.format("loom_sqlite").option("table", "samples").mode("append").save(folder)

path: a file, a folder of *.sqlite files or a pattern, which all executors can open. One of two options says what is read:
table, or query (a SELECT). The schema comes from the catalogue's declared types unless one is given; a given schema names the
columns that are read, and no others reach Python. A table is split by row ids, `partitions` to a file (default 4); a view, a
query or a table without row ids is one partition a file. Filters that Spark can hand over become part of the
statement; Spark applies them once more, so they only need to keep what it keeps.

SQLite stores any type in any column. A value that is not of the column's type is null.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Iterator, Sequence
from contextlib import closing
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .folder import FolderWriter, files_at

ENDING = ".sqlite"
#: Rows of a batch.
ROWS = 10_000
#: By the first that a declared type contains, as SQLite decides on its affinities.
DECLARED = (("INT", T.LongType()), ("CHAR", T.StringType()), ("CLOB", T.StringType()), ("TEXT", T.StringType()), ("BLOB", T.BinaryType()), ("REAL", T.DoubleType()), ("FLOA", T.DoubleType()), ("DOUB", T.DoubleType()), ("BOOL", T.BooleanType()), ("NUM", T.DoubleType()), ("DEC", T.DoubleType()), ("DATE", T.StringType()), ("TIME", T.StringType()))
STORED = {"integer": T.LongType(), "real": T.DoubleType(), "text": T.StringType(), "blob": T.BinaryType()}
TO_SQLITE = {T.ByteType: "INTEGER", T.ShortType: "INTEGER", T.IntegerType: "INTEGER", T.LongType: "INTEGER", T.BooleanType: "BOOLEAN", T.FloatType: "REAL", T.DoubleType: "REAL", T.StringType: "TEXT", T.BinaryType: "BLOB", T.DateType: "DATE", T.TimestampType: "TIMESTAMP"}
#: What a stored value must be to stand for a column's type.
FITS = {T.LongType: int, T.IntegerType: int, T.ShortType: int, T.ByteType: int, T.DoubleType: (int, float), T.FloatType: (int, float), T.StringType: str, T.BinaryType: bytes, T.BooleanType: int}


def named(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def opened(path: str) -> sqlite3.Connection:
    """A connection that cannot change the file."""
    return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)


def source_of(options: dict[str, str]) -> str:
    table, query = options.get("table"), options.get("query")
    if bool(table) == bool(query):
        raise ValueError("give either table or query")
    return named(table) if table else f"({query})"


def schema_of(path: str, options: dict[str, str], others: Sequence[str] = ()) -> T.StructType:
    """Columns and types by the first file's catalogue; a column without a declared type has that of its first value that is not null
    in any of the files, as files may be empty, or is text."""
    columns: dict[str, T.DataType | None] = {}
    for at in (path, *others):
        with closing(opened(at)) as db:
            db.execute(f"CREATE TEMP VIEW loom_source AS SELECT * FROM {source_of(options)}")
            if not columns:
                columns = {name: next((t for part, t in DECLARED if part in declared.upper()), None) for _, name, declared, *_ in db.execute("PRAGMA table_info(loom_source)").fetchall()}
            unknown = [n for n, t in columns.items() if t is None]
            for stored in db.execute(f"SELECT {', '.join(f'typeof({named(n)})' for n in unknown)} FROM loom_source") if unknown else ():
                columns |= {n: STORED[s] for n, s in zip(unknown, stored, strict=True) if columns[n] is None and s in STORED}
                if None not in columns.values():
                    break
        if None not in columns.values():
            break
    return T.StructType([T.StructField(n, t or T.StringType()) for n, t in columns.items()])


def condition(f: D.Filter, kinds: dict[str, T.DataType]) -> tuple[str, list] | None:
    """SQL and its values that hold for all rows for which the filter does, or None. (A null of Spark's may be a stored value of another type.)"""
    if isinstance(f, D.Not):
        # only what is exact can be turned round
        inner = condition(f.child, kinds) if isinstance(f.child, (D.EqualTo, D.In)) else None
        return (f"NOT ({inner[0]})", inner[1]) if inner else None
    name = f.attribute[0] if len(f.attribute) == 1 else None
    if name not in kinds:
        return None
    column, kind = named(name), kinds[name]
    if isinstance(f, D.IsNotNull):
        return f"({column} IS NOT NULL)", []
    if isinstance(f, D.IsNull):
        return None
    values = list(f.value) if isinstance(f, D.In) else [f.value]
    if not isinstance(kind, (T.LongType, T.DoubleType, T.StringType)) or not all(isinstance(v, FITS[type(kind)]) and not isinstance(v, bool) for v in values):
        return None
    if isinstance(kind, T.StringType):
        column += " COLLATE BINARY"
    if isinstance(f, D.In):
        return (f"({column} IN ({', '.join('?' * len(values))}))", values) if len(values) <= 500 else None
    signs = {D.EqualTo: "=", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<="}
    if type(f) in signs:
        return f"({column} {signs[type(f)]} ?)", values
    if values[0] and type(f) in (D.StringContains, D.StringStartsWith, D.StringEndsWith):
        # a match in another place than the one asked for is left to Spark
        return f"(instr({named(name)}, ?) > 0)", values
    return None


@dataclass
class Range(D.InputPartition):
    """Rows of a file with ids from low to high, or all where these are None."""

    path: str
    low: int | None = None
    high: int | None = None

    def __post_init__(self):
        super().__init__(self.path)


class SqliteReader(D.DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.options = schema, dict(options)
        self.conditions: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        kinds = {f.name: f.dataType for f in self.schema.fields}
        for f in filters:
            if found := condition(f, kinds):
                self.conditions.append(found)
            yield f  # Spark applies it as well: values of other types than the column's become null

    def partitions(self) -> list[Range]:
        pieces = int(self.options.get("partitions", "4"))
        out = []
        for path in files_at(self.options["path"], ENDING):
            span = None
            if self.options.get("table") and pieces > 1:
                with closing(opened(path)) as db:
                    try:
                        span = db.execute(f"SELECT min(rowid), max(rowid) FROM {source_of(self.options)}").fetchone()
                    except sqlite3.OperationalError:  # a view, or a table without row ids
                        span = None
            if not span or span[0] is None or isinstance(span[0], str):
                out.append(Range(path))
                continue
            step = (span[1] - span[0]) // pieces + 1
            out += [Range(path, low, min(low + step - 1, span[1])) for low in range(span[0], span[1] + 1, step)]
        return out

    def statement(self, part: Range) -> tuple[str, list]:
        """The SELECT of a partition, with its values."""
        where = [sql for sql, _ in self.conditions]
        values = [v for _, each in self.conditions for v in each]
        if part.low is not None:
            where.append("rowid BETWEEN ? AND ?")
            values += [part.low, part.high]
        columns = ", ".join(named(f.name) for f in self.schema.fields) or "NULL"
        return f"SELECT {columns} FROM {source_of(self.options)}" + (f" WHERE {' AND '.join(where)}" if where else ""), values

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(self.schema)
        fits = [FITS.get(type(f.dataType)) for f in self.schema.fields]
        with closing(opened(partition.path)) as db:
            db.text_factory = text_of
            rows = db.execute(*self.statement(partition))
            while some := rows.fetchmany(ROWS):
                columns = [column(list(v), ok, kind.type) for v, ok, kind in zip(zip(*some, strict=True), fits, arrow, strict=True)] if fits else []
                yield pa.RecordBatch.from_arrays(columns, schema=arrow) if columns else pa.RecordBatch.from_struct_array(pa.array([{}] * len(some), pa.struct([])))


def column(values: list, fits, kind: pa.DataType) -> pa.Array:
    """An array of the values that fit; others are null."""
    if fits is int and pa.types.is_boolean(kind):
        values = [bool(v) if isinstance(v, int) else None for v in values]
    else:
        values = [v if fits and isinstance(v, fits) else None for v in values]
        if pa.types.is_floating(kind):
            values = [None if v is None else float(v) for v in values]
    return pa.array(values, kind)


def text_of(stored: bytes) -> str | None:
    """Stored text; text that is no UTF-8 is null, like other values that do not fit."""
    try:
        return stored.decode()
    except UnicodeDecodeError:
        return None


class SqliteWriter(FolderWriter):
    ending = ENDING

    def __init__(self, schema: T.StructType, options: dict[str, str], overwrite: bool):
        super().__init__(options["path"], overwrite)
        self.table, self.schema = options.get("table") or "rows", schema

    def fill(self, path: str, batches: Iterator[pa.RecordBatch]) -> None:
        columns = ", ".join(f"{named(f.name)} {TO_SQLITE.get(type(f.dataType), 'TEXT')}" for f in self.schema.fields)
        plain = [type(f.dataType) in FITS for f in self.schema.fields]
        with closing(sqlite3.connect(path)) as db:
            db.execute(f"CREATE TABLE {named(self.table)} ({columns})")
            for b in batches:
                values = [c.to_pylist() if p else [None if v is None else str(v) for v in c.to_pylist()] for c, p in zip(b.columns, plain, strict=True)]
                db.executemany(f"INSERT INTO {named(self.table)} VALUES ({', '.join('?' * len(values))})", zip(*values, strict=True))
            db.commit()


class SqliteSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "loom_sqlite"

    def schema(self) -> T.StructType:
        first, *others = files_at(self.options["path"], ENDING)
        return schema_of(first, self.options, others)

    def reader(self, schema: T.StructType) -> SqliteReader:
        return SqliteReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> SqliteWriter:
        return SqliteWriter(schema, self.options, overwrite)


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(SqliteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def read_sqlite(spark: SparkSession, path: str, table: str | None = None, query: str | None = None, schema: str | None = None, partitions: int = 4) -> DataFrame:
    """Rows of a table, or of a SELECT, of SQLite files; see the module."""
    reader = registered(spark).read.format("loom_sqlite").option("partitions", partitions)
    reader = reader.option("table", table) if table else reader
    reader = reader.option("query", query) if query else reader
    return (reader.schema(schema) if schema else reader).load(path)


def write_sqlite(df: DataFrame, path: str, table: str, mode: str = "append") -> None:
    """df as a table in SQLite files of a folder, one file a partition."""
    registered(df.sparkSession)
    df.write.format("loom_sqlite").option("table", table).mode(mode).save(path)

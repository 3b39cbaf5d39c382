"""SQLite files and workbooks as sources and sinks."""

import datetime
import os
import sqlite3
import zipfile

import pytest
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from cohortloom.sources import folder, sqlite, workbook


@pytest.fixture
def samples(tmp_path):
    path = tmp_path / "s.sqlite"
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE runs (id INTEGER PRIMARY KEY, name TEXT, depth REAL, raw BLOB, ok BOOLEAN, "odd ""name" VARCHAR(9), made DATE, free)')
        db.executemany("INSERT INTO runs VALUES (?, ?, ?, ?, ?, ?, ?, ?)", [(i, f"run{i}", i / 4, b"\x00\xff", i % 2, None, "2024-01-02", i) for i in range(100)])
        db.execute("INSERT INTO runs VALUES (1000000, 'far', 'no number', 'text', 'x', x'00', NULL, NULL)")
        db.execute("CREATE VIEW deep AS SELECT id, depth FROM runs WHERE depth > 20")
        db.execute("CREATE TABLE keyed (k TEXT PRIMARY KEY, v INT) WITHOUT ROWID")
        db.execute("INSERT INTO keyed VALUES ('a', 1), ('b', 2)")
        db.execute("CREATE TABLE none (v INT)")
    return str(path)


def test_schema_comes_from_the_catalogue(spark, samples):
    df = sqlite.read_sqlite(spark, samples, "runs")
    assert df.dtypes == [("id", "bigint"), ("name", "string"), ("depth", "double"), ("raw", "binary"), ("ok", "boolean"), ('odd "name', "string"), ("made", "string"), ("free", "bigint")]
    rows = {r["id"]: r for r in df.collect()}
    assert len(rows) == 101 and tuple(rows[3])[:5] == (3, "run3", 0.75, bytearray(b"\x00\xff"), True)
    # values that are not of the column's type
    assert tuple(rows[1000000]) == (1000000, "far", None, None, None, None, None, None)


def test_partitions_are_ranges_of_row_ids(spark, samples):
    options = {"path": samples, "table": "runs", "partitions": "5"}
    reader = sqlite.SqliteReader(sqlite.schema_of(samples, options), options)
    parts = reader.partitions()
    assert len(parts) == 5 and parts[0].low == 0 and parts[-1].high == 1000000
    assert all(a.high + 1 == b.low for a, b in zip(parts[:-1], parts[1:], strict=True))
    assert sqlite.read_sqlite(spark, samples, "runs", partitions=5).rdd.getNumPartitions() == 5
    # text is more than any number in the view's own condition
    for name, n in (("deep", 20), ("keyed", 2), ("none", 0)):
        assert sqlite.read_sqlite(spark, samples, name).count() == n


def test_filters_and_columns_reach_the_statement(samples):
    options = {"path": samples, "table": "runs"}
    schema = sqlite.T.StructType.fromDDL("name string, depth double")
    reader = sqlite.SqliteReader(schema, options)
    asked = [D.GreaterThan(("depth",), 3.0), D.In(("name",), ("run14", "run15")), D.Not(D.EqualTo(("name",), "x")), D.StringStartsWith(("name",), "run"), D.IsNotNull(("depth",)), D.EqualTo(("elsewhere",), 1), D.Not(D.GreaterThan(("depth",), 50.0))]
    assert list(reader.pushFilters(asked)) == asked  # Spark applies them again
    sql, values = reader.statement(sqlite.Range(samples, 5, 9))
    assert sql == 'SELECT "name", "depth" FROM "runs" WHERE ("depth" > ?) AND ("name" COLLATE BINARY IN (?, ?)) AND NOT (("name" COLLATE BINARY = ?)) AND (instr("name", ?) > 0) AND ("depth" IS NOT NULL) AND rowid BETWEEN ? AND ?'
    assert values == [3.0, "run14", "run15", "x", "run", 5, 9]
    reader = sqlite.SqliteReader(schema, options)
    list(reader.pushFilters(asked[:2]))
    assert [b.num_rows for b in reader.read(sqlite.Range(samples))] == [2]


def test_filters_give_what_spark_gives(spark, samples):
    df = sqlite.read_sqlite(spark, samples, "runs")
    held = spark.createDataFrame(df.collect(), df.schema)
    for where in ("depth > 20", "depth <= 1.5 AND name LIKE 'run%'", "NOT name = 'far'", "name IS NULL OR depth < 1", "name >= 'run9'", "NOT (depth > 3)", "ok", "name LIKE '%9'", "id IN (1, 5, 1000000)", "depth IS NULL", "name <=> 'far'"):
        assert sorted(r["id"] for r in df.where(where).collect()) == sorted(r["id"] for r in held.where(where).collect()), where


def test_queries_and_given_schemas(spark, samples):
    df = sqlite.read_sqlite(spark, samples, query="SELECT ok, count(*) AS n, 'x' AS t FROM runs WHERE id < 100 GROUP BY ok")
    assert sorted(tuple(r) for r in df.collect()) == [(False, 50, "x"), (True, 50, "x")]
    assert sqlite.read_sqlite(spark, samples, "runs", schema="name string").columns == ["name"]
    with pytest.raises(Exception, match="either table or query"):
        sqlite.read_sqlite(spark, samples).count()


def test_sqlite_round_trip(spark, tmp_path):
    df = spark.range(50).select("id", F.when(F.col("id") > 5, F.concat(F.lit("é\n'"), "id")).alias("s"), (F.col("id") / 3).alias("x"), F.col("id") % 2 == 0, F.lit(datetime.date(2020, 1, 2)).alias("d")).toDF("id", "s", "x", "even", "d")
    out = str(tmp_path / "out")
    sqlite.write_sqlite(df.repartition(3), out, "t")
    assert len(os.listdir(out)) == 3 and all(f.endswith(".sqlite") for f in os.listdir(out))
    key = lambda r: r[0]
    want = [(r["id"], r["s"], r["x"], r["even"], str(r["d"])) for r in df.collect()]
    assert sorted((tuple(r) for r in sqlite.read_sqlite(spark, out, "t").collect()), key=key) == want
    sqlite.write_sqlite(df.limit(2), out, "t", mode="overwrite")
    assert sqlite.read_sqlite(spark, out, "t").count() == 2
    with pytest.raises(ValueError, match="mount"):
        folder.local_path("hdfs://x/y")
    assert folder.local_path("file:///a%20b") == "/a b"


def made_workbook(path):
    """A workbook as other programs write it: shared strings in runs, gaps, formulas, errors, two sheets, dates as serial days."""
    m, r = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {m} {r}><workbookPr/><sheets><sheet name="notes" sheetId="1" r:id="rId1"/><sheet name="taxa v2" sheetId="2" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/other.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {m}><si><t>taxon</t></si><si><r><t>E. </t></r><r><t>coli</t></r><rPh><t>no</t></rPh></si><si><t>size</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {m}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>hello</t></is></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/other.xml", f"""<worksheet {m}><sheetData>
            <row r="1"><c r="A1" t="str"><v>made by hand</v></c></row>
            <row r="3"><c r="A3" t="s"><v>0</v></c><c r="C3" t="s"><v>2</v></c><c r="D3" t="str"><v>day</v></c><c r="AA3" t="str"><v>far</v></c></row>
            <row r="4"><c r="A4" t="s"><v>1</v></c><c r="C4"><f>1+1</f><v>2</v></c><c r="D4"><v>45293.5</v></c><c r="AA4" t="b"><v>1</v></c></row>
            <row r="5"/>
            <row r="6"><c r="A6"><v>7</v></c><c r="B6" t="str"><v>unnamed</v></c><c r="C6" t="e"><v>#N/A</v></c><c r="D6" t="d"><v>2024-02-03</v></c></row>
        </sheetData></worksheet>""")


def test_named_sheet_below_a_title(spark, tmp_path):
    path = str(tmp_path / "x.xlsx")
    made_workbook(path)
    df = workbook.read_sheet(spark, path, "taxa v2", header=2, schema="size int, taxon string, far boolean, day date, gone double")
    assert [tuple(r) for r in df.collect()] == [(2, "E. coli", True, datetime.date(2024, 1, 2), None), (None, "7", None, datetime.date(2024, 2, 3), None)]
    free = workbook.read_sheet(spark, path, "taxa*", header=2)
    assert free.columns[:4] == ["taxon", "_1", "size", "day"] and len(free.columns) == 27
    assert [(r["taxon"], r["_1"], r["far"]) for r in free.collect()] == [("E. coli", None, "TRUE"), ("7", "unnamed", None)]
    assert workbook.read_sheet(spark, path).columns == ["hello"] and workbook.read_sheet(spark, path).count() == 0
    with pytest.raises(Exception, match="no sheet"):
        workbook.read_sheet(spark, path, "absent").count()


def test_workbook_round_trip(spark, tmp_path):
    rows = [(1, "plain", 1.5, True), (2, " <&> \"' é\t_x0041_ \x07", -2e300, False), (3, None, None, None), (1 << 60, "", 0.1, True)]
    df = spark.createDataFrame(rows, "id long, s string, x double, b boolean")
    out = str(tmp_path / "w")
    workbook.write_sheet(df.repartition(2), out, "data", title="top")
    back = workbook.read_sheet(spark, out, "data", header=1, schema="id long, s string, x double, b boolean")
    assert back.rdd.getNumPartitions() == 2
    assert sorted(tuple(r) for r in back.collect()) == rows

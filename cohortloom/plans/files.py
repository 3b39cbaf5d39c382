"""Queries of sources and sinks: tables of the star schema are written in a format and read back by the reader under test."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortloom.functions import expr as X
from cohortloom.functions.store import shared_folder
from cohortloom.sources import tables
from cohortloom.sources.sqlite import read_sqlite, write_sqlite
from cohortloom.sources.workbook import read_sheet, write_sheet

from .registry import query, table

c = F.col
N = lambda: F.count(F.lit(1))


def _place(spark) -> str:
    """A new folder in the shared checkpoint folder; in local mode, as in tests, a temporary one where none is set."""
    base = shared_folder(spark)
    return f"{base.rstrip('/')}/files-{uuid.uuid4().hex}"


@query("""SELECT o_orderkey AS entity, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS status, o_totalprice AS price FROM orders""")
def io1_io2_io4_io8_delimited(spark, d):
    path = _place(spark)
    rows = table(spark, d, "orders").select("o_orderkey", F.when(c("o_orderstatus") == "P", "NA").otherwise(c("o_orderstatus")).alias("o_orderstatus"), "o_totalprice", "o_orderpriority")
    tables.write_delim(rows, path, gzip=True)
    columns = {"o_orderkey": "entity", "o_orderstatus": "status", "o_totalprice": "price"}
    return tables.read_delim(spark, path, "o_orderkey long, o_orderstatus string, o_totalprice double, o_orderpriority string", nulls=["NA", "-"], columns=columns)


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 3 THEN NULL ELSE c_nationkey END AS nation, c_custkey % 10 = 3 AS bad FROM customer WHERE c_custkey % 7 <> 0""")
def io3_io6_io7_headerless(spark, d):
    path = _place(spark)
    nation = F.when(c("c_custkey") % 10 == 3, "x?").otherwise(c("c_nationkey").cast("string"))
    line = F.concat(F.when(c("c_custkey") % 7 == 0, "!").otherwise(""), c("c_custkey").cast("string"), F.lit("\t"), nation)
    table(spark, d, "customer").select(line.alias("value")).write.text(path)
    rows = tables.read_delim(spark, path, "id long, nation int", header=False, comment="!", bad_rows="raw")
    return rows.select("id", "nation", c("raw").isNotNull().alias("bad"))


@query("""SELECT s_suppkey AS id, s_acctbal AS balance FROM supplier""")
def io5_io23_preamble(spark, d):
    path = _place(spark)
    line = F.concat(c("s_suppkey").cast("string"), F.lit("\t"), c("s_acctbal").cast("string"))
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0  # of each partition, which makes a file
    table(spark, d, "supplier").select(F.when(first, F.concat(F.lit("tool 1.0\n# made today\nID\tBALANCE\n"), line)).otherwise(line).alias("value")).write.text(path)
    return tables.read_after_preamble(spark, path, "ID\t", "id long, balance double")


@query("""SELECT o_orderstatus AS sample, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_totalprice > 50000 GROUP BY 1""")
def io10_io14_many_files(spark, d):
    path = _place(spark)
    table(spark, d, "orders").withColumn("sample", c("o_orderstatus")).write.partitionBy("sample").option("sep", "\t").csv(path)
    rows = tables.with_sample(tables.read_delim(spark, f"{path}/*/*.csv", "key long, cust long, status string, price double, day string, priority string", header=False), "sample=(\\w+)/")
    return rows.where("price > 50000").groupBy("sample").agg(N().alias("n"), F.round(F.sum("price"), 2).alias("total"))


@query("""SELECT l_returnflag, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS qty FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 GROUP BY 1""")
def io11_io13_io17_slim_copy(spark, d):
    path = _place(spark)
    build = lambda: table(spark, d, "lineitem").select("l_returnflag", "l_quantity")
    tables.cached(spark, path, build)
    slim = tables.cached(spark, path, build)  # the second call reads
    tables.sql_copy(spark, {"loom_slim": slim}, "SELECT l_returnflag, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS qty FROM loom_slim WHERE l_quantity BETWEEN 10 AND 20 GROUP BY l_returnflag", f"{path}-sql")
    return spark.read.parquet(f"{path}-sql")


@query("""WITH x AS (SELECT p_partkey // 8 AS k, count(*) AS n FROM part WHERE p_size < 40 GROUP BY 1), r AS (SELECT n, count(*) AS clusters FROM x GROUP BY 1 UNION ALL SELECT 1, (SELECT count(*) FROM part WHERE p_size >= 40)) SELECT n AS members, CAST(sum(clusters) AS BIGINT) AS clusters FROM r GROUP BY 1""")
def io21_ud5_cluster_lines(spark, d):
    path = _place(spark)
    part = table(spark, d, "part").select(c("p_partkey").cast("string").alias("entity"), F.floor(c("p_partkey") / 8).alias("k"), "p_size")
    part.where("p_size < 40").groupBy("k").agg(F.concat_ws(" ", F.collect_list("entity")).alias("value")).select("value").write.text(path)
    clusters = tables.read_clusters(spark, path, part)
    return clusters.groupBy("cluster_id").agg(N().alias("members")).groupBy("members").agg(N().alias("clusters"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS id FROM part WHERE p_size > 30""")
def io22_io26_fasta_ids(spark, d):
    path = _place(spark)
    part = table(spark, d, "part").where("p_size > 30")
    tables.write_ids(part.select(F.concat(F.lit(">"), c("p_partkey").cast("string"), F.lit(" "), c("p_name"), F.lit("\nACGT")).alias("id")), "id", path)
    return tables.fasta_ids(spark, path)


@query("""SELECT item_id, length(text) AS n_chars, NULL::VARCHAR AS note FROM benchmark""")
def io16_p5_optional(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", F.length("text").cast("long").alias("n_chars"))
    notes = tables.optional(spark, f"{_place(spark)}/*.tsv", "item_id long, note string")
    return rows.join(notes, "item_id", "left").select("item_id", "n_chars", X.null_tokens("note").alias("note"))


@query("""SELECT CAST(s_suppkey AS INTEGER) AS id, s_name AS name FROM supplier""")
def io20_xml(spark, d):
    path = _place(spark)
    record = F.format_string("<rec><id>%d</id><name>%s</name></rec>", "s_suppkey", "s_name")
    # a file for each thousand suppliers, with one root element
    rows = table(spark, d, "supplier").select(F.floor(c("s_suppkey") / 1000).alias("part"), "s_suppkey", record.alias("rec"))
    order = Window.partitionBy("part").orderBy("s_suppkey")
    first, last = F.lag("rec").over(order).isNull(), F.lead("rec").over(order).isNull()
    lines = rows.select("part", "s_suppkey", F.concat(F.when(first, "<set>\n").otherwise(""), c("rec"), F.when(last, "\n</set>").otherwise("")).alias("value"))
    lines.sortWithinPartitions("part", "s_suppkey").drop("s_suppkey").write.partitionBy("part").text(path)
    return tables.read_xml(spark, path, "rec", "id int, name string").select("id", "name")


@query("""SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_orderkey) AS first_key, count(CASE WHEN o_orderpriority LIKE '%URGENT%' THEN 1 END) AS urgent FROM orders WHERE o_totalprice >= 150000 AND o_orderstatus IN ('O', 'F') GROUP BY 1""")
def io18_sqlite(spark, d):
    path = _place(spark)
    write_sqlite(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"), path, "orders")
    # both filters reach the files' SELECT statements, which run over ranges of row ids
    rows = read_sqlite(spark, path, "orders").where((c("o_totalprice") >= 150000.0) & c("o_orderstatus").isin("O", "F"))
    return rows.groupBy(c("o_orderstatus").alias("status")).agg(N().alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.min("o_orderkey").alias("first_key"), F.count_if(c("o_orderpriority").contains("URGENT")).alias("urgent"))


@query("""SELECT n_name AS nation, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY 1""")
def io18_sqlite_query(spark, d):
    path = _place(spark)
    write_sqlite(table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), path, "customer")
    rows = read_sqlite(spark, path, query="SELECT c_nationkey AS nation, count(*) AS n, sum(c_acctbal) AS balance FROM customer WHERE c_acctbal > 0 GROUP BY 1")
    names = table(spark, d, "nation").select(c("n_nationkey").cast("long").alias("nation"), "n_name")
    return rows.join(names, "nation").groupBy(c("n_name").alias("nation")).agg(F.sum("n").alias("customers"), F.round(F.sum("balance"), 2).alias("balance"))


@query("""SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, s_acctbal > 0 AS owed, NULL::VARCHAR AS note FROM supplier""")
def io19_workbook(spark, d):
    path = _place(spark)
    rows = table(spark, d, "supplier").select(c("s_suppkey").alias("key"), c("s_name").alias("name"), c("s_acctbal").alias("balance"), (c("s_acctbal") > 0).alias("owed"))
    write_sheet(rows, path, "suppliers", title="Suppliers & balances")
    sheet = read_sheet(spark, path, "supp*", header=1, schema="key long, name string, balance double, owed boolean, note string")
    return sheet.withColumnRenamed("key", "id")


@query("""SELECT count(*) AS columns, string_agg(column_name, ',' ORDER BY column_index) AS names, (SELECT count(*) FROM region) AS n FROM duckdb_columns() WHERE table_name = 'region'""")
def io9_header_probe(spark, d):
    path = _place(spark)
    tables.write_delim(table(spark, d, "region"), path)
    names = tables.columns_of(spark, path)
    # the probe's names are the schema of the read that follows
    rows = tables.read_delim(spark, path, ", ".join(f"{n} string" for n in names))
    return rows.agg(F.lit(len(names)).cast("long").alias("columns"), F.lit(",".join(names)).alias("names"), N().alias("n"))

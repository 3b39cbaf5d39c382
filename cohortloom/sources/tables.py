"""Delimited, line and XML inputs, and the sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.functions import expr as X
from cohortloom.operators.windows import blocked_sums


def read_delim(spark: SparkSession, path: str | list[str], schema: str, sep: str = "\t", header: bool = True, nulls: Sequence[str] = (), comment: str | None = None, bad_rows: str | None = None, columns: dict[str, str] | None = None) -> DataFrame:
    """Delimited text, compressed or not, under a declared schema.

    header=False takes names by position. nulls: further tokens that mean null. bad_rows: a column for the text
    of lines that do not fit; without it their unreadable fields are null. columns: the wanted ones, as name to
    new name. The Spark reader prunes the others.
    """
    kind = T.StructType.fromDDL(schema)
    if bad_rows:
        kind = kind.add(bad_rows, T.StringType())
    reader = spark.read.schema(kind).option("sep", sep).option("header", header).option("mode", "PERMISSIVE").option("enforceSchema", True)
    if comment:
        reader = reader.option("comment", comment)
    if bad_rows:
        reader = reader.option("columnNameOfCorruptRecord", bad_rows)
    df = reader.csv(path)
    if nulls:
        df = df.withColumns({f.name: X.null_tokens(f.name, nulls) for f in kind.fields if isinstance(f.dataType, T.StringType) and f.name != bad_rows})
    return df.select(*(F.col(a).alias(b) for a, b in columns.items())) if columns else df


def columns_of(spark: SparkSession, path: str, sep: str = "\t") -> list[str]:
    """Column names of a delimited file with a header; reads one line."""
    line = spark.read.text(path).limit(1).first()
    return line[0].split(sep) if line else []


def read_after_preamble(spark: SparkSession, path: str, header_prefix: str, schema: str, sep: str = "\t") -> DataFrame:
    """A delimited file whose header line begins with the prefix, after any number of other lines.

    Lines keep their order by file offset, so large files are read in parallel.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.monotonically_increasing_id().alias("_i"))
    start = lines.where(F.col("value").startswith(header_prefix)).groupBy("_f").agg(F.min("_i").alias("_s"))
    body = lines.join(F.broadcast(start), "_f").where(F.col("_i") > F.col("_s"))  # one row a file
    fields = T.StructType.fromDDL(schema).fields
    parts = F.split("value", sep)
    return body.select(*(F.get(parts, F.lit(i)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(fields)))


def read_white_space(spark: SparkSession, path: str, schema: str, comment: str = "#") -> DataFrame:
    """White-space separated columns; comment and blank lines go."""
    rows = spark.read.text(path).where(~F.col("value").startswith(comment) & (F.trim("value") != ""))
    parts = F.split(F.trim("value"), r"\s+")
    return rows.select(*(F.get(parts, F.lit(i)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(T.StructType.fromDDL(schema).fields)))


def with_sample(df: DataFrame, pattern: str, name: str = "sample") -> DataFrame:
    """The sample id from the path of each row's file; df comes straight from a reader."""
    return df.withColumn(name, X.extract_group(F.col("_metadata.file_path"), pattern))


def optional(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """read_delim, or an empty table of the schema if there is nothing at path (in any store that Spark reaches)."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    return read_delim(spark, path, schema, **options) if found else spark.createDataFrame([], schema)


def cached(spark: SparkSession, path: str, build) -> DataFrame:
    """A slim Parquet copy that is built once and read from then on."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def sql_copy(spark: SparkSession, views: dict[str, DataFrame], sql: str, path: str) -> None:
    """The rows of a query over the tables as Parquet."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    spark.sql(sql).write.mode("overwrite").parquet(path)


def read_database(spark: SparkSession, url: str, sql: str, driver: str | None = None, **options) -> DataFrame:
    """A query at a database; needs its JDBC driver on the class path."""
    reader = spark.read.format("jdbc").option("url", url).option("query", sql).options(**options)
    return (reader.option("driver", driver) if driver else reader).load()


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def read_clusters(spark: SparkSession, path: str, universe: DataFrame | None = None, key: str = "entity") -> DataFrame:
    """(cluster_id, entity) of a file with one cluster a line, members white-space separated; the id is the line's number from 0.

    Members of the universe on no line become singletons with ids that follow.
    """
    lines = spark.read.text(path).withColumn("_i", F.monotonically_increasing_id()).where(F.trim("value") != "")
    # number lines by partition totals: ids of a partition share their upper bits
    part = F.shiftright("_i", 33)
    totals = lines.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = lines.withColumn("_p", part).join(F.broadcast(totals.select("_p", before.alias("_b"))), "_p")  # one row a partition
    numbered = numbered.withColumn("cluster_id", (F.col("_b") + F.row_number().over(Window.partitionBy("_p").orderBy("_i")) - 1).cast("long"))
    members = numbered.select("cluster_id", F.explode(F.split(F.trim("value"), r"\s+")).alias(key))
    if universe is None:
        return members
    rest = universe.select(key).distinct().join(members, key, "left_anti")
    top = members.agg(F.coalesce(F.max("cluster_id") + 1, F.lit(0)).alias("_t"))
    blocked = rest.withColumn("_p", F.pmod(F.xxhash64(key), F.lit(256)))
    base = blocked.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).select("_p", before.alias("_b"))
    singles = blocked.join(F.broadcast(base), "_p").crossJoin(F.broadcast(top)).select((F.col("_t") + F.col("_b") + F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1).cast("long").alias("cluster_id"), key)
    return members.unionByName(singles)


def fasta_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids of the header lines."""
    return spark.read.text(path).where(F.col("value").startswith(">")).select(F.get(F.split(F.expr("substring(value, 2)"), r"\s+"), F.lit(0)).alias("id")).distinct()


def mined(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """Columns from the first match of each pattern's group in a text."""
    return df.withColumns({n: X.extract_group(text, p) for n, p in patterns.items()})


def mined_logs(spark: SparkSession, path: str, start: str, fields: dict[str, str]) -> DataFrame:
    """One row for each record of log files: file, record (from 1) and the first match of each field's pattern (its group) in it.

    A record begins at a line that matches start and goes on to the next such line; lines before the first belong to none. Files are
    read by splits of any number: a split's starts are counted first, and its lines go on with the count of those before it.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_i"), "value")
    numbered = blocked_sums(lines, ["file"], "_split", ["_i"], {"record": F.col("value").rlike(start).cast("long")}).where("record > 0")
    found = [F.min_by(m, F.when(m.isNotNull(), F.struct("_split", "_i"))).alias(n) for n, m in ((n, X.extract_group("value", p)) for n, p in fields.items())]
    return numbered.groupBy("file", "record").agg(*found)


def write_delim(df: DataFrame, path: str, sep: str = "\t", gzip: bool = False) -> None:
    df.write.mode("overwrite").option("sep", sep).option("header", True).option("compression", "gzip" if gzip else "none").csv(path)


def write_ids(df: DataFrame, key: str, path: str) -> None:
    df.select(F.col(key).cast("string")).write.mode("overwrite").text(path)


def run_summary(df: DataFrame, measures: dict[str, Column], null_counts: Sequence[str] = ()) -> DataFrame:
    """One row about a table, to be written as JSON."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *(m.alias(n) for n, m in measures.items()), *(F.count_if(F.col(n).isNull()).alias(f"null_{n}") for n in null_counts))


def samplesheet(df: DataFrame, sample: str, name: Column, uris: dict[str, str], constants: dict[str, str]) -> DataFrame:
    """sample, a column for each URI template (with %s for the name), and constant columns."""
    return df.select(F.col(sample).alias("sample"), *(F.format_string(u, name).alias(n) for n, u in uris.items()), *(F.lit(v).alias(n) for n, v in constants.items()))

"""Schemas, unions, reshaping and set overlaps."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def literals(spark: SparkSession, name: str, values: Sequence[float]) -> DataFrame:
    """A table of the given numbers, made on the JVM side."""
    return spark.range(1).select(F.explode(F.array(*(F.lit(float(v)) for v in values))).alias(name))


def drop_present(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*[n for n in names if n in df.columns])


def to_schema(df: DataFrame, ddl: str) -> DataFrame:
    """The columns of the schema in its order and types; missing ones are null."""
    fields = T.StructType.fromDDL(ddl).fields
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))


def stack(tables: Sequence[DataFrame], diagonal: bool = False) -> DataFrame:
    """Rows of all tables by name; diagonal: columns that a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=diagonal), tables)


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def pivot(df: DataFrame, by: Sequence[str], key: str, keys: Sequence, agg: Column, fill: float | None = 0) -> DataFrame:
    """One column a key in the given order; the list of keys saves a pass over the data."""
    out = df.groupBy(*by).pivot(key, list(keys)).agg(agg)
    return out if fill is None else out.na.fill(fill)


def reindex(df: DataFrame, domain: DataFrame, keys: Sequence[str], fill: dict) -> DataFrame:
    """One row for each key of the domain; values that df lacks are filled."""
    return domain.join(df, list(keys), "left").na.fill(fill)


def densify(df: DataFrame, left: DataFrame, right: DataFrame, keys: Sequence[str], fill: dict) -> DataFrame:
    """df over all pairs of two small domains (right is a list of categories)."""
    return reindex(df, left.crossJoin(F.broadcast(right)), keys, fill)


def row_shares(df: DataFrame, by: str, key: str, keys: Sequence) -> DataFrame:
    """Crosstab with each row divided by its sum."""
    counts = pivot(df, [by], key, keys, F.count(F.lit(1)))
    total = reduce(lambda a, b: a + b, (F.col(f"`{k}`") for k in keys))
    return counts.select(by, *(F.try_divide(F.col(f"`{k}`"), total).alias(str(k)) for k in keys))


def set_overlap(df: DataFrame, entity: str, group: str, sets: Sequence[str]) -> DataFrame:
    """How many entities are in exactly each combination of the sets (flags, n)."""
    flags = df.groupBy(entity).agg(*(F.max((F.col(group) == s).cast("int")).alias(f"in_{s}") for s in sets))
    return flags.groupBy(*(f"in_{s}" for s in sets)).agg(F.count(F.lit(1)).alias("n"))


def incremental_coverage(df: DataFrame, entity: str, method: str, order: Sequence[str]) -> DataFrame:
    """New entities that each method adds in the given order, and their running total."""
    position = F.lit(None).cast("int")
    for i, m in enumerate(order):
        position = F.when(F.col(method) == m, F.lit(i)).otherwise(position)
    first = df.withColumn("_i", position).where("_i IS NOT NULL").groupBy(entity).agg(F.min("_i").alias("_i"))
    counts = first.groupBy("_i").agg(F.count(F.lit(1)).alias("added"))
    names = F.array(*map(F.lit, order))
    running = F.sum("added").over(Window.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))  # one row a method
    return counts.select(F.get(names, F.col("_i")).alias("method"), "added", running.alias("covered"))


def rank_ladder(df: DataFrame, ids: Sequence[str], ranks: Sequence[str], rank: str = "rank", taxon: str = "taxon") -> DataFrame:
    """Rank columns as (rank, taxon) rows, so that one aggregate serves all ranks."""
    return df.select(*ids, *(F.col(r).cast("string").alias(r) for r in ranks)).unpivot(list(ids), list(ranks), rank, taxon).where(F.col(taxon).isNotNull())

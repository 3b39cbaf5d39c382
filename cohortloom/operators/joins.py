"""Joins that need a formulation: fallback keys, provenance, lookups with defaults, intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fallback_lookup(df: DataFrame, table: DataFrame, key: str, value: str, trimmed: Column, name: str) -> DataFrame:
    """value by the exact key, else by the trimmed key. table has one row a key."""
    lookup = table.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    exact = df.join(lookup, df[key] == F.col("_k"), "left").withColumnRenamed("_v", "_exact").drop("_k")
    return exact.withColumn("_t", trimmed).join(lookup, F.col("_t") == F.col("_k"), "left").withColumn(name, F.coalesce("_exact", "_v")).drop("_exact", "_v", "_t", "_k")


def match_in_order(left: DataFrame, rules: Sequence[tuple[str, DataFrame, Sequence[str]]], key: str, tag: str = "matched_by") -> DataFrame:
    """Matches by the first rule that finds any for a row of left (key: its id); each row out tells its rule.

    Every rule is one join of left; of a key's matches those of its first rule stay.
    """
    out = None
    for i, (name, right, on) in enumerate(rules):
        found = left.join(right, list(on)).withColumns({tag: F.lit(name), "_rule": F.lit(i)})
        out = found if out is None else out.unionByName(found, allowMissingColumns=True)
    return out.withColumn("_first", F.min("_rule").over(Window.partitionBy(key))).where("_rule = _first").drop("_rule", "_first")


def lookup_default(df: DataFrame, key: str, table: DataFrame, table_key: str, value: str, name: str, default: Column) -> DataFrame:
    """Left join with a default; Spark broadcasts the table if it is small."""
    t = table.select(F.col(table_key).alias("_k"), F.col(value).alias("_v"))
    return df.join(t, df[key] == F.col("_k"), "left").withColumn(name, F.coalesce("_v", default)).drop("_k", "_v")


def tiered_lookup(df: DataFrame, key: str, level: str, tables: Sequence[tuple[int, DataFrame]], value: str, name: str) -> DataFrame:
    """The level of a row says in which table to begin; a null product falls back to the next one. Tables: (level, (key, value))."""
    out = df
    for i, (_, t) in enumerate(tables):
        out = out.join(t.select(F.col(key), F.col(value).alias(f"_v{i}")), key, "left")
    values = [F.when(F.col(level) >= lv, F.col(f"_v{i}")) for i, (lv, _) in enumerate(tables)]
    return out.withColumn(name, F.coalesce(*values)).drop(*(f"_v{i}" for i in range(len(tables))))


def interval_pairs(a: DataFrame, b: DataFrame, axis: Sequence[str], width: int, least: int = 1) -> DataFrame:
    """Pairs of rows on one axis whose closed integer intervals share least positions or more.

    a has start, stop; b has start2, stop2. Intervals are dealt over bins of the given width and joined on
    (axis, bin); a pair is kept in the bin of its later start alone, so none comes twice. Choose the width
    near the usual length: a row is copied once for each bin that it touches.
    """
    axis = list(axis)
    left = a.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("stop") / width))))
    right = b.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start2") / width), F.floor(F.col("stop2") / width))))
    overlap = F.least("stop", "stop2") - F.greatest("start", "start2") + 1
    joined = left.join(right, [*axis, "_bin"]).where(F.floor(F.greatest("start", "start2") / width) == F.col("_bin"))
    return joined.withColumn("overlap", overlap).where(F.col("overlap") >= least).drop("_bin")


def best_interval(a: DataFrame, b: DataFrame, axis: Sequence[str], key: str, other: str, width: int) -> DataFrame:
    """For each row of a (by key) the row of b with the largest overlap; ties by start2, then by other. An equal id comes first."""
    pairs = interval_pairs(a, b, axis, width)
    order = Window.partitionBy(key).orderBy(F.desc(F.col(key).cast("string") == F.col(other).cast("string")), F.desc("overlap"), "start2", other)
    return pairs.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")

"""Deterministic choices of rows: best per key, top per group, majority labels, representatives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def best_per_key(df: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in a total order."""
    return numbered(df, by, order, "_rn").where("_rn = 1").drop("_rn")


def first_n(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    return numbered(df, by, order, "_rn").where(F.col("_rn") <= n).drop("_rn")


def unique_by(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """A right side with one row a key, so that a join does not fan out."""
    return best_per_key(df, key, order)


def label_votes(df: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    return df.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count(F.lit(1)).alias("votes"))


def majority_label(df: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """The most common non-null label of each group, ties by name, with its votes and the group's total.

    Votes are counted before groups are, so a group of any size meets as one row a label.
    """
    order = Window.partitionBy(*by).orderBy(F.desc("votes"), F.asc(label))
    votes = label_votes(df, by, label).withColumn("_rn", F.row_number().over(order)).withColumn("total", F.sum("votes").over(Window.partitionBy(*by)))
    return votes.where("_rn = 1").drop("_rn")


def top_or_other(df: DataFrame, label: str, n: int, name: str = "label_group", other: str = "Other", unknown: str = "Unknown") -> DataFrame:
    """df with the label kept if it is one of the n most frequent, else other; blank labels are unknown."""
    blank = F.col(label).isNull() | (F.trim(label) == "")
    counts = df.where(~blank).groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    top = counts.orderBy(F.desc("_n"), F.asc(label)).limit(n).select(F.col(label).alias("_top"))
    joined = df.join(F.broadcast(top), df[label] == F.col("_top"), "left")  # n rows
    return joined.withColumn(name, F.when(blank, F.lit(unknown)).when(F.col("_top").isNotNull(), F.col(label)).otherwise(F.lit(other))).drop("_top")


def pick_representative(members: DataFrame, cluster: str, entity: str, length: str, complete: str, genes: str) -> DataFrame:
    """One entity a cluster: a singleton itself; else the longest complete member at or over the median length;
    else, of the members with most genes, that closest to the median length. Ties by entity.
    """
    stats = members.groupBy(cluster).agg(F.median(length).alias("_mid"), F.count(F.lit(1)).alias("_n"), F.max(genes).alias("_genes"))
    rows = members.join(stats, cluster)
    tier = F.when(F.col("_n") == 1, 0).when(F.col(complete) & (F.col(length) >= F.col("_mid")), 1).when(F.col(genes) == F.col("_genes"), 2).otherwise(3)
    far = F.when(tier == 1, -F.col(length)).otherwise(F.abs(F.col(length) - F.col("_mid")))
    return best_per_key(rows.withColumn("tier", tier).withColumn("_far", far), [cluster], ["tier", "_far", entity]).select(cluster, F.col(entity).alias("representative"), "tier")

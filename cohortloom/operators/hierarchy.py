"""Identifier and rank propagation, and agreement of labels along a hierarchy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import joins, pick


def build_metadata(source: DataFrame, hashes: DataFrame, trimmed: Column, representatives: DataFrame, attributes: Sequence[DataFrame]) -> DataFrame:
    """One row a source id: its hash (by the exact id, else by the trimmed one), the hash's representative, its attributes.

    source: id; hashes: id, hash; representatives: hash, rep, rep_order (the least order wins); each attribute
    table is keyed by rep and brought to one row a key first, so nothing fans out.
    """
    rows = joins.fallback_lookup(source.dropDuplicates(["id"]), pick.unique_by(hashes, ["id"], ["hash"]), "id", "hash", trimmed, "hash")
    rows = rows.join(pick.unique_by(representatives, ["hash"], ["rep_order", "rep"]).select("hash", "rep"), "hash", "left")
    for table in attributes:
        rest = [c for c in table.columns if c != "rep"]
        rows = rows.join(pick.unique_by(table, ["rep"], rest), "rep", "left")
    return rows


def membership(entities: DataFrame, steps: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Rank ids by chained lookups. Each step: the key column that rows have by then, and a table of that key and new columns."""
    for key, table in steps:
        entities = entities.join(table.dropDuplicates([key]), key, "left")
    return entities


def best_annotation(rows: DataFrame, entity: str, score: str, tiebreak: Sequence[str]) -> DataFrame:
    """The annotation with the highest score of each entity; a null score counts as 0."""
    return pick.best_per_key(rows.withColumn(score, F.coalesce(F.col(score), F.lit(0.0))), [entity], [F.desc(score), *tiebreak])


def site_agreement(rows: DataFrame, cluster: Sequence[str], entity: str, site: str, least: int = 2) -> DataFrame:
    """Of clusters with least members or more: members, the dominant site (ties by name), its share, and whether all agree."""
    top = pick.majority_label(rows.select(*cluster, entity, site).distinct(), cluster, site).where(F.col("total") >= least)
    return top.select(*cluster, F.col("total").alias("members"), F.col(site).alias("site"), F.try_divide("votes", "total").alias("share"), (F.col("votes") == F.col("total")).alias("perfect"))


def one_source_clusters(rows: DataFrame, cluster: Sequence[str], flag: Column) -> DataFrame:
    """Clusters all of whose members have the flag."""
    return rows.groupBy(*cluster).agg(F.count(F.lit(1)).alias("n"), F.sum(flag.cast("int")).alias("flagged")).where("n = flagged").drop("flagged")


def integration_status(rows: DataFrame, entity: str, sources: Sequence[DataFrame], own: Column, name: str = "integrated") -> DataFrame:
    """True if the entity is in any of the id tables or by its own attribute."""
    known = sources[0].select(entity)
    for s in sources[1:]:
        known = known.union(s.select(entity))
    return rows.join(known.distinct().withColumn("_in", F.lit(True)), entity, "left").withColumn(name, F.coalesce("_in", F.lit(False)) | F.coalesce(own, F.lit(False))).drop("_in")


def release_compare(a: DataFrame, b: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Over the keys of both releases: n, the null-safe match rate of each column, and the rate of rows that match in all."""
    old = b.select(*key, *(F.col(c).alias(f"_{c}") for c in columns))
    same = {c: F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns}
    every = F.lit(True)
    for s in same.values():
        every = every & s
    return a.join(old, list(key)).agg(F.count(F.lit(1)).alias("n"), *(F.avg(s.cast("int")).alias(f"match_{c}") for c, s in same.items()), F.avg(every.cast("int")).alias("match_all"))


def source_priority(new: DataFrame, old: DataFrame, key: str, value: str) -> DataFrame:
    """The new source's value where it has one, else the old one's, with its provenance."""
    both = new.select(key, F.col(value).alias("_n")).join(old.select(key, F.col(value).alias("_o")), key, "full")
    return both.select(key, F.coalesce("_n", "_o").alias(value), F.when(F.col("_n").isNotNull() & F.col("_o").isNotNull(), "both").when(F.col("_n").isNotNull(), "new").when(F.col("_o").isNotNull(), "old").alias("provenance"))

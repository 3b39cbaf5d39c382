"""Label consensus from evidence, merging of methods, and comparison with reference labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pick, shape


def evidence_consensus(evidence: DataFrame, entity: str, ranks: Sequence[str], least: float = 0.0, all_hits: bool = False) -> DataFrame:
    """entity, rank, label, votes, total, agreement: the most voted label of each entity at each rank (ties by name).

    total: the entity's hits with a label at that rank, or all its hits. Agreement below least is left out.
    One unpivot serves all ranks; votes are pre-aggregated, so a popular entity meets as one row a label.
    """
    long = shape.rank_ladder(evidence, [entity], ranks, "rank", "label")
    top = pick.majority_label(long, [entity, "rank"], "label")
    if all_hits:
        hits = evidence.groupBy(entity).agg(F.count(F.lit(1)).alias("total"))
        top = top.drop("total").join(hits, entity)
    out = top.select(entity, "rank", "label", "votes", "total", F.try_divide("votes", "total").alias("agreement"))
    return out.where(F.col("agreement") >= least)


def threshold_sweep(consensus: DataFrame, entities: DataFrame, entity: str, cluster: str, cutoffs: Sequence[float]) -> DataFrame:
    """For each rank and cutoff: entities predicted, and clusters with a predicted entity. One pass for all cutoffs."""
    grid = shape.literals(consensus.sparkSession, "cutoff", cutoffs)
    rows = consensus.join(entities.select(entity, cluster), entity).crossJoin(F.broadcast(grid)).where("agreement >= cutoff")
    return rows.groupBy("rank", "cutoff").agg(F.countDistinct(entity).alias("entities"), F.countDistinct(cluster).alias("clusters"))


def evidence_cascade(strict: DataFrame, relaxed: DataFrame, entity: str) -> DataFrame:
    """Strict evidence of an entity if it has any, else its relaxed evidence."""
    rest = relaxed.join(strict.select(entity).distinct(), entity, "left_anti")
    return strict.withColumn("evidence", F.lit("strict")).unionByName(rest.withColumn("evidence", F.lit("relaxed")))


def merge_methods(a: DataFrame, b: DataFrame, key: Sequence[str], names: tuple[str, str], least: float = 0.7, min_votes: int = 1) -> DataFrame:
    """One label for each key from two methods (label, votes, agreement each).

    A method is eligible with agreement of least and min_votes votes. The same label from both is `both`, with
    votes summed and the lesser agreement; otherwise more votes win, the first method on ties.
    """
    cols = ("label", "votes", "agreement")
    x = a.select(*key, *(F.col(c).alias(f"{c}_a") for c in cols)).where((F.col("agreement_a") >= least) & (F.col("votes_a") >= min_votes))
    y = b.select(*key, *(F.col(c).alias(f"{c}_b") for c in cols)).where((F.col("agreement_b") >= least) & (F.col("votes_b") >= min_votes))
    both = x.join(y, list(key), "full")
    same = F.col("label_a") == F.col("label_b")
    first = F.col("label_b").isNull() | (F.col("votes_a") >= F.col("votes_b"))
    pick_ = lambda c: F.when(first & F.col("label_a").isNotNull(), F.col(f"{c}_a")).otherwise(F.col(f"{c}_b"))
    return both.select(
        *key, pick_("label").alias("label"),
        F.when(same, F.col("votes_a") + F.col("votes_b")).otherwise(pick_("votes")).alias("votes"),
        F.when(same, F.least("agreement_a", "agreement_b")).otherwise(pick_("agreement")).alias("agreement"),
        F.when(same, "both").when(first & F.col("label_a").isNotNull(), names[0]).otherwise(names[1]).alias("method"),
    )


def assign_by_ladder(merged: DataFrame, entity: str, ranks: Sequence[str], min_votes: Sequence[int]) -> DataFrame:
    """The lowest rank (first in ranks) at which the entity has enough votes."""
    at = F.lit(None).cast("int")
    for i, (rank, least) in enumerate(zip(ranks, min_votes, strict=True)):
        at = F.when((F.col("rank") == rank) & (F.col("votes") >= least), F.lit(i)).otherwise(at)
    return pick.best_per_key(merged.withColumn("_at", at).where("_at IS NOT NULL"), [entity], ["_at", "label"]).drop("_at")


def label_priority(wide: DataFrame, ranks: Sequence[str], sources: Sequence[str]) -> DataFrame:
    """final_label and final_rank: at the first rank where a source has votes, the source with more (the first on ties).

    wide has {rank}_{source}_label and {rank}_{source}_votes; missing votes are 0.
    """
    label, at = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rank in reversed(ranks):
        votes = [F.coalesce(F.col(f"{rank}_{s}_votes"), F.lit(0)) for s in sources]
        best = F.greatest(*votes) if len(votes) > 1 else votes[0]
        chosen = F.lit(None).cast("string")
        for s, v in reversed(list(zip(sources, votes, strict=True))):
            chosen = F.when(v == best, F.col(f"{rank}_{s}_label")).otherwise(chosen)
        label = F.when(best > 0, chosen).otherwise(label)
        at = F.when(best > 0, F.lit(rank)).otherwise(at)
    return wide.withColumn("final_label", label).withColumn("final_rank", at)


def weighted_merge(a: DataFrame, b: DataFrame, key: Sequence[str], names: tuple[str, str]) -> DataFrame:
    """Of two methods' labels, the one with more votes times agreement; the first on ties."""
    cols = ("label", "votes", "agreement")
    both = a.select(*key, *(F.col(c).alias(f"{c}_a") for c in cols)).join(b.select(*key, *(F.col(c).alias(f"{c}_b") for c in cols)), list(key), "full")
    weight = lambda s: F.coalesce(F.col(f"votes_{s}") * F.col(f"agreement_{s}"), F.lit(0.0))
    first = F.col("label_a").isNotNull() & (weight("a") >= weight("b"))
    return both.select(*key, F.when(first, F.col("label_a")).otherwise(F.coalesce("label_b", "label_a")).alias("label"), F.greatest(weight("a"), weight("b")).alias("weight"), F.when(first | F.col("label_b").isNull(), names[0]).otherwise(names[1]).alias("method"))


def release_map(old: DataFrame, new: DataFrame, accession: str, name: str) -> DataFrame:
    """old_name to new_name by majority over shared accessions (ties by name), with votes and total."""
    pairs = old.select(accession, F.col(name).alias("old_name")).join(new.select(accession, F.col(name).alias("new_name")), accession)
    return pick.majority_label(pairs, ["old_name"], "new_name")


def same_species(a: str, b: str):
    """Equal names, or the same sp######### number in both."""
    number = lambda c: F.nullif(F.regexp_extract(F.col(c), r"sp(\d{9})", 1), F.lit(""))
    return (F.col(a) == F.col(b)) | F.coalesce(number(a) == number(b), F.lit(False))


def benchmark_labels(predicted: DataFrame, truth: DataFrame, key: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """n, annotated, tp, fp, rate (annotated / n) and agreement (tp / annotated), overall or by group. truth: key, truth label (and groups)."""
    rows = truth.join(predicted, list(key), "left")
    hit, there = F.col("label") == F.col("truth"), F.col("label").isNotNull()
    agg = [F.count(F.lit(1)).alias("n"), F.count_if(there).alias("annotated"), F.count_if(hit).alias("tp"), F.count_if(there & ~hit).alias("fp")]
    out = rows.groupBy(*by).agg(*agg) if by else rows.agg(*agg)
    return out.withColumn("rate", F.try_divide("annotated", "n")).withColumn("agreement", F.try_divide("tp", "annotated"))


def disagreements(rows: DataFrame, a: str, b: str, support: str) -> DataFrame:
    """Pairs that differ, seen from label a: n, distinct partners, the most frequent partner (ties by name), median support."""
    off = rows.where(F.col(a) != F.col(b))
    stats = off.groupBy(a).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(b).alias("partners"), F.median(support).alias("median_support"))
    return stats.join(pick.majority_label(off, [a], b).select(a, F.col(b).alias("top_partner"), F.col("votes").alias("top_n")), a)


def cluster_vote(rows: DataFrame, cluster: str, label: str, mixed: str = "MIXED") -> DataFrame:
    """The label of each cluster if its members agree, else mixed; members without a label do not count."""
    return rows.groupBy(cluster).agg(F.when(F.countDistinct(label) == 1, F.min(label)).when(F.countDistinct(label) > 1, mixed).alias(label))


def confidence_tally(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Counts over two confidence columns: both high, only one, neither, missing on a side."""
    high = lambda c: F.coalesce(F.col(c) == "high", F.lit(False))
    return rows.agg(
        F.count_if(high(a) & high(b)).alias("both_high"), F.count_if(high(a) & ~high(b)).alias("only_a"), F.count_if(~high(a) & high(b)).alias("only_b"),
        F.count_if(~high(a) & ~high(b)).alias("neither"), F.count_if(F.col(a).isNull()).alias("missing_a"), F.count_if(F.col(b).isNull()).alias("missing_b"),
    )


def agreement_share(rows: DataFrame, cluster: Sequence[str], label: str, least: int = 3) -> DataFrame:
    """Mean share of the dominant label over clusters with least labelled members or more, with their number."""
    top = pick.majority_label(rows, cluster, label).where(F.col("total") >= least)
    by = [c for c in cluster if c in ("cluster_rank", "label_rank")]
    agg = [F.count(F.lit(1)).alias("clusters"), F.avg(F.try_divide("votes", "total")).alias("mean_share"), F.avg((F.col("votes") == F.col("total")).cast("int")).alias("perfect")]
    return top.groupBy(*by).agg(*agg) if by else top.agg(*agg)


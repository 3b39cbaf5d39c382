"""Cohort summaries: prevalence, composition, persistence, trajectories, selection of cohorts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions import expr as X

from . import order, pick, shape


def abundance_by_site(df: DataFrame, site: str, taxon: str, entity: str) -> DataFrame:
    """Distinct entities of each taxon at each site."""
    return df.groupBy(site, taxon).agg(F.countDistinct(entity).alias("n"))


def length_variation(df: DataFrame, cluster: Sequence[str], length: str, least: int = 2) -> DataFrame:
    """(max - min) / median in per cent, of clusters with least members or more."""
    counts = order.running_counts(order.count_values(df, cluster, length), cluster, length)
    out = counts.groupBy(*cluster).agg(F.sum("_n").alias("n"), order.quantile_of(length, 0.5).alias("mid"), (F.max(length) - F.min(length)).alias("_w"))
    return out.where(F.col("n") >= least).select(*cluster, "n", "mid", X.ratio(100.0 * F.col("_w"), "mid").alias("variation_pct"))


def length_outliers(df: DataFrame, cluster: Sequence[str], length: str, bands: Sequence[float], least: int = 3) -> DataFrame:
    """For each band: members whose z-score is over it in size, of those that have a z-score. One pass."""
    z = X.z_score(length, Window.partitionBy(*cluster), least)
    rows = df.withColumn("_z", F.abs(z)).where("_z IS NOT NULL")
    counts = rows.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("_z") > b).alias(f"b{i}") for i, b in enumerate(bands)))
    return counts.select("n", F.explode(F.array(*(F.struct(F.lit(float(b)).alias("band"), F.col(f"b{i}").alias("removed")) for i, b in enumerate(bands)))).alias("s")).select("n", "s.*")


def taxon_summary(long: DataFrame, value: str, cuts: Sequence[float] = (2, 3, 5), least: int = 1, high_share: float = 0.5) -> DataFrame:
    """For (rank, taxon): n, median, upper quartile, share at each cut, a consistently-high flag. long comes from rank_ladder."""
    counts = order.running_counts(order.count_values(long, ["rank", "taxon"], value), ["rank", "taxon"], value)
    share = lambda x: F.try_divide(F.sum(F.when(F.col(value) >= x, F.col("_n")).otherwise(0)), F.max("_total"))
    out = counts.groupBy("rank", "taxon").agg(F.sum("_n").alias("n"), order.quantile_of(value, 0.5).alias("median"), order.quantile_of(value, 0.75).alias("q75"), *(share(x).alias(f"share_{x:g}") for x in cuts))
    return out.where(F.col("n") >= least).withColumn("consistently_high", F.col(f"share_{cuts[0]:g}") >= high_share)


def prevalence(long: DataFrame, samples: DataFrame, sample: str, stratum: str, least: float = 0.0) -> DataFrame:
    """Share of a stratum's samples with the taxon, by rank. samples: one row a sample with its stratum; their totals are one row a stratum."""
    totals = samples.groupBy(stratum).agg(F.count(F.lit(1)).alias("samples"))
    here = long.select(sample, "rank", "taxon").distinct().join(samples.select(sample, stratum), sample)
    out = here.groupBy("rank", stratum, "taxon").agg(F.count(F.lit(1)).alias("n")).join(totals, stratum)
    return out.withColumn("prevalence", F.col("n") / F.col("samples")).where(F.col("prevalence") >= least)


def prevalence_at(df: DataFrame, samples: int, sample: str, taxon: str, value: str, cutoffs: Sequence[float]) -> DataFrame:
    """Share of all samples whose largest value of the taxon is at each cutoff or more (over 0 for cutoff 0)."""
    top = df.groupBy(taxon, sample).agg(F.max(value).alias("_m"))
    hits = [F.count_if(F.col("_m") > 0 if x == 0 else F.col("_m") >= x).alias(f"c{i}") for i, x in enumerate(cutoffs)]
    wide = top.groupBy(taxon).agg(*hits)
    return wide.select(taxon, F.explode(F.array(*(F.struct(F.lit(float(x)).alias("cutoff"), (F.col(f"c{i}") / F.lit(samples)).alias("share")) for i, x in enumerate(cutoffs)))).alias("s")).select(taxon, "s.*")


def flag_consistency(df: DataFrame, taxon: Sequence[str], flag: Column) -> DataFrame:
    """never, sometimes or always flagged, per taxon."""
    rate = F.avg(F.coalesce(flag, F.lit(False)).cast("int"))
    return df.groupBy(*taxon).agg(F.count(F.lit(1)).alias("n"), F.when(rate == 0, "never").when(rate == 1, "always").otherwise("sometimes").alias("consistency"))


def composition(df: DataFrame, stratum: str, label: str, top: int) -> DataFrame:
    """Share of each of the most frequent labels (and Other, Unknown) within each stratum."""
    named = pick.top_or_other(df, label, top, "_group")
    counts = named.groupBy(stratum, F.col("_group").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", X.share("n", stratum))


def community_profile(df: DataFrame, sample: str, category: str, entity: str, abundance: str, categories: Sequence[str]) -> DataFrame:
    """Distinct entities and summed abundance of each category in each sample, zero-filled, and the total."""
    aggs = []
    for k in categories:
        here = F.col(category) == k
        aggs += [F.countDistinct(F.when(here, F.col(entity))).alias(f"n_{k}"), F.coalesce(F.sum(F.when(here, F.col(abundance))), F.lit(0.0)).alias(f"sum_{k}")]
    return df.groupBy(sample).agg(*aggs, F.sum(abundance).alias("total"))


def max_depth_by_class(tables: dict[str, DataFrame], sample: str, cls: str, depth: str, least: float) -> DataFrame:
    """Greatest depth of each class in each sample by each tool, and whether it reaches least; long over tools."""
    parts = [t.groupBy(sample, cls).agg(F.max(depth).alias("depth")).withColumn("tool", F.lit(name)) for name, t in tables.items()]
    return shape.stack(parts).withColumn("positive", F.col("depth") >= least)


def eligible_subjects(df: DataFrame, subject: str, day: str, span: int, points: int) -> DataFrame:
    """Subjects observed over more than span days at points time points or more."""
    return df.groupBy(subject).agg(F.countDistinct(day).alias("points"), F.datediff(F.max(day), F.min(day)).cast("long").alias("span")).where((F.col("span") > span) & (F.col("points") >= points))


def trajectory(df: DataFrame, subject: str, day: str, entity: str, value: str, floor: float) -> DataFrame:
    """Every entity of a subject at each of the subject's days, the best value there, floor where it is absent; entities that never pass the floor go."""
    best = df.groupBy(subject, day, entity).agg(F.max(value).alias("_v"))
    seen = best.where(F.col("_v") > floor).select(subject, entity).distinct()
    grid = df.select(subject, day).distinct().join(seen, subject)
    return grid.join(best, [subject, day, entity], "left").select(subject, day, entity, F.greatest(F.coalesce("_v", F.lit(floor)), F.lit(floor)).alias("value"))


def persistence(detected: DataFrame, present: DataFrame, subject: str, day: str, entity: str, partner: str, pairs: DataFrame) -> DataFrame:
    """Days on which an entity is detected over days on which its partner is present, per subject."""
    days = present.select(subject, day, partner).distinct().join(pairs, partner)
    there = days.groupBy(subject, entity).agg(F.countDistinct(day).alias("partner_days"))
    both = detected.select(subject, day, entity).distinct().join(days.select(subject, day, entity).distinct(), [subject, day, entity])
    found = both.groupBy(subject, entity).agg(F.count(F.lit(1)).alias("detected_days"))
    return there.join(found, [subject, entity], "left").na.fill(0, ["detected_days"]).withColumn("persistence", F.col("detected_days") / F.col("partner_days"))


def drop_always(df: DataFrame, key: Sequence[str], flag: Column) -> DataFrame:
    """Rows of keys that are not flagged at every observation."""
    always = df.groupBy(*key).agg(F.every(F.coalesce(flag, F.lit(False))).alias("_all")).where("_all")
    return df.join(always.select(*key), list(key), "left_anti")


def richness(df: DataFrame, sample: str, taxon: str, cls: str, a: str, b: str) -> DataFrame:
    """Distinct taxa of two classes in each sample and their ratio."""
    count = lambda k: F.countDistinct(F.when(F.col(cls) == k, F.col(taxon)))
    return df.groupBy(sample).agg(count(a).alias("n_a"), count(b).alias("n_b")).withColumn("ratio", X.ratio("n_a", "n_b"))


def activity_levels(df: DataFrame, subject: str, entity: str, score: str, steps: Sequence[tuple[float, str]], above: str) -> DataFrame:
    """The tier of the greatest score of each (subject, entity)."""
    return df.groupBy(subject, entity).agg(F.max(score).alias("score")).withColumn("tier", X.stepped("score", steps, above))


def select_cohort(runs: DataFrame, keep: Column, sample: str, order: Sequence[Column | str], project: str, least: int, cap: int, n: int, run: str, seed: int = 1) -> DataFrame:
    """n runs in hash order: rows that keep holds for, the best run a sample, projects with least samples or more, at most cap of each.

    The cap and n are the selection itself, not a limit on work.
    """
    best = pick.best_per_key(runs.where(keep), [sample], order)
    large = best.groupBy(project).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(project)
    some = pick.first_n(best.join(large, project, "left_semi"), [project], [X.hashed(run, seed=seed), run], cap)
    return some.orderBy(X.hashed(run, seed=seed), run).limit(n)


def unify_catalogues(catalogues: dict[str, tuple[DataFrame, Column]], ddl: str, known: DataFrame, key: str, members: str | None = None) -> DataFrame:
    """Catalogues in one schema, each cut by its own quality rule and labelled; member lists become rows; known ids go."""
    parts = [shape.to_schema(df.where(ok), ddl).withColumn("catalogue", F.lit(name)) for name, (df, ok) in catalogues.items()]
    rows = shape.stack(parts)
    if members:
        rows = rows.withColumn(members, F.explode(members))
    return rows.join(known.select(key).distinct(), key, "left_anti")


def hybrid_calls(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Calls of method A where it has the key, else those of B."""
    rest = b.join(a.select(*key).distinct(), list(key), "left_anti")
    return a.withColumn("method", F.lit("a")).unionByName(rest.withColumn("method", F.lit("b")), allowMissingColumns=True)


def compare_measurements(a: DataFrame, b: DataFrame, key: Sequence[str], value: str, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """Over a full join of two tools: pairs, one-sided rows, shares of ratios beyond the bands, correlation."""
    both = a.select(*key, F.col(value).alias("_a")).join(b.select(*key, F.col(value).alias("_b")), list(key), "full").withColumn("_r", X.ratio("_a", "_b"))
    pairs = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return both.agg(F.count_if(pairs).alias("pairs"), F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"), F.avg((F.col("_r") > high).cast("int")).alias("share_high"), F.avg((F.col("_r") < low).cast("int")).alias("share_low"), F.corr("_a", "_b").alias("r"))


def threshold_shares(df: DataFrame, score: str, cutoffs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Share of rows with the score at each cutoff or more; null is below all."""
    aggs = [F.avg(F.coalesce(F.col(score) >= x, F.lit(False)).cast("int")).alias(f"s{i}") for i, x in enumerate(cutoffs)]
    wide = df.groupBy(*by).agg(*aggs)
    return wide.select(*by, F.explode(F.array(*(F.struct(F.lit(float(x)).alias("cutoff"), F.col(f"s{i}").alias("share")) for i, x in enumerate(cutoffs)))).alias("s")).select(*by, "s.*")


def representative_agreement(a: DataFrame, b: DataFrame, cluster: str) -> DataFrame:
    """Clusters in both choices: share with the same representative, and with equal length and genes. Columns: representative, length, genes."""
    old = b.select(cluster, *(F.col(x).alias(f"_{x}") for x in ("representative", "length", "genes")))
    same = F.col("representative") == F.col("_representative")
    alike = same | ((F.col("length") == F.col("_length")) & (F.col("genes") == F.col("_genes")))
    return a.join(old, cluster).agg(F.count(F.lit(1)).alias("clusters"), F.avg(same.cast("int")).alias("same"), F.avg(alike.cast("int")).alias("same_or_alike"))


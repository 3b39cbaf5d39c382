"""Per-sample detection measures, features of entities, annotation and lifestyle summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions import expr as X

from . import pick, shape


def coverage_metrics(df: DataFrame, covered: str, length: str, mean: str, variance: str, trimmed: str) -> DataFrame:
    """breadth, the breadth that the mean depth lets expect, their ratio (null below 1e-6), variance over trimmed mean."""
    expected = 1 - F.exp(-0.833 * F.col(mean))
    return df.withColumns({"breadth": X.ratio(covered, length), "expected": expected}).withColumns({"breadth_ratio": F.when(F.col("expected") > 1e-6, F.col("breadth") / F.col("expected")), "dispersion": X.ratio(variance, trimmed)})


def detect_species(df: DataFrame, sample: str, entity: str, species: str, measure: str, representatives: DataFrame) -> DataFrame:
    """The best canonical entity of each species in each sample, of those with a positive measure."""
    canonical = df.where(F.col(measure) > 0).join(representatives.select(entity).distinct(), entity, "left_semi")
    return pick.best_per_key(canonical, [sample, species], [F.desc(measure), entity])


def paired_condition(df: DataFrame, key: Sequence[str], condition: str, a: str, b: str, measure: str, cutoff: float = 0.0) -> DataFrame:
    """TP, FN, FP or TN by whether the measure is over the cutoff in condition a (truth) and in b. One aggregate, no join."""
    side = lambda v: F.coalesce(F.max(F.when(F.col(condition) == v, F.col(measure))), F.lit(0.0))
    both = df.groupBy(*key).agg(side(a).alias("value_a"), side(b).alias("value_b"))
    in_a, in_b = F.col("value_a") > cutoff, F.col("value_b") > cutoff
    return both.withColumn("label", F.when(in_a & in_b, "TP").when(in_a, "FN").when(in_b, "FP").otherwise("TN"))


def group_flags(df: DataFrame, columns: Sequence[str], groups: dict[str, str]) -> DataFrame:
    """A 0/1 flag for each group whose pattern (case ignored) is found in any of the annotation columns."""
    text = F.concat_ws(" | ", *columns)
    return df.withColumns({f"is_{g}": F.coalesce(text.rlike(f"(?i){p}"), F.lit(False)).cast("int") for g, p in groups.items()})


def group_proportions(flagged: DataFrame, key: Sequence[str], groups: Sequence[str], hallmarks: Sequence[str] = ()) -> DataFrame:
    """Mean of each flag by key, whether each hallmark occurs, and how many do."""
    found = [F.max(f"is_{h}").alias(f"has_{h}") for h in hallmarks]
    out = flagged.groupBy(*key).agg(F.count(F.lit(1)).alias("genes"), *(F.avg(f"is_{g}").alias(f"prop_{g}") for g in groups), *found)
    return out.withColumn("hallmarks", reduce(lambda a, b: a + b, (F.col(f"has_{h}") for h in hallmarks), F.lit(0)))


def breadth_stats(df: DataFrame, key: Sequence[str], breadth: str, cuts: Sequence[float] = (0.5, 0.8)) -> DataFrame:
    """Mean, sd and cv of gene breadth, the share at each cut, occupied genes."""
    out = df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("genes"), F.avg(breadth).alias("mean_breadth"), F.stddev_samp(breadth).alias("sd_breadth"),
        *(F.avg((F.col(breadth) >= x).cast("int")).alias(f"share_{int(100 * x)}") for x in cuts), F.count_if(F.col(breadth) > 0).alias("occupied"),
    )
    return out.withColumn("cv_breadth", X.ratio("sd_breadth", "mean_breadth"))


def features(df: DataFrame, numbers: Sequence[str], per_kb: dict[str, str], ordinals: dict[str, Sequence[str]], logs: Sequence[str], flags: dict[str, Column]) -> DataFrame:
    """Model features: safe casts, counts per 1000 of a length, ordinal codes, log1p, 0/1 flags."""
    new = {n: X.safe_double(n) for n in numbers}
    new |= {f"{n}_per_kb": X.ratio(1000.0 * F.col(n), size) for n, size in per_kb.items()}
    new |= {f"{n}_level": X.ordinal(n, levels) for n, levels in ordinals.items()}
    new |= {f"log_{n}": F.when(F.col(n) >= 0, F.log1p(n)) for n in logs}
    return df.withColumns(new | {n: F.coalesce(f, F.lit(False)).cast("int") for n, f in flags.items()})


def assemble(base: DataFrame, parts: Sequence[DataFrame], key: Sequence[str], wanted: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Feature tables joined to base (one row a key each), and the wanted features that none has."""
    out = base
    for p in parts:
        shared = [k for k in key if k in p.columns]
        out = out.join(p.dropDuplicates(shared), shared, "left")
    return out, [w for w in wanted if w not in out.columns]


def annotation_table(keys: DataFrame, key: str, required: DataFrame, optional: Sequence[DataFrame]) -> DataFrame:
    """Keys with the required annotation and those optional ones that they have. Right sides are cut to the keys and to one row each."""
    wanted = keys.select(key).distinct()
    slim = lambda t: pick.unique_by(t.join(wanted, key, "left_semi"), [key], [c for c in t.columns if c != key])
    out = keys.join(slim(required), key)
    for t in optional:
        out = out.join(slim(t), key, "left")
    return out


def protein_aggregates(rows: DataFrame, entity: str, product: str, keywords: dict[str, str], hallmarks: dict[str, str]) -> DataFrame:
    """Per entity: items, annotated ones, those of each keyword; for each hallmark 1 if exactly one item has it."""
    has = lambda p: F.coalesce(F.col(product).rlike(f"(?i){p}"), F.lit(False))
    return rows.groupBy(entity).agg(
        F.count(F.lit(1)).alias("n"), F.count(product).alias("annotated"), *(F.count_if(has(p)).alias(f"n_{k}") for k, p in keywords.items()),
        *((F.count_if(has(p)) == 1).cast("int").alias(f"one_{k}") for k, p in hallmarks.items()),
    )


def hit_levels(df: DataFrame, level: Column, order: Sequence[str]) -> DataFrame:
    """Counts and running counts of hit tiers in the given order."""
    counts = df.withColumn("level", level).groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pos", X.ordinal("level", order)).withColumn("cumulative", F.sum("n").over(Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))  # one row a tier


def single_copy(rows: DataFrame, entity: str, hallmark: str, method: str) -> DataFrame:
    """Entities and the number of hallmarks of which any method finds exactly one copy in them."""
    one = rows.groupBy(entity, hallmark, method).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select(entity, hallmark).distinct()
    return one.groupBy(entity).agg(F.count(F.lit(1)).alias("hallmarks"))


def lifestyle(df: DataFrame, signals: Sequence[str]) -> DataFrame:
    """temperate if any signal is set, else virulent, with the number of signals."""
    out = df.withColumn("signals", X.true_count(*signals))
    return out.withColumn("lifestyle", F.when(F.col("signals") > 0, "temperate").otherwise("virulent"))


def threshold_curve(df: DataFrame, score: str, truth: Column, cutoffs: Sequence[float]) -> DataFrame:
    """Agreement of (score >= cutoff) with truth, at each cutoff, in one pass."""
    grid = shape.literals(df.sparkSession, "cutoff", cutoffs)
    rows = df.withColumn("_t", truth).crossJoin(F.broadcast(grid))  # a literal list of cutoffs
    return rows.groupBy("cutoff").agg(F.count(F.lit(1)).alias("n"), F.avg(((F.col(score) >= F.col("cutoff")) == F.col("_t")).cast("int")).alias("agreement"))


def evidence_points(df: DataFrame, families: dict[str, Sequence[tuple[Column, int]]]) -> DataFrame:
    """Points of each evidence family (the best grade that holds) and their sum."""
    out = df
    for name, grades in families.items():
        points = F.lit(0)
        for cond, p in sorted(grades, key=lambda g: g[1]):
            points = F.when(F.coalesce(cond, F.lit(False)), F.lit(p)).otherwise(points)
        out = out.withColumn(f"points_{name}", points)
    return out.withColumn("points", reduce(lambda a, b: a + b, (F.col(f"points_{n}") for n in families)))


def terminal_repeats(df: DataFrame, entity: str, sequence: str, least: int = 20) -> DataFrame:
    """entity, kind (direct, inverted or none), repeat, top_base_pct and trimmed.

    Direct: the longest prefix of least characters or more that is also a suffix, within half of the sequence;
    it is trimmed off the end. Inverted: the start equals the reverse complement of the end, as long as it
    runs. Sequences are handled one by one inside their partitions, in any length.
    """
    import pandas as pd

    def scan(batches):
        turn = str.maketrans("ACGT", "TGCA")
        for pdf in batches:
            out = []
            for key, s in zip(pdf[entity], pdf[sequence].fillna("").str.upper(), strict=True):
                n, kind, repeat = len(s), "none", ""
                tail = s[n - n // 2 :]
                # borders of start + separator + second half, by the prefix function
                if n >= 2 * least:
                    joined = s[: n // 2] + "\0" + tail
                    border = [0] * len(joined)
                    for i in range(1, len(joined)):
                        k = border[i - 1]
                        while k and joined[i] != joined[k]:
                            k = border[k - 1]
                        border[i] = k + (joined[i] == joined[k])
                    if border[-1] >= least:
                        kind, repeat = "direct", s[: border[-1]]
                    else:
                        back = tail[::-1].translate(turn)
                        k = 0
                        while k < len(back) and s[k] == back[k]:
                            k += 1
                        if k >= least:
                            kind, repeat = "inverted", s[:k]
                top = max((repeat.count(b) for b in "ACGT"), default=0)
                out.append((key, kind, repeat, 100.0 * top / len(repeat) if repeat else None, s[: n - len(repeat)] if kind == "direct" else s))
            yield pd.DataFrame(out, columns=[entity, "kind", "repeat", "top_base_pct", "trimmed"])

    kind = dict(df.dtypes)[entity]
    return df.select(entity, sequence).mapInPandas(scan, f"{entity} {kind}, kind string, repeat string, top_base_pct double, trimmed string")


def subsequences(df: DataFrame, entity: str, sequence: str, size: Column, seed: int = 1) -> DataFrame:
    """One substring of the given size of each sequence, at a place drawn by a hash of the entity."""
    n = F.least(size, F.length(sequence))
    start = F.pmod(X.hashed_number(entity, seed=seed), F.length(sequence) - n + 1)
    return df.where(F.length(sequence) > 0).select(entity, start.alias("start"), F.substring(F.col(sequence), (start + 1).cast("int"), n).alias("part"))

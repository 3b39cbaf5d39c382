"""Training and scoring with grouped cross-validation, and binary metrics as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions import expr as X


def balanced_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """n / (classes * n of the class); the class table is one row a class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    return df.join(F.broadcast(counts.crossJoin(totals)), label).withColumn(name, F.col("_all") / (F.col("_k") * F.col("_n"))).drop("_n", "_all", "_k")


def forest(features: Sequence[str], label: str, trees: int = 100, seed: int = 42, depth: int = 8) -> Pipeline:
    """Median imputer and random forest over class-balanced rows."""
    filled = [f"{f}_filled" for f in features]
    return Pipeline(stages=[
        Imputer(strategy="median", inputCols=list(features), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_features"),
        RandomForestClassifier(featuresCol="_features", labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed, probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_prediction"),
    ])


def fit(df: DataFrame, features: Sequence[str], label: str, trees: int = 100, seed: int = 42) -> PipelineModel:
    rows = balanced_weights(df.withColumns({f: F.col(f).cast("double") for f in features}).withColumn(label, F.col(label).cast("double")), label)
    return forest(features, label, trees, seed).fit(rows)


def score(df: DataFrame, model: PipelineModel, features: Sequence[str], name: str = "score") -> DataFrame:
    rows = df.withColumns({f: F.col(f).cast("double") for f in features})
    out = model.transform(rows).withColumn(name, vector_to_array("_probability")[1])
    return out.select(*df.columns, name)


def group_folds(df: DataFrame, group: str, k: int, seed: int = 42, name: str = "fold") -> DataFrame:
    """A fold for each group: groups in hash order, dealt in turn. No group is in two folds."""
    groups = df.select(group).distinct().withColumn("_h", F.xxhash64(F.col(group), F.lit(seed)))
    dealt = groups.withColumn(name, F.pmod(F.row_number().over(Window.orderBy("_h", group)) - 1, F.lit(k)))  # one row a group
    return df.join(dealt.drop("_h"), group)


def cross_validate(df: DataFrame, features: Sequence[str], label: str, group: str, k: int = 5, trees: int = 100, seed: int = 42) -> DataFrame:
    """df with fold and the out-of-fold score."""
    rows = group_folds(df, group, k, seed)
    kept = rows.persist()
    try:
        models = [fit(kept.where(F.col("fold") != i), features, label, trees, seed) for i in range(k)]
    finally:
        kept.unpersist()
    parts = None
    for i, model in enumerate(models):
        scored = score(rows.where(F.col("fold") == i), model, features)
        parts = scored if parts is None else parts.unionByName(scored)
    return parts


def confusion(df: DataFrame, truth: Column, called: Column, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 and MCC, overall or by group; undefined ones are null."""
    t, p = F.coalesce(truth, F.lit(False)), F.coalesce(called, F.lit(False))
    out = df.groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    return out.withColumns({
        "precision": X.ratio(tp, tp + fp), "recall": X.ratio(tp, tp + fn), "f1": X.ratio(2 * tp, 2 * tp + fp + fn),
        "mcc": X.ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
    })


def score_curve(df: DataFrame, score: str, truth: Column, by: Sequence[str] = ()) -> DataFrame:
    """For each distinct score, from the highest: tp and fp at or over it, precision and recall; rows with equal scores are one step.

    Scores are counted first; the running sums go over blocks of scores, so that no window holds all rows.
    """
    t = F.coalesce(truth, F.lit(False))
    steps = df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count_if(t).alias("pos"), F.count_if(~t).alias("neg"))
    block = F.floor(F.col(score) * 64)
    blocks = steps.groupBy(*by, block.alias("_b")).agg(F.sum("pos").alias("_bp"), F.sum("neg").alias("_bn"))
    above = Window.partitionBy(*by).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*by)
    bases = blocks.select(*by, "_b", F.coalesce(F.sum("_bp").over(above), F.lit(0)).alias("_p0"), F.coalesce(F.sum("_bn").over(above), F.lit(0)).alias("_n0"), F.sum("_bp").over(every).alias("positives"), F.sum("_bn").over(every).alias("negatives"))
    inside = Window.partitionBy(*by, "_b").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    out = steps.withColumn("_b", block).join(bases, [*by, "_b"]).withColumns({"tp": F.col("_p0") + F.sum("pos").over(inside), "fp": F.col("_n0") + F.sum("neg").over(inside)})
    return out.select(*by, score, "pos", "neg", "tp", "fp", "positives", "negatives", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), X.ratio("tp", "positives").alias("recall"))


def ranking_metrics(df: DataFrame, score: str, truth: Column, by: Sequence[str] = ()) -> DataFrame:
    """n, AUROC (ties count half) and average precision; null without both classes."""
    curve = score_curve(df, score, truth, by)
    # a step's negatives lie below all positives over it and level with its own
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / 2))
    out = curve.groupBy(*by).agg(F.sum(F.col("pos") + F.col("neg")).alias("n"), area.alias("_a"), F.sum(F.col("pos") * F.col("precision")).alias("_p"), F.max("positives").alias("positives"), F.max("negatives").alias("negatives"))
    return out.select(*by, "n", X.ratio("_a", F.col("positives") * F.col("negatives")).alias("auroc"), X.ratio("_p", "positives").alias("average_precision"))


def threshold_for(df: DataFrame, score: str, truth: Column, precision: float) -> DataFrame:
    """The threshold with the largest recall among those whose precision reaches the target; the higher one on ties."""
    ok = score_curve(df, score, truth).where(F.col("precision") >= precision)
    best = ok.agg(F.max(F.struct("recall", F.col(score).alias("threshold"), "precision")).alias("s"))
    return best.where("s IS NOT NULL").select("s.threshold", "s.precision", "s.recall")


def rollup(scored: DataFrame, sample: Sequence[str], score: str, threshold: float) -> DataFrame:
    return scored.groupBy(*sample).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(score) >= threshold).alias("called"), F.avg(score).alias("mean_score"), F.median(score).alias("median_score"))


def annotation_features(rows: DataFrame, entity: str, product: str, patterns: dict[str, str], passes: Sequence[str], tag: str) -> DataFrame:
    """0/1 features of an entity: whether any product of either pass has the pattern, and whether both passes do."""
    has = lambda p, k: F.max((F.coalesce(F.col(product).rlike(f"(?i){p}"), F.lit(False)) & (F.col(tag) == k)).cast("int"))
    each = {n: [has(p, k) for k in passes] for n, p in patterns.items()}
    return rows.groupBy(entity).agg(*(F.greatest(*x).alias(f"any_{n}") for n, x in each.items()), *(F.least(*x).alias(f"both_{n}") for n, x in each.items()))

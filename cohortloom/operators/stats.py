"""Tests and effect sizes as grouped Spark jobs; only p-values are Arrow functions, on one row a test."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions import expr as X
from cohortloom.functions import tests
from cohortloom.functions.store import kept

from . import order, shape


def fisher_exact(df: DataFrame, n11: str, n10: str, n01: str, n00: str) -> DataFrame:
    """p_greater, p_two and the odds ratio (null where it is infinite or undefined) of each row's table."""
    p = tests.fisher_p(n11, n10, n01, n00)
    return df.withColumn("_p", p).withColumns({"p_greater": F.col("_p.p_greater"), "p_two": F.col("_p.p_two"), "odds_ratio": X.ratio(F.col(n11) * F.col(n00) * 1.0, F.col(n10) * F.col(n01))}).drop("_p")


def bh_fdr(df: DataFrame, p: str, family: Sequence[str], level: float = 0.05, tie: Sequence[str] = ()) -> DataFrame:
    """Benjamini-Hochberg q and reject in each family. Ties in p share the q of the last of them."""
    by = Window.partitionBy(*family)
    ranked = df.withColumn("_rank", F.row_number().over(by.orderBy(p, *tie))).withColumn("_raw", F.col(p) * F.count(p).over(by) / F.col("_rank"))
    q = F.least(F.lit(1.0), F.min("_raw").over(by.orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.withColumn("q", q).withColumn("reject", F.col("q") <= level).drop("_rank", "_raw")


def rank_sums(df: DataFrame, test: Sequence[str], group: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Per (test, group): n and the sum of average ranks; per test: N and the tie term sum(t^3 - t).

    Values are counted first, so ranks are running counts over a test's distinct values, in blocks where these are many (see order).
    """
    rows = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    counts = kept(order.count_values(rows, [*test, group], value))
    ranks = order.running_counts(counts.groupBy(*test, value).agg(F.sum("_n").alias("_n")), test, value)
    t = F.col("_n").cast("double")
    sums = counts.join(ranks.select(*test, value, order.mean_rank().alias("_r")), [*test, value]).groupBy(*test, group).agg(F.sum("_n").alias("n"), F.sum(F.col("_n") * F.col("_r")).alias("rank_sum"))
    totals = ranks.groupBy(*test).agg(F.sum(t).alias("total"), F.sum(t * t * t - t).alias("tie_term"))
    return sums, totals


#: Pairs of a test up to which the signed-rank distribution is computed.
EXACT_PAIRS = 2000


def mann_whitney(df: DataFrame, test: Sequence[str], group: str, value: str, a, b) -> DataFrame:
    """U of group a against b, the tie-corrected z with continuity correction, and the two-sided p."""
    sums, totals = rank_sums(df.where(F.col(group).isin(a, b)), test, group, value)
    side = lambda v, c: F.coalesce(F.max(F.when(F.col(group) == v, F.col(c))), F.lit(0))
    wide = sums.groupBy(*test).agg(side(a, "n").alias("n_a"), side(b, "n").alias("n_b"), side(a, "rank_sum").alias("_ra")).join(totals, list(test))
    product = F.col("n_a") * F.col("n_b").cast("double")
    u = F.col("_ra") - F.col("n_a") * (F.col("n_a") + 1) / 2
    sd = F.sqrt(product / 12 * (F.col("total") + 1 - X.ratio("tie_term", F.col("total") * (F.col("total") - 1))))
    off = F.abs(u - product / 2)
    z = F.when(sd > 0, F.greatest(F.lit(0.0), off - 0.5) / sd)
    return wide.where("n_a > 0 AND n_b > 0").select(*test, "n_a", "n_b", u.alias("u"), z.alias("z")).withColumn("p_value", tests.normal_p("z"))


def kruskal_wallis(df: DataFrame, test: Sequence[str], group: str, value: str) -> DataFrame:
    """H with tie correction over the groups of each test, and its chi-square p."""
    sums, totals = rank_sums(df, test, group, value)
    per = sums.groupBy(*test).agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("_s")).join(totals, list(test))
    n = F.col("total")
    h = 12 / (n * (n + 1)) * F.col("_s") - 3 * (n + 1)
    corrected = X.ratio(h, 1 - X.ratio("tie_term", n * n * n - n))
    return per.select(*test, "k", corrected.alias("h")).withColumn("p_value", tests.chi2_p("h", (F.col("k") - 1).cast("double")))


def pair_differences(df: DataFrame, test: Sequence[str], pair: str, condition: str, value: str, a, b) -> DataFrame:
    """test, pair and _d: a - b of each pair (a missing value is 0); equal ones are left out."""
    side = lambda v: F.coalesce(F.max(F.when(F.col(condition) == v, F.col(value))), F.lit(0.0))
    return df.where(F.col(condition).isin(a, b)).groupBy(*test, pair).agg((side(a) - side(b)).alias("_d")).where("_d != 0")


def signed_ranks(df: DataFrame, test: Sequence[str], pair: str, condition: str, value: str, a, b) -> DataFrame:
    """n, w_plus and w_minus of each test over pairs: sums of the average ranks of positive and negative differences. Tests of any size (see order)."""
    sizes = pair_differences(df, test, pair, condition, value, a, b).groupBy(*test, F.abs("_d").alias("_s")).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_d") > 0).alias("_plus"))
    ranks = order.running_counts(sizes, test, "_s").withColumn("_r", order.mean_rank())
    return ranks.groupBy(*test).agg(F.sum("_n").alias("n"), F.sum(F.col("_plus") * F.col("_r")).alias("w_plus"), F.sum((F.col("_n") - F.col("_plus")) * F.col("_r")).alias("w_minus"))


def wilcoxon(df: DataFrame, test: Sequence[str], pair: str, condition: str, value: str, a, b) -> DataFrame:
    """Exact signed-rank test of a - b over pairs (a missing value is 0, equal ones are skipped).

    A test's distinct differences are one row: the tail of the exact null distribution is summed over their ranks (see tests.signed_tail). A test
    with more than EXACT_PAIRS differences ends the job with an error; signed_ranks gives its statistics.
    """
    plus = F.count_if(F.col("_d") > 0)
    sizes = pair_differences(df, test, pair, condition, value, a, b).groupBy(*test, F.abs("_d").alias("_s")).agg(F.count(F.lit(1)).alias("_n"), plus.alias("_plus"))
    pairs = sizes.groupBy(*test).agg(F.sum("_n").alias("_pairs"), F.sort_array(F.collect_list(F.struct("_s", "_n", "_plus"))).alias("_at"))
    too_many = F.raise_error(F.concat(F.lit(f"more than {EXACT_PAIRS} pairs in a test: "), F.col("_pairs").cast("string")))
    checked = pairs.withColumn("_pairs", F.when(F.col("_pairs") <= EXACT_PAIRS, F.col("_pairs")).otherwise(too_many.cast("long"))).where("_pairs > 0")
    # twice the average rank, as these are halves
    start = F.struct(F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("plus"), F.array().cast("array<long>").alias("ranks"))
    rank = lambda so_far, x: 2 * so_far["before"] + x["_n"] + 1
    add = lambda so_far, x: F.struct((so_far["before"] + x["_n"]).alias("before"), (so_far["plus"] + x["_plus"] * rank(so_far, x)).alias("plus"), F.concat(so_far["ranks"], F.array(rank(so_far, x))).alias("ranks"))
    ranked = checked.withColumn("_sum", F.aggregate("_at", start, add)).repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *test)
    p = tests.signed_p(F.col("_sum.ranks"), F.transform("_at", lambda x: x["_n"]), F.col("_sum.plus"))
    return ranked.select(*test, F.col("_pairs").alias("n"), (F.col("_sum.plus") / 2).alias("w_plus"), p.alias("p_value"))


def pearson(df: DataFrame, by: Sequence[str], x: str, y: str, least: int = 3) -> DataFrame:
    ok = F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    out = df.where(ok).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("_r"))
    return out.withColumn("r", F.when(F.col("n") >= least, F.col("_r"))).drop("_r")


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str, least: int = 3) -> DataFrame:
    """rho over average ranks with its p; null under least pairs or without spread.

    Groups of which each is one task's work are ranked by windows. Otherwise pairs of values are counted; either side's ranks are
    running counts over its distinct values and meet the pairs in a join.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"))
    part = lambda a, b: F.sum(F.col("_n") * F.col(a) * F.col(b))
    most, pairs = order.extent(rows, by)
    if most <= order.ONE_TASK:
        off = lambda v: X.average_rank(list(by), v) - (F.count(F.lit(1)).over(Window.partitionBy(*by)) + 1) / 2
        ranked = order.over_tasks(rows, by, pairs).withColumns({"_n": F.lit(1), "_r_x": off("_x")}).withColumn("_r_y", off("_y"))
        return correlated(ranked, by, part, least)
    cells = kept(order.count_values(rows, by, "_x", "_y"))
    side = lambda v: order.running_counts(cells.groupBy(*by, v).agg(F.sum("_n").alias("_n")), by, v).select(*by, v, (order.mean_rank() - (F.col("_total") + 1) / 2).alias(f"_r{v}"))
    return correlated(cells.join(side("_x"), [*by, "_x"]).join(side("_y"), [*by, "_y"]), by, part, least)


def correlated(ranked: DataFrame, by: Sequence[str], part, least: int) -> DataFrame:
    """n, rho and p_value of rows with ranks _r_x and _r_y about their means, each for _n pairs."""
    out = ranked.groupBy(*by).agg(F.sum("_n").alias("n"), part("_r_x", "_r_y").alias("_xy"), part("_r_x", "_r_x").alias("_xx"), part("_r_y", "_r_y").alias("_yy"))
    rho = F.when((F.col("n") >= least) & (F.col("_xx") > 0) & (F.col("_yy") > 0), F.col("_xy") / F.sqrt(F.col("_xx")) / F.sqrt(F.col("_yy")))
    return out.select(*by, "n", rho.alias("rho")).withColumn("p_value", tests.correlation_p("rho", "n"))


def r2_sweep(df: DataFrame, x: str, y: str, by: str, cutoffs: Sequence[float]) -> DataFrame:
    """n and squared correlation over the rows with `by` of each cutoff or more."""
    grid = shape.literals(df.sparkSession, "cutoff", cutoffs)
    rows = df.select(x, y, by).crossJoin(F.broadcast(grid)).where(F.col(by) >= F.col("cutoff"))
    return rows.groupBy("cutoff").agg(F.count(F.lit(1)).alias("n"), F.pow(F.corr(x, y), F.lit(2.0)).alias("r2"))


def feature_effects(df: DataFrame, features: Sequence[str], group: str, a, b) -> DataFrame:
    """For each feature: n, mean, median and share present in groups a and b, their differences, Cohen's d; one pass over unpivoted rows."""
    long = df.select(group, *(F.col(f).cast("double").alias(f) for f in features)).unpivot([group], list(features), "feature", "value").where("value IS NOT NULL")
    stats = []
    for name, v in (("a", a), ("b", b)):
        x = F.when(F.col(group) == v, F.col("value"))
        stats += [F.count(x).alias(f"n_{name}"), F.avg(x).alias(f"mean_{name}"), F.median(x).alias(f"median_{name}"), F.avg((x > 0).cast("int")).alias(f"present_{name}"), F.var_samp(x).alias(f"_v{name}")]
    out = long.groupBy("feature").agg(*stats)
    pooled = F.sqrt(X.ratio((F.col("n_a") - 1) * F.col("_va") + (F.col("n_b") - 1) * F.col("_vb"), F.col("n_a") + F.col("n_b") - 2))
    diff = F.col("mean_a") - F.col("mean_b")
    return out.withColumns({"diff_mean": diff, "diff_median": F.col("median_a") - F.col("median_b"), "d": F.when(pooled > 0, diff / pooled)}).drop("_va", "_vb")


def lowess(df: DataFrame, by: Sequence[str], x: str, y: str, at: Sequence[float], share: float = 2 / 3, least: int = 3) -> DataFrame:
    """Local linear fit with tricube weights at fixed x inside each group's range; groups under least points give no row.

    The k-th distance of a group's points from each x0 is selected from running counts; the fit is one aggregate of weighted moments
    around x0. Points with one x are summed first.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    points = kept(rows.groupBy(*by, F.col(x).cast("double").alias("_x")).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(y).cast("double")).alias("_y")))
    span = points.groupBy(*by).agg(F.min("_x").alias("_low"), F.max("_x").alias("_high"), F.sum("_n").alias("_points")).where(F.col("_points") >= least)
    spots = span.crossJoin(F.broadcast(shape.literals(df.sparkSession, "x0", at))).where((F.col("_low") <= F.col("x0")) & (F.col("x0") <= F.col("_high")))
    near = points.join(spots.select(*by, "x0", "_points"), list(by)).withColumn("_far", F.abs(F.col("_x") - F.col("x0")))
    key = [*by, "x0"]
    counts = order.running_counts(near.groupBy(*key, "_far").agg(F.sum("_n").alias("_n")), key, "_far")
    kth = F.greatest(F.lit(2), F.ceil(F.lit(float(share)) * F.col("_total")).cast("long"))
    reach = counts.where((F.col("_before") < kth) & (kth <= F.col("_before") + F.col("_n"))).select(*key, F.greatest("_far", F.lit(1e-12)).alias("_h"))
    u, off = F.col("_x") - F.col("x0"), F.greatest(F.lit(0.0), 1 - F.pow(F.col("_far") / F.col("_h"), F.lit(3.0)))
    met = near.join(reach, key).withColumns({"_w": F.pow(off, F.lit(3.0)), "_e": (F.col("_far") <= F.col("_h")).cast("double"), "_u": u})

    def moments(w: str) -> list[Column]:
        n, here = F.col(w) * F.col("_n"), F.col(w) * F.col("_y")
        return [F.sum(v).alias(f"{w}{i}") for i, v in enumerate((n, n * F.col("_u"), n * F.col("_u") * F.col("_u"), here, here * F.col("_u")))]

    sums = met.groupBy(*key).agg(*moments("_w"), *moments("_e"))
    # all points at the edge of the reach have no tricube weight; they count alike then
    n, su, suu, sy, suy = (F.when(F.col("_w0") > 0, F.col(f"_w{i}")).otherwise(F.col(f"_e{i}")) for i in range(5))
    var, cov = suu - su * su / n, suy - su * sy / n
    return sums.select(*key, (sy / n - F.when(var > 1e-12, cov / var).otherwise(0.0) * su / n).alias("fitted"))


def cluster_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Homogeneity, completeness and V-measure of clustering b against a, from one contingency table."""
    rows = df.select(F.col(a).alias("_a"), F.col(b).alias("_b")).dropna()
    cells = rows.groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_n"))

    def entropy(counts: DataFrame, name: str) -> DataFrame:
        n = F.sum("_n")
        return counts.agg((F.log(n) - F.sum(F.col("_n") * F.log("_n")) / n).alias(name))

    side = lambda key: cells.groupBy(key).agg(F.sum("_n").alias("_n"))
    out = entropy(cells, "h_ab").crossJoin(entropy(side("_a"), "h_a")).crossJoin(entropy(side("_b"), "h_b"))  # one row each
    hom = F.when(F.abs("h_a") < 1e-12, 1.0).otherwise(1 - (F.col("h_ab") - F.col("h_b")) / F.col("h_a"))
    com = F.when(F.abs("h_b") < 1e-12, 1.0).otherwise(1 - (F.col("h_ab") - F.col("h_a")) / F.col("h_b"))
    out = out.select(hom.alias("homogeneity"), com.alias("completeness"))
    return out.withColumn("v_measure", F.coalesce(X.ratio(2 * F.col("homogeneity") * F.col("completeness"), F.col("homogeneity") + F.col("completeness")), F.lit(0.0)))


def split_merge(df: DataFrame, prior: str, now: str) -> DataFrame:
    """Prior clusters that are unchanged, split, merged, or both, with their shares (which sum to 1)."""
    pairs = df.select(prior, now).dropna().distinct()
    splits = pairs.groupBy(prior).agg(F.count(F.lit(1)).alias("parts"))
    merges = pairs.groupBy(now).agg(F.count(F.lit(1)).alias("joined"))
    per = pairs.join(merges, now).groupBy(prior).agg(F.max("joined").alias("joined")).join(splits, prior)
    kind = F.when((F.col("parts") > 1) & (F.col("joined") > 1), "split_and_merged").when(F.col("parts") > 1, "split").when(F.col("joined") > 1, "merged").otherwise("unchanged")
    counts = per.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # four rows at most


def error_summary(df: DataFrame, by: Sequence[str], truth: str, estimate: str) -> DataFrame:
    """Median ratio, mean absolute error, recall in per cent and false hits by group."""
    real, found = F.coalesce(F.col(truth) > 0, F.lit(False)), F.coalesce(F.col(estimate) > 0, F.lit(False))
    both = real & found
    return df.groupBy(*by).agg(
        F.median(F.when(both, F.col(estimate) / F.nullif(F.col(truth), F.lit(0.0)))).alias("median_ratio"), F.avg(F.when(both, F.abs(F.col(estimate) - F.col(truth)))).alias("mae"),
        X.ratio(100.0 * F.count_if(both), F.count_if(real)).alias("recall_pct"), F.count_if(found & ~real).alias("false_hits"),
    )


def variation_over_time(df: DataFrame, key: Sequence[str], day: str, value: str, least: int = 2) -> DataFrame:
    """Coefficient of variation over a key's days; null under least days or for a zero mean."""
    days = df.groupBy(*key, day).agg(F.avg(value).alias("_v"))
    return days.groupBy(*key).agg(F.count(F.lit(1)).alias("days"), F.when(F.count(F.lit(1)) >= least, X.ratio(F.stddev_samp("_v"), F.avg("_v"))).alias("cv"))

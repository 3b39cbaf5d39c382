"""Queries of tests, effect sizes and agreement measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions import expr as X
from cohortloom.operators import stats

from .registry import query, table

c = F.col
N = lambda: F.count(F.lit(1))


def _rounded(df, *names, to=6):
    return df.withColumns({n: F.round(n, to) for n in names})


def _tables(spark, d):
    """A 2x2 table for each nation: segment BUILDING against having a large order."""
    big = table(spark, d, "orders").where("o_totalprice > 150000").select(c("o_custkey").alias("c_custkey")).distinct().withColumn("big", F.lit(True))
    x, y = c("c_mktsegment") == "BUILDING", F.coalesce("big", F.lit(False))
    return table(spark, d, "customer").join(big, "c_custkey", "left").groupBy("c_nationkey").agg(F.count_if(x & y).alias("n11"), F.count_if(x & ~y).alias("n10"), F.count_if(~x & y).alias("n01"), F.count_if(~x & ~y).alias("n00"))


def fisher_sql(tab: str, keys: str) -> str:
    """CTEs that end in fisher: the rows of tab (keys, n11, n10, n01, n00) with p_greater and p_two.

    Factorials are logarithms of the gamma function: p of every table with the same margins, then those at least as far out.
    """
    return f"""margin AS (SELECT *, unnest(range(greatest(0, n11 - n00), least(n11 + n10, n11 + n01) + 1)) AS k FROM {tab}),
    chance AS (SELECT *, lgamma(n11 + n10 + 1) - lgamma(k + 1) - lgamma(n11 + n10 - k + 1) + lgamma(n01 + n00 + 1) - lgamma(n11 + n01 - k + 1) - lgamma(n00 - n11 + k + 1) - lgamma(n11 + n10 + n01 + n00 + 1) + lgamma(n11 + n01 + 1) + lgamma(n10 + n00 + 1) AS lp FROM margin),
    beside AS (SELECT *, max(CASE WHEN k = n11 THEN lp END) OVER (PARTITION BY {keys}) AS here FROM chance),
    fisher AS (SELECT {keys}, n11, n10, n01, n00, least(1, sum(exp(lp)) FILTER (k >= n11)) AS p_greater, least(1, sum(exp(lp)) FILTER (lp <= here + 1e-7)) AS p_two FROM beside GROUP BY ALL)"""


_FISHER = f"""b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 150000), t AS (SELECT c_nationkey, count(*) FILTER (s AND g) AS n11, count(*) FILTER (s AND NOT g) AS n10, count(*) FILTER (NOT s AND g) AS n01, count(*) FILTER (NOT s AND NOT g) AS n00
    FROM (SELECT c_nationkey, c_mktsegment = 'BUILDING' AS s, o_custkey IS NOT NULL AS g FROM customer LEFT JOIN b ON c_custkey = o_custkey) GROUP BY 1), {fisher_sql("t", "c_nationkey")}"""


@query(f"WITH {_FISHER} SELECT c_nationkey, n11, n10, n01, n00, round(p_greater, 6) AS p_greater, round(p_two, 6) AS p_two, round(n11 * n00 * 1.0 / nullif(n10 * n01, 0), 6) AS odds_ratio FROM fisher")
def st1_fisher_exact(spark, d):
    return _rounded(stats.fisher_exact(_tables(spark, d), "n11", "n10", "n01", "n00"), "p_greater", "p_two", "odds_ratio")


@query(f"""WITH {_FISHER}, r AS (SELECT c_nationkey, round(p_two, 9) AS p, row_number() OVER (ORDER BY round(p_two, 9), c_nationkey) AS rk, count(*) OVER () AS n FROM fisher)
    SELECT c_nationkey, round(least(1, min(p * n / rk) OVER (ORDER BY rk DESC)), 6) AS q, least(1, min(p * n / rk) OVER (ORDER BY rk DESC)) <= 0.3 AS reject FROM r""")
def st2_bh_fdr(spark, d):
    rows = stats.fisher_exact(_tables(spark, d), "n11", "n10", "n01", "n00").withColumn("p_two", F.round("p_two", 9))
    return _rounded(stats.bh_fdr(rows.withColumn("family", F.lit("all")), "p_two", ["family"], 0.3, ["c_nationkey"]).select("c_nationkey", "q", "reject"), "q")


_RANKS = """r AS (SELECT p_brand AS t, l_returnflag AS g, l_quantity AS v, rank() OVER (PARTITION BY p_brand ORDER BY l_quantity) + (count(*) OVER (PARTITION BY p_brand, l_quantity) - 1) / 2.0 AS r FROM lineitem JOIN part ON l_partkey = p_partkey {w}),
    ties AS (SELECT t, sum(n) AS total, sum(n * n * n - n) AS tie FROM (SELECT t, v, CAST(count(*) AS DOUBLE) AS n FROM r GROUP BY 1, 2) GROUP BY 1)"""


@query(f"""WITH {_RANKS.format(w="WHERE l_returnflag IN ('A', 'R')")}, s AS (SELECT t, count(*) FILTER (g = 'A') AS n_a, count(*) FILTER (g = 'R') AS n_b, sum(r) FILTER (g = 'A') AS ra FROM r GROUP BY 1)
    SELECT s.t AS p_brand, n_a, n_b, ra - n_a * (n_a + 1) / 2 AS u, round(greatest(0, abs(ra - n_a * (n_a + 1) / 2 - n_a * n_b / 2) - 0.5) / sqrt(n_a * n_b / 12.0 * (total + 1 - tie / (total * (total - 1)))), 6) AS z FROM s JOIN ties ON s.t = ties.t""")
def st3_mann_whitney(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), c("l_partkey") == c("p_partkey"))
    return _rounded(stats.mann_whitney(rows, ["p_brand"], "l_returnflag", "l_quantity", "A", "R"), "z").drop("p_value")


@query(f"""WITH {_RANKS.format(w="")}, s AS (SELECT t, g, count(*) AS n, sum(r) AS rs FROM r GROUP BY 1, 2), k AS (SELECT t, count(*) AS k, sum(rs * rs / n) AS s FROM s GROUP BY 1),
    h AS (SELECT k.t AS p_brand, k, (12 / (total * (total + 1)) * s - 3 * (total + 1)) / (1 - tie / (total * total * total - total)) AS h FROM k JOIN ties ON k.t = ties.t) SELECT p_brand, k, round(h, 5) AS h, round(exp(-h / 2), 5) AS p_value FROM h""")
def st4_kruskal_wallis(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), c("l_partkey") == c("p_partkey"))
    return _rounded(stats.kruskal_wallis(rows, ["p_brand"], "l_returnflag", "l_quantity"), "h", "p_value", to=5)


@query()
def st5_wilcoxon(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey", "l_linestatus").agg(F.sum("l_quantity").alias("qty"))
    return stats.wilcoxon(rows, ["l_suppkey"], "l_partkey", "l_linestatus", "qty", "O", "F")


@query("""WITH v AS (SELECT l_suppkey, l_partkey, coalesce(sum(l_quantity) FILTER (l_linestatus = 'O'), 0) - coalesce(sum(l_quantity) FILTER (l_linestatus = 'F'), 0) AS d FROM lineitem GROUP BY 1, 2),
    r AS (SELECT *, rank() OVER (PARTITION BY l_suppkey ORDER BY abs(d)) + (count(*) OVER (PARTITION BY l_suppkey, abs(d)) - 1) / 2.0 AS r FROM v WHERE d <> 0)
    SELECT l_suppkey, count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0) AS w_plus, coalesce(sum(r) FILTER (d < 0), 0) AS w_minus FROM r GROUP BY 1""")
def st5_signed_ranks(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey", "l_linestatus").agg(F.sum("l_quantity").alias("qty"))
    return stats.signed_ranks(rows, ["l_suppkey"], "l_partkey", "l_linestatus", "qty", "O", "F")


@query("""WITH s AS (SELECT l_partkey, count(*) AS n, corr(l_quantity, l_extendedprice) AS r FROM lineitem GROUP BY 1) SELECT l_partkey, n, CASE WHEN n >= 25 THEN round(r, 6) END AS r FROM s""")
def st6_a22_pearson(spark, d):
    return _rounded(stats.pearson(table(spark, d, "lineitem"), ["l_partkey"], "l_quantity", "l_extendedprice", 25), "r")


@query("""WITH k AS (SELECT l_suppkey, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0 AS x, rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_suppkey, l_extendedprice) - 1) / 2.0 AS y FROM lineitem)
    SELECT l_suppkey, count(*) AS n, round(corr(x, y), 6) AS rho FROM k GROUP BY 1""")
def st7_a22_spearman(spark, d):
    return _rounded(stats.spearman(table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice"), "rho").drop("p_value")


@query("""SELECT CAST(cutoff AS DOUBLE) AS cutoff, count(*) AS n, round(pow(corr(l_quantity, l_extendedprice), 2), 6) AS r2 FROM lineitem, (SELECT unnest([0, 10, 25, 40]) AS cutoff) WHERE l_quantity >= cutoff GROUP BY 1""")
def st8_r2_sweep(spark, d):
    return _rounded(stats.r2_sweep(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "l_quantity", [0, 10, 25, 40]), "r2")


@query("""WITH s AS (SELECT l_suppkey, CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1), p AS (SELECT *, k / n AS p, 1.96 AS z FROM s)
    SELECT l_suppkey, round(greatest(0, (p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 6) AS low, round(least(1, (p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 6) AS high FROM p""")
def st9_wilson(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(c("l_returnflag") == "R").alias("k"), N().alias("n"))
    low, high = X.wilson("k", "n")
    return s.select("l_suppkey", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("""WITH u AS (SELECT l_returnflag AS g, v.f AS feature, v.x AS x FROM lineitem, LATERAL (VALUES ('l_quantity', l_quantity), ('l_discount', l_discount), ('l_tax', l_tax)) v(f, x)),
    s AS (SELECT feature, count(*) FILTER (g = 'A') AS n_a, avg(x) FILTER (g = 'A') AS mean_a, median(x) FILTER (g = 'A') AS median_a, avg(CAST(x > 0 AS INT)) FILTER (g = 'A') AS present_a, var_samp(x) FILTER (g = 'A') AS va, count(*) FILTER (g = 'R') AS n_b, avg(x) FILTER (g = 'R') AS mean_b, median(x) FILTER (g = 'R') AS median_b, avg(CAST(x > 0 AS INT)) FILTER (g = 'R') AS present_b, var_samp(x) FILTER (g = 'R') AS vb FROM u GROUP BY 1)
    SELECT feature, n_a, round(mean_a, 6) AS mean_a, median_a, round(present_a, 6) AS present_a, n_b, round(mean_b, 6) AS mean_b, median_b, round(present_b, 6) AS present_b, round(mean_a - mean_b, 6) AS diff_mean, round(median_a - median_b, 6) AS diff_median, round((mean_a - mean_b) / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2)), 6) AS d FROM s""")
def st10_st11_feature_effects(spark, d):
    out = stats.feature_effects(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_returnflag", "A", "R")
    return _rounded(out, "mean_a", "present_a", "mean_b", "present_b", "diff_mean", "diff_median", "d")


@query("""WITH g AS (SELECT l_suppkey AS s, l_quantity AS x, l_extendedprice AS y, CAST(x0 AS DOUBLE) AS x0, abs(l_quantity - x0) AS far, greatest(2, CAST(ceil(2.0 / 3 * count(*) OVER (PARTITION BY l_suppkey, x0)) AS BIGINT)) AS k, count(*) OVER (PARTITION BY l_suppkey, x0) AS n,
        min(l_quantity) OVER (PARTITION BY l_suppkey, x0) AS lo, max(l_quantity) OVER (PARTITION BY l_suppkey, x0) AS hi, row_number() OVER (PARTITION BY l_suppkey, x0 ORDER BY abs(l_quantity - x0)) AS rn FROM lineitem, (SELECT unnest([5, 25, 45]) AS x0)),
    h AS (SELECT *, greatest(max(CASE WHEN rn = k THEN far END) OVER (PARTITION BY s, x0), 1e-12) AS h FROM g WHERE n >= 3 AND x0 BETWEEN lo AND hi), c AS (SELECT *, pow(greatest(0, 1 - pow(far / h, 3)), 3) AS w0, CAST(far <= h AS INT) AS w1 FROM h),
    w AS (SELECT *, CASE WHEN sum(w0) OVER (PARTITION BY s, x0) > 0 THEN w0 ELSE w1 END AS w FROM c), m AS (SELECT *, sum(w * x) OVER p / sum(w) OVER p AS mx, sum(w * y) OVER p / sum(w) OVER p AS my FROM w WINDOW p AS (PARTITION BY s, x0)),
    v AS (SELECT s, x0, any_value(mx) AS mx, any_value(my) AS my, sum(w * (x - mx) * (x - mx)) AS var, sum(w * (x - mx) * (y - my)) AS cov FROM m GROUP BY 1, 2)
    SELECT s AS l_suppkey, x0, round(my + CASE WHEN var > 1e-12 THEN cov / var ELSE 0 END * (x0 - mx), 4) AS fitted FROM v""")
def st12_lowess(spark, d):
    return _rounded(stats.lowess(table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice", [5.0, 25.0, 45.0]), "fitted", to=4)


@query("""WITH x AS (SELECT p_brand AS a, p_type AS b, count(*) AS n FROM part GROUP BY 1, 2), h AS (SELECT (SELECT ln(sum(n)) - sum(n * ln(n)) / sum(n) FROM x) AS ab, (SELECT ln(sum(m)) - sum(m * ln(m)) / sum(m) FROM (SELECT sum(n) AS m FROM x GROUP BY a)) AS ha, (SELECT ln(sum(m)) - sum(m * ln(m)) / sum(m) FROM (SELECT sum(n) AS m FROM x GROUP BY b)) AS hb),
    v AS (SELECT 1 - (ab - hb) / ha AS hom, 1 - (ab - ha) / hb AS com FROM h) SELECT round(hom, 6) AS homogeneity, round(com, 6) AS completeness, round(2 * hom * com / (hom + com), 6) AS v_measure FROM v""")
def st13_cluster_agreement(spark, d):
    return _rounded(stats.cluster_agreement(table(spark, d, "part"), "p_brand", "p_type"), "homogeneity", "completeness", "v_measure")


@query("""WITH x AS (SELECT DISTINCT p_name || p_size % 2 AS a, CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_name || p_size % 2 END AS b FROM part), s AS (SELECT a, count(*) AS parts FROM x GROUP BY 1), m AS (SELECT b, count(*) AS joined FROM x GROUP BY 1), p AS (SELECT x.a, max(joined) AS joined, any_value(parts) AS parts FROM x JOIN m ON x.b = m.b JOIN s ON x.a = s.a GROUP BY 1),
    k AS (SELECT CASE WHEN parts > 1 AND joined > 1 THEN 'split_and_merged' WHEN parts > 1 THEN 'split' WHEN joined > 1 THEN 'merged' ELSE 'unchanged' END AS kind, count(*) AS n FROM p GROUP BY 1) SELECT kind, n, n / sum(n) OVER () AS share FROM k""")
def st14_split_merge(spark, d):
    odd = F.concat("p_name", (c("p_size") % 2).cast("string"))
    rows = table(spark, d, "part").select(odd.alias("a"), F.when(c("p_size") % 3 == 0, c("p_name")).otherwise(odd).alias("b"))
    return stats.split_merge(rows, "a", "b")


@query("""WITH r AS (SELECT l_returnflag AS bin, CASE WHEN l_tax > 0.01 THEN l_quantity ELSE 0 END AS t, CASE WHEN l_discount > 0.01 THEN l_quantity * (1 - l_discount) ELSE 0 END AS e FROM lineitem)
    SELECT bin, round(median(e / nullif(t, 0)) FILTER (t > 0 AND e > 0), 6) AS median_ratio, round(avg(abs(e - t)) FILTER (t > 0 AND e > 0), 6) AS mae, round(100.0 * count(*) FILTER (t > 0 AND e > 0) / count(*) FILTER (t > 0), 6) AS recall_pct, count(*) FILTER (e > 0 AND t = 0) AS false_hits FROM r GROUP BY 1""")
def st15_error_summary(spark, d):
    rows = table(spark, d, "lineitem").select(c("l_returnflag").alias("bin"), F.when(c("l_tax") > 0.01, c("l_quantity")).otherwise(0.0).alias("t"), F.when(c("l_discount") > 0.01, c("l_quantity") * (1 - c("l_discount"))).otherwise(0.0).alias("e"))
    return _rounded(stats.error_summary(rows, ["bin"], "t", "e"), "median_ratio", "mae", "recall_pct")


@query("""WITH x AS (SELECT user_id, event_type, CAST(ts AS DATE) AS day, avg(value) AS v FROM events GROUP BY 1, 2, 3) SELECT user_id, event_type, count(*) AS days, CASE WHEN count(*) >= 2 THEN round(stddev_samp(v) / avg(v), 6) END AS cv FROM x GROUP BY 1, 2""")
def st16_variation_over_time(spark, d):
    return _rounded(stats.variation_over_time(table(spark, d, "events").withColumn("day", c("ts").cast("date")), ["user_id", "event_type"], "day", "value"), "cv")

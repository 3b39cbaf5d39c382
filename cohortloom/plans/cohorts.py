"""Queries of cohort summaries, curves and sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions import expr as X
from cohortloom.operators import cohort, curves, shape

from .registry import query, table

c = F.col
N = lambda: F.count(F.lit(1))


def _round(df, *names, to=6):
    return df.withColumns({n: F.round(n, to) for n in names})


def _lines(spark, d):
    return table(spark, d, "lineitem").join(table(spark, d, "part"), c("l_partkey") == c("p_partkey"))


def _events(spark, d):
    return table(spark, d, "events").withColumn("day", c("ts").cast("date"))


@query("SELECT l_returnflag, p_brand, count(DISTINCT l_partkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def d31_abundance_by_site(spark, d):
    return cohort.abundance_by_site(_lines(spark, d), "l_returnflag", "p_brand", "l_partkey")


@query("""WITH u AS (SELECT v.rank, v.taxon, p_retailprice AS x FROM part, LATERAL (VALUES ('p_type', p_type), ('p_brand', p_brand)) v(rank, taxon)) SELECT rank, taxon, count(*) AS n, median(x) AS mid, round(100.0 * (max(x) - min(x)) / median(x), 6) AS variation_pct FROM u GROUP BY 1, 2 HAVING count(*) >= 2""")
def d38_length_variation(spark, d):
    rows = shape.rank_ladder(table(spark, d, "part"), ["p_retailprice"], ["p_type", "p_brand"])
    return _round(cohort.length_variation(rows, ["rank", "taxon"], "p_retailprice"), "variation_pct")


@query("""WITH z AS (SELECT abs((l_extendedprice - avg(l_extendedprice) OVER w) / stddev_samp(l_extendedprice) OVER w) AS z FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)) SELECT n, band, removed FROM (SELECT count(*) AS n, count(*) FILTER (z > 1) AS a, count(*) FILTER (z > 1.5) AS b FROM z), LATERAL (VALUES (CAST(1 AS DOUBLE), a), (1.5, b)) v(band, removed)""")
def d38_length_outliers(spark, d):
    return cohort.length_outliers(table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", [1, 1.5])


@query("""WITH u AS (SELECT v.rank, v.taxon, l_quantity AS x FROM lineitem JOIN part ON l_partkey = p_partkey, LATERAL (VALUES ('p_type', p_type), ('p_brand', p_brand)) v(rank, taxon))
    SELECT rank, taxon, count(*) AS n, median(x) AS median, quantile_cont(x, 0.75) AS q75, round(avg(CAST(x >= 20 AS INT)), 6) AS share_20, round(avg(CAST(x >= 40 AS INT)), 6) AS share_40, avg(CAST(x >= 20 AS INT)) >= 0.62 AS consistently_high FROM u GROUP BY 1, 2""")
def d52_taxon_summary(spark, d):
    rows = shape.rank_ladder(_lines(spark, d), ["l_quantity"], ["p_type", "p_brand"])
    return _round(cohort.taxon_summary(rows, "l_quantity", (20, 40), high_share=0.62), "share_20", "share_40")


@query("""WITH u AS (SELECT DISTINCT l_orderkey, v.rank, v.taxon FROM lineitem JOIN part ON l_partkey = p_partkey, LATERAL (VALUES ('p_type', p_type), ('p_brand', p_brand)) v(rank, taxon)), t AS (SELECT o_orderpriority, count(*) AS samples FROM orders GROUP BY 1)
    SELECT rank, o.o_orderpriority, taxon, count(*) AS n, any_value(samples) AS samples, round(count(*) * 1.0 / any_value(samples), 6) AS prevalence FROM u JOIN orders o ON l_orderkey = o_orderkey JOIN t ON o.o_orderpriority = t.o_orderpriority GROUP BY 1, 2, 3 HAVING count(*) * 1.0 / any_value(samples) >= 0.1""")
def d53_prevalence(spark, d):
    rows = shape.rank_ladder(_lines(spark, d), ["l_orderkey"], ["p_type", "p_brand"])
    samples = table(spark, d, "orders").select(c("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return _round(cohort.prevalence(rows, samples, "l_orderkey", "o_orderpriority", 0.1), "prevalence")


@query("""WITH m AS (SELECT p_brand, l_orderkey, max(l_discount) AS m FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM orders) SELECT p_brand, cutoff, round(k * 1.0 / (SELECT n FROM n), 6) AS share FROM (SELECT p_brand, count(*) FILTER (m > 0) AS a, count(*) FILTER (m >= 0.05) AS b FROM m GROUP BY 1), LATERAL (VALUES (CAST(0 AS DOUBLE), a), (0.05, b)) v(cutoff, k)""")
def d54_prevalence_at(spark, d):
    n = table(spark, d, "orders").count()
    return _round(cohort.prevalence_at(_lines(spark, d), n, "l_orderkey", "p_brand", "l_discount", [0, 0.05]), "share")


@query("""WITH x AS (SELECT avg(CAST(l_returnflag = 'R' AS INT)) AS r FROM lineitem GROUP BY l_partkey, l_suppkey), k AS (SELECT CASE WHEN r = 0 THEN 'never' WHEN r = 1 THEN 'always' ELSE 'sometimes' END AS consistency FROM x) SELECT consistency, count(*) AS taxa, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share FROM k GROUP BY 1""")
def d55_flag_consistency(spark, d):
    per = cohort.flag_consistency(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], c("l_returnflag") == "R")
    counts = per.groupBy("consistency").agg(N().alias("taxa")).withColumn("all", F.lit(1))
    return _round(counts.withColumn("share", X.share("taxa", "all")).drop("all"), "share")


@query("""WITH t AS (SELECT p_brand FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 6), x AS (SELECT l_returnflag, CASE WHEN p_brand IN (SELECT p_brand FROM t) THEN p_brand ELSE 'Other' END AS category FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT l_returnflag, category, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY l_returnflag), 6) AS share FROM x GROUP BY 1, 2""")
def d56_composition(spark, d):
    return _round(cohort.composition(_lines(spark, d), "l_returnflag", "p_brand", 6), "share")


@query("""SELECT l_orderkey, count(DISTINCT CASE WHEN p_type = 'PROMO' THEN l_partkey END) AS "n_PROMO", coalesce(sum(CASE WHEN p_type = 'PROMO' THEN l_quantity END), 0) AS "sum_PROMO", count(DISTINCT CASE WHEN p_type = 'SMALL' THEN l_partkey END) AS "n_SMALL", coalesce(sum(CASE WHEN p_type = 'SMALL' THEN l_quantity END), 0) AS "sum_SMALL", sum(l_quantity) AS total
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def d57_community_profile(spark, d):
    return cohort.community_profile(_lines(spark, d), "l_orderkey", "p_type", "l_partkey", "l_quantity", ["PROMO", "SMALL"])


@query("""SELECT l_orderkey, p_type, max(l_quantity) AS depth, 'x' AS tool, max(l_quantity) >= 30 AS positive FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'O' GROUP BY 1, 2 UNION ALL SELECT l_orderkey, p_type, max(l_quantity), 'y', max(l_quantity) >= 30 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'F' GROUP BY 1, 2""")
def d58_max_depth(spark, d):
    rows = _lines(spark, d)
    return cohort.max_depth_by_class({"x": rows.where("l_linestatus = 'O'"), "y": rows.where("l_linestatus = 'F'")}, "l_orderkey", "p_type", "l_quantity", 30)


@query("SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS points, date_diff('day', min(CAST(ts AS DATE)), max(CAST(ts AS DATE))) AS span FROM events WHERE value > 150 GROUP BY 1 HAVING span > 14 AND points >= 5")
def d61_eligible_subjects(spark, d):
    return cohort.eligible_subjects(_events(spark, d).where("value > 150"), "user_id", "day", 14, 5)


@query("""WITH b AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, max(value) AS v FROM events GROUP BY 1, 2, 3), s AS (SELECT DISTINCT user_id, event_type FROM b WHERE v > 200), g AS (SELECT DISTINCT e.user_id, CAST(ts AS DATE) AS day, s.event_type FROM events e JOIN s ON e.user_id = s.user_id)
    SELECT g.user_id, g.day, g.event_type, greatest(coalesce(v, 200), 200) AS value FROM g LEFT JOIN b ON g.user_id = b.user_id AND g.day = b.day AND g.event_type = b.event_type""")
def d62_trajectory(spark, d):
    return cohort.trajectory(_events(spark, d), "user_id", "day", "event_type", "value", 200.0)


@query("""WITH p AS (SELECT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'view' GROUP BY 1, 2), x AS (SELECT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'purchase' AND value > 20 GROUP BY 1, 2)
    SELECT p.user_id, 'purchase' AS entity, count(*) AS partner_days, count(x.day) AS detected_days, round(count(x.day) * 1.0 / count(*), 6) AS persistence FROM p LEFT JOIN x ON p.user_id = x.user_id AND p.day = x.day GROUP BY 1""")
def d63_persistence(spark, d):
    e = _events(spark, d)
    pairs = spark.createDataFrame([("view", "purchase")], "partner string, entity string")
    out = cohort.persistence(e.where("event_type = 'purchase' AND value > 20").withColumnRenamed("event_type", "entity"), e.where("event_type = 'view'").withColumnRenamed("event_type", "partner"), "user_id", "day", "entity", "partner", pairs)
    return _round(out, "persistence")


@query("SELECT event_id FROM events e WHERE value > 150 AND EXISTS (SELECT 1 FROM events x WHERE x.value > 150 AND x.user_id = e.user_id AND x.event_type = e.event_type AND NOT x.value > 160)")
def d64_drop_always(spark, d):
    return cohort.drop_always(_events(spark, d).where("value > 150"), ["user_id", "event_type"], c("value") > 160).select("event_id")


@query("SELECT l_orderkey, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN p_brand END) AS n_a, count(DISTINCT CASE WHEN l_returnflag = 'A' THEN p_brand END) AS n_b, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN p_brand END) * 1.0 / nullif(count(DISTINCT CASE WHEN l_returnflag = 'A' THEN p_brand END), 0) AS ratio FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def d65_richness(spark, d):
    return cohort.richness(_lines(spark, d), "l_orderkey", "p_brand", "l_returnflag", "R", "A")


@query("SELECT user_id, event_type, max(value) AS score, CASE WHEN max(value) < 150 THEN 'low' WHEN max(value) < 250 THEN 'mid' ELSE 'high' END AS tier FROM events GROUP BY 1, 2")
def d66_activity_levels(spark, d):
    return cohort.activity_levels(_events(spark, d), "user_id", "event_type", "value", [(150, "low"), (250, "mid")], "high")


@query("""WITH k AS (SELECT * FROM orders WHERE regexp_matches(o_orderpriority, '(?i)urgent|high') AND o_totalprice BETWEEN 1000 AND 150000 AND o_orderdate >= TIMESTAMP '1996-01-01'), b AS (SELECT *, md5(concat_ws(':', o_orderkey, '1')) AS h FROM k QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1),
    l AS (SELECT * FROM b WHERE o_orderstatus IN (SELECT o_orderstatus FROM b GROUP BY 1 HAVING count(*) >= 10)), s AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY h, o_orderkey) <= 200) SELECT o_orderkey, o_custkey, o_orderstatus FROM s ORDER BY h, o_orderkey LIMIT 500""")
def d67_select_cohort(spark, d):
    rows = table(spark, d, "orders")
    keep = c("o_orderpriority").rlike("(?i)urgent|high") & c("o_totalprice").between(1000, 150000) & (c("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))
    return cohort.select_cohort(rows, keep, "o_custkey", [F.desc("o_totalprice"), "o_orderkey"], "o_orderstatus", 10, 200, 500, "o_orderkey").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("""WITH u AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS score, 'customers' AS catalogue FROM customer WHERE c_acctbal > 0 UNION ALL SELECT s_suppkey, s_name, s_acctbal, 'suppliers' FROM supplier WHERE s_acctbal > 1000) SELECT * FROM u WHERE id NOT IN (SELECT p_partkey FROM part WHERE p_size < 10)""")
def d68_unify_catalogues(spark, d):
    a = table(spark, d, "customer").select(c("c_custkey").alias("id"), c("c_name").alias("name"), c("c_acctbal").alias("score"))
    b = table(spark, d, "supplier").select(c("s_suppkey").alias("id"), c("s_name").alias("name"), c("s_acctbal").alias("score"))
    return cohort.unify_catalogues({"customers": (a, c("score") > 0), "suppliers": (b, c("score") > 1000)}, "id long, name string, score double", table(spark, d, "part").where("p_size < 10").select(c("p_partkey").alias("id")), "id")


@query("""WITH j AS (SELECT a.v AS a, b.v AS b, a.v / nullif(b.v, 0) AS r FROM (SELECT l_partkey AS k, avg(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'A' AND l_discount > 0.08 GROUP BY 1) a FULL JOIN (SELECT l_partkey AS k, avg(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.08 GROUP BY 1) b ON a.k = b.k)
    SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS pairs, count(*) FILTER (b IS NULL) AS only_a, count(*) FILTER (a IS NULL) AS only_b, round(avg(CAST(r > 2 AS INT)), 6) AS share_high, round(avg(CAST(r < 0.5 AS INT)), 6) AS share_low, round(corr(a, b), 6) AS r FROM j""")
def d70_compare_measurements(spark, d):
    rows = table(spark, d, "lineitem").where("l_discount > 0.08").groupBy("l_partkey", "l_returnflag").agg(F.avg("l_quantity").alias("v"))
    out = cohort.compare_measurements(rows.where("l_returnflag = 'A'"), rows.where("l_returnflag = 'R'"), ["l_partkey"], "v")
    return _round(out, "share_high", "share_low", "r")


@query("""SELECT p_type, cutoff, round(share, 6) AS share FROM (SELECT p_type, avg(CAST(p_size >= 10 AS INT)) AS a, avg(CAST(p_size >= 40 AS INT)) AS b FROM part GROUP BY 1), LATERAL (VALUES (CAST(10 AS DOUBLE), a), (40, b)) v(cutoff, share)""")
def d74_threshold_shares(spark, d):
    return _round(cohort.threshold_shares(table(spark, d, "part"), "p_size", [10, 40], ["p_type"]), "share")


@query("""WITH a AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_discount > 0.08), b AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_quantity > 45) SELECT l_orderkey, count(*) AS calls, count(*) FILTER (m = 'a') AS by_a FROM (SELECT *, 'a' AS m FROM a UNION ALL SELECT *, 'b' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) GROUP BY 1""")
def d75_hybrid_calls(spark, d):
    rows = table(spark, d, "lineitem")
    calls = cohort.hybrid_calls(rows.where("l_discount > 0.08").select("l_orderkey", "l_suppkey").distinct(), rows.where("l_quantity > 45").select("l_orderkey", "l_suppkey").distinct(), ["l_orderkey", "l_suppkey"])
    return calls.groupBy("l_orderkey").agg(N().alias("calls"), F.count_if(c("method") == "a").alias("by_a"))


@query("""WITH a AS (SELECT p_name AS k, arg_max(p_partkey, p_retailprice * 100000 - p_partkey) AS r FROM part GROUP BY 1), b AS (SELECT p_name AS k, min(p_partkey) FILTER (p_size > 20) AS r FROM part GROUP BY 1), x AS (SELECT a.r = b.r AS same, pa.p_size = pb.p_size AND pa.p_brand = pb.p_brand AS alike FROM a JOIN b ON a.k = b.k JOIN part pa ON pa.p_partkey = a.r JOIN part pb ON pb.p_partkey = b.r)
    SELECT count(*) AS clusters, avg(CAST(same AS INT)) AS same, avg(CAST(same OR alike AS INT)) AS same_or_alike FROM x""")
def d77_representative_agreement(spark, d):
    part = table(spark, d, "part").select(c("p_name").alias("k"), c("p_partkey").alias("representative"), c("p_size").alias("length"), c("p_brand").alias("genes"), "p_retailprice")
    from cohortloom.operators import pick

    a = pick.best_per_key(part, ["k"], [F.desc("p_retailprice"), "representative"])
    b = pick.best_per_key(part.where("length > 20"), ["k"], ["representative"])
    return cohort.representative_agreement(a, b, "k")


#: Replicates of the curves by order, and points of the richness grid, as usual for them.
_REPS, _POINTS = 50, 100


@query(f"""WITH c AS (SELECT p_partkey, p_name, p_size > 25 AS f, rep, md5(concat_ws(':', p_partkey, rep, '1')) AS h FROM part, range({_REPS}) r(rep)), o AS (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY h, p_partkey) AS pos FROM c),
    n AS (SELECT *, row_number() OVER (PARTITION BY rep, p_name ORDER BY pos) AS k, sum(CAST(f AS INT)) OVER (PARTITION BY rep, p_name ORDER BY pos) AS fk FROM o),
    s AS (SELECT pos, sum(CAST(k = 1 AS INT)) OVER w AS t, sum(CAST(k = 2 AS INT)) OVER w AS s, sum(CAST(f AND fk = 1 AS INT)) OVER w AS f FROM n WINDOW w AS (PARTITION BY rep ORDER BY pos))
    SELECT pos, avg(t) AS total, avg(s) AS non_singleton, avg(f) AS flagged, CAST(min(t) AS BIGINT) AS least, CAST(max(t) AS BIGINT) AS most FROM s GROUP BY 1""")
def d29_sp1_accumulation_curve(spark, d):
    return curves.accumulation_curve(table(spark, d, "part"), "p_partkey", "p_name", c("p_size") > 25, _REPS)


@query("""WITH m AS (SELECT p_name, count(*) AS m FROM part GROUP BY 1), t AS (SELECT sum(m) AS n FROM m), g AS (SELECT DISTINCT greatest(1, CAST(floor(i * n / 10) AS BIGINT)) AS k, n FROM t, (SELECT unnest(range(1, 11)) AS i)) SELECT k AS n, round(sum(CASE WHEN n - m < k THEN 1.0 ELSE 1 - exp(lgamma(n - m + 1) - lgamma(n - m - k + 1) - lgamma(n + 1) + lgamma(n - k + 1)) END), 4) AS expected FROM m, g GROUP BY 1""")
def d29_expected_curve(spark, d):
    return _round(curves.expected_curve(table(spark, d, "part"), "p_name", 10), "expected", to=4)


@query(f"""WITH c AS (SELECT p_brand, p_partkey, p_name, rep, md5(concat_ws(':', p_partkey, rep, '1')) AS h FROM part, range({_REPS}) r(rep)), o AS (SELECT *, row_number() OVER (PARTITION BY p_brand, rep ORDER BY h, p_partkey) AS pos FROM c),
    n AS (SELECT *, row_number() OVER (PARTITION BY p_brand, rep, p_name ORDER BY pos) AS k FROM o), s AS (SELECT p_brand, pos, sum(CAST(k = 1 AS INT)) OVER (PARTITION BY p_brand, rep ORDER BY pos) AS t FROM n),
    m AS (SELECT p_brand, pos, avg(t) AS mean, min(t) AS least, max(t) AS most FROM s GROUP BY 1, 2), z AS (SELECT p_brand, count(*) AS size FROM part GROUP BY 1 HAVING count(*) >= 10),
    g AS (SELECT DISTINCT p_brand, greatest(1, CAST(floor(i * size / {_POINTS}) AS BIGINT)) AS n FROM z, range(1, {_POINTS} + 1) r(i))
    SELECT m.p_brand, g.n, mean, CAST(least AS BIGINT) AS least, CAST(most AS BIGINT) AS most FROM m JOIN g ON m.p_brand = g.p_brand AND m.pos = g.n""")
def d30_subset_richness(spark, d):
    return curves.subset_richness(table(spark, d, "part"), "p_partkey", "p_name", "p_brand", _POINTS, _REPS, 10)


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY md5(concat_ws(':', o_orderkey, '1')), o_orderkey LIMIT 100")
def sp2_sample_rows(spark, d):
    return curves.sample_rows(table(spark, d, "orders"), "o_orderkey", 100).select("o_orderkey", "o_custkey")


_SWEEP = """SELECT {by} CAST(cutoff AS DOUBLE) AS cutoff, count(*) FILTER (l_quantity >= cutoff AND t) AS tp, count(*) FILTER (l_quantity >= cutoff AND NOT t) AS fp, count(*) FILTER (l_quantity < cutoff AND t) AS fn FROM (SELECT *, l_returnflag = 'R' AS t FROM lineitem), (SELECT unnest([10, 30, 48]) AS cutoff) GROUP BY ALL"""


@query(f"SELECT *, CASE WHEN tp >= 3 THEN round(tp * 1.0 / (tp + fp), 6) END AS precision, CASE WHEN tp >= 3 THEN round(tp * 1.0 / (tp + fn), 6) END AS recall FROM ({_SWEEP.format(by='')})")
def sp4_cutoff_sweep(spark, d):
    return _round(curves.sweep(table(spark, d, "lineitem"), "l_quantity", c("l_returnflag") == "R", [10, 30, 48]), "precision", "recall")


@query(f"""WITH s AS (SELECT *, CASE WHEN tp >= 1 THEN tp * 1.0 / (tp + fp) END AS p, CASE WHEN tp >= 1 THEN tp * 1.0 / (tp + fn) END AS r FROM ({_SWEEP.format(by="l_suppkey,")}))
    SELECT cutoff, count(p) AS groups, round(quantile_cont(p, 0.25), 6) AS precision_q1, round(quantile_cont(p, 0.5), 6) AS precision_median, round(quantile_cont(p, 0.75), 6) AS precision_q3, round(quantile_cont(r, 0.25), 6) AS recall_q1, round(quantile_cont(r, 0.5), 6) AS recall_median, round(quantile_cont(r, 0.75), 6) AS recall_q3 FROM s GROUP BY 1""")
def sp5_sweep_quartiles(spark, d):
    out = curves.sweep_quartiles(table(spark, d, "lineitem"), "l_quantity", c("l_returnflag") == "R", [10, 30, 48], "l_suppkey")
    return _round(out, *(f"{m}_{q}" for m in ("precision", "recall") for q in ("q1", "median", "q3")))


@query("""WITH r AS (SELECT coalesce(CASE WHEN l_tax > 0.01 THEN l_quantity END, 0) AS r, l_returnflag = 'R' AS t, l_discount > 0.05 AS pred FROM lineitem), p AS (SELECT 'before' AS phase, * FROM r UNION ALL SELECT 'after', * FROM r WHERE pred), s AS (SELECT phase, CAST(cutoff AS DOUBLE) AS cutoff, count(*) FILTER (r >= cutoff AND t) AS tp, count(*) FILTER (r >= cutoff AND NOT t) AS fp, count(*) FILTER (r < cutoff AND t) AS fn FROM p, (SELECT unnest([0, 10, 40]) AS cutoff) GROUP BY 1, 2)
    SELECT *, round(tp * 1.0 / (tp + fp), 6) AS precision, round(tp * 1.0 / (tp + fn), 6) AS recall FROM s""")
def sp6_two_phase_sweep(spark, d):
    rows = table(spark, d, "lineitem").withColumn("r", F.when(c("l_tax") > 0.01, c("l_quantity")))
    return _round(curves.two_phase_sweep(rows, "r", c("l_returnflag") == "R", c("l_discount") > 0.05, [0, 10, 40]), "precision", "recall")

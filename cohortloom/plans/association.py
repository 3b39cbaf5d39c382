"""Queries of partner ratios and association scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions import expr as X
from cohortloom.operators import assoc, pick, shape

from .registry import query, table
from .statistics import fisher_sql

c = F.col
N = lambda: F.count(F.lit(1))


def _round(df, *names, to=6):
    return df.withColumns({n: F.round(n, to) for n in names})


_EP = """e AS (SELECT l_orderkey AS s, l_partkey AS e, max(l_quantity) AS v, any_value('Supplier#' || lpad(CAST(l_partkey % 100 AS VARCHAR), 9, '0')) AS name, any_value(CAST(l_partkey % 25 AS VARCHAR)) AS genus, any_value(CAST(l_partkey % 5 AS VARCHAR)) AS family FROM lineitem GROUP BY 1, 2),
    p AS (SELECT l_orderkey AS s, s_name AS name, CAST(s_nationkey AS VARCHAR) AS genus, CAST(s_nationkey % 5 AS VARCHAR) AS family, max(l_quantity) AS pv FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3, 4)"""


def _ratio_inputs(spark, d):
    li = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "s")
    k = c("e")
    e = li.groupBy("s", c("l_partkey").alias("e")).agg(F.max("l_quantity").alias("v")).withColumns({"name": F.format_string("Supplier#%09d", k % 100), "genus": (k % 25).cast("string"), "family": (k % 5).cast("string")})
    sup = table(spark, d, "supplier").select(c("s_suppkey").alias("l_suppkey"), c("s_name").alias("name"), c("s_nationkey").cast("string").alias("genus"), (c("s_nationkey") % 5).cast("string").alias("family"))
    p = li.groupBy("s", "l_suppkey").agg(F.max("l_quantity").alias("pv")).join(sup, "l_suppkey")
    return e, p


@query(f"""WITH {_EP}, g AS (SELECT s, genus, count(*) AS n, max(pv) AS pv FROM p GROUP BY 1, 2), f AS (SELECT s, family, count(*) AS n, max(pv) AS pv FROM p GROUP BY 1, 2),
    r AS (SELECT e.s, e.e, e.v, p.pv AS p1, CASE WHEN g.n = 1 THEN g.pv END AS p2, CASE WHEN f.n = 1 THEN f.pv END AS p3 FROM e LEFT JOIN p ON e.s = p.s AND e.name = p.name LEFT JOIN g ON e.s = g.s AND e.genus = g.genus LEFT JOIN f ON e.s = f.s AND e.family = f.family)
    SELECT s, e, CASE WHEN p1 IS NOT NULL THEN 'name' WHEN p2 IS NOT NULL THEN 'genus' ELSE 'family' END AS rule, v / coalesce(p1, p2, p3) AS ratio FROM r WHERE coalesce(p1, p2, p3) IS NOT NULL""")
def d43_ratio_cascade(spark, d):
    e, p = _ratio_inputs(spark, d)
    return assoc.ratio_cascade(e, p, "s", "e", "v", "pv", ["name", "genus", "family"], table(spark, d, "lineitem").select(c("l_orderkey").alias("s")))


@query(f"""WITH {_EP} SELECT e.s, e.e, p.name AS partner, v / pv AS ratio FROM e JOIN p ON e.s = p.s AND e.family = p.family QUALIFY row_number() OVER (PARTITION BY e.s, e.e ORDER BY abs(v / pv - 1), p.name) = 1""")
def d44_closest_ratio(spark, d):
    e, p = _ratio_inputs(spark, d)
    pairs = e.select("s", "e", "v", "family").join(p.select("s", "family", c("name").alias("partner"), "pv"), ["s", "family"]).withColumn("ratio", X.ratio("v", "pv"))
    return assoc.closest_ratio(pairs, ["s", "e"], "partner", "ratio").select("s", "e", "partner", "ratio")


@query("""SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.r IS NULL THEN b.r WHEN b.r IS NULL THEN a.r ELSE least(a.r, b.r) END AS low, CASE WHEN a.r IS NULL THEN b.r WHEN b.r IS NULL THEN a.r ELSE greatest(a.r, b.r) END AS high
    FROM (SELECT l_partkey AS k, max(l_quantity) / 10 AS r FROM lineitem WHERE l_discount > 0.09 GROUP BY 1) a FULL JOIN (SELECT l_partkey AS k, min(l_quantity) / 5 AS r FROM lineitem WHERE l_tax > 0.07 GROUP BY 1) b ON a.k = b.k""")
def d45_combine_ratios(spark, d):
    li = table(spark, d, "lineitem").withColumnRenamed("l_partkey", "k")
    return assoc.combine_ratios(li.where("l_discount > 0.09").groupBy("k").agg((F.max("l_quantity") / 10).alias("ratio")), li.where("l_tax > 0.07").groupBy("k").agg((F.min("l_quantity") / 5).alias("ratio")), ["k"])


_SCAN = """a AS (SELECT o_custkey AS s, p_type AS e, sum(l_quantity) AS va FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
    b AS (SELECT o_custkey AS s, s_nationkey AS p, sum(l_quantity) AS vb FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
    x AS (SELECT a.s, e, p, va, vb, va / vb AS r FROM a JOIN b ON a.s = b.s), k AS (SELECT *, rank() OVER (PARTITION BY e, p ORDER BY va) + (count(*) OVER (PARTITION BY e, p, va) - 1) / 2.0 AS ka, rank() OVER (PARTITION BY e, p ORDER BY vb) + (count(*) OVER (PARTITION BY e, p, vb) - 1) / 2.0 AS kb FROM x),
    n11 AS (SELECT e, p, count(*) AS n11, avg(r) AS m, stddev_samp(r) AS sd, median(r) AS md, max(r) AS mx, corr(ka, kb) AS rho FROM k GROUP BY 1, 2), na AS (SELECT e, count(*) AS n FROM a GROUP BY 1), nb AS (SELECT p, count(*) AS n FROM b GROUP BY 1)"""


#: Rows of a key and a name up to which a table is sent to all tasks (some 30 MB).
_SENT = 1 << 19


def _by_key(spark, d, t, key, name, to):
    """A table's names by key, with _to, the place of each among those of its key; sent to all tasks by its count, not by estimate."""
    df = table(spark, d, t)
    named = pick.numbered(df.select(c(key).alias(f"l_{key[2:]}"), c(name).alias(to)), [f"l_{key[2:]}"], [to], f"_{to}")
    return F.broadcast(named) if df.count() <= _SENT else named.hint("shuffle_hash")


def _measures(spark, d):
    """Lines of orders by customer, s, with the type of their part, e, and the nation of their supplier, p, and the number of customers.

    A line counts once for each type of its part and once for each nation of its supplier, however many there are of the other.
    """
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    named = lines.join(_by_key(spark, d, "part", "p_partkey", "p_type", "e"), "l_partkey", "left").join(_by_key(spark, d, "supplier", "s_suppkey", "s_nationkey", "p"), "l_suppkey", "left")
    once = lambda name, other: F.when(F.coalesce(f"_{other}", F.lit(1)) == 1, c(name)).alias(name)
    orders = table(spark, d, "orders").select(c("o_orderkey").alias("l_orderkey"), c("o_custkey").alias("s"))
    # last, as lines of an order are summed where they meet
    rows = named.select("l_orderkey", once("e", "p"), once("p", "e"), "l_quantity").join(F.broadcast(orders) if orders.count() <= _SENT else orders.hint("shuffle_hash"), "l_orderkey")
    return rows.select("s", "e", "p", "l_quantity"), table(spark, d, "customer").count()


def _scan_of(spark, d, candidates, keys=()):
    rows, n = _measures(spark, d)
    return assoc.scan_of_sums(rows, candidates, "s", "e", "p", "l_quantity", n, keys=keys)


def _scan(spark, d):
    return _scan_of(spark, d, table(spark, d, "part").select(c("p_type").alias("e")).distinct().crossJoin(table(spark, d, "nation").select(c("n_nationkey").alias("p"))))


@query(f"""WITH {_SCAN} SELECT na.e, nb.p, coalesce(n11, 0) AS n11, na.n - coalesce(n11, 0) AS n10, nb.n - coalesce(n11, 0) AS n01, (SELECT count(*) FROM customer) - na.n - nb.n + coalesce(n11, 0) AS n00, round(m, 6) AS ratio_mean, round(sd, 6) AS ratio_sd, round(md, 6) AS ratio_median, round(mx, 6) AS ratio_max, round(rho, 6) AS rho, round(100.0 * coalesce(n11, 0) / na.n, 6) AS pct
    FROM na CROSS JOIN nb LEFT JOIN n11 ON n11.e = na.e AND n11.p = nb.p""")
def d46_association_scan(spark, d):
    return _round(_scan(spark, d), "ratio_mean", "ratio_sd", "ratio_median", "ratio_max", "rho", "pct")


_DRAWS = 20


@query(f"""WITH {_SCAN}, mem AS (SELECT n_nationkey AS p, row_number() OVER (ORDER BY md5(concat_ws(':', n_nationkey, '1')), n_nationkey) - 1 AS i, count(*) OVER () AS n FROM nation),
    tru AS (SELECT e, length(e) % 25 AS p FROM (SELECT DISTINCT p_type AS e FROM part)), dr AS (SELECT rep, tru.e, i, ('0x' || md5(concat_ws(':', tru.e, tru.p, rep, '1'))[:8])::BIGINT % (n - 1) AS k FROM tru JOIN mem ON tru.p = mem.p, range({_DRAWS}) r(rep)),
    cand AS (SELECT rep, dr.e, mem.p FROM dr JOIN mem ON mem.i = CASE WHEN k >= dr.i THEN k + 1 ELSE k END)
    SELECT CAST(rep AS INTEGER) AS rep, cand.e, cand.p, coalesce(n11, 0) AS n11, round(m, 6) AS ratio_mean, round(rho, 6) AS rho, round(100.0 * coalesce(n11, 0) / na.n, 6) AS pct FROM cand JOIN na ON cand.e = na.e JOIN nb ON cand.p = nb.p LEFT JOIN n11 ON n11.e = cand.e AND n11.p = cand.p""")
def d47_sp3_null_association(spark, d):
    pairs = table(spark, d, "part").select(c("p_type").alias("e")).distinct().withColumn("p", (F.length("e") % 25).cast("int"))
    drawn = assoc.random_partners(pairs, "e", "p", table(spark, d, "nation").select(c("n_nationkey").alias("p")), _DRAWS)
    scan = _scan_of(spark, d, drawn.select("rep", "e", c("drawn").alias("p")), keys=["rep"])
    return _round(scan, "ratio_mean", "rho", "pct").select("rep", "e", "p", "n11", "ratio_mean", "rho", "pct")


@query(f"""WITH {_SCAN}, q AS (SELECT n11.e, n11.p, n11.p % 4 AS genus, rho, 100.0 * n11 / na.n AS pct FROM n11 JOIN na ON n11.e = na.e), o AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY rho DESC NULLS LAST, p) AS rn FROM (SELECT * FROM q WHERE genus = length(e) % 4))
    SELECT e, count(*) AS members, count(*) FILTER (pct >= 30) AS n_high, round(max(CASE WHEN rn = 1 THEN rho END), 6) AS rho_1, round(max(CASE WHEN rn = 2 THEN rho END), 6) AS rho_2 FROM o GROUP BY 1""")
def d48_congeneric_contrast(spark, d):
    scan = _scan(spark, d).withColumn("genus", c("p") % 4)
    pairs = table(spark, d, "part").select(c("p_type").alias("e")).distinct().withColumn("genus", F.length("e") % 4)
    return _round(assoc.congeneric_contrast(scan, pairs, "e", "p", "genus", 30.0), "rho_1", "rho_2")


@query("""SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_quantity > 10) AS pass_size, count(*) FILTER (l_discount > 0.03) AS pass_price, count(*) FILTER (CASE WHEN l_tax > 0 THEN l_tax < 0.06 END) AS pass_tax, count(*) FILTER (l_quantity > 10 AND l_discount > 0.03 AND CASE WHEN l_tax > 0 THEN l_tax < 0.06 END) AS pass_all FROM lineitem GROUP BY 1""")
def d49_pass_rates(spark, d):
    filters = {"size": c("l_quantity") > 10, "price": c("l_discount") > 0.03, "tax": F.when(c("l_tax") > 0, c("l_tax") < 0.06)}
    return assoc.pass_rates(table(spark, d, "lineitem"), "l_returnflag", filters)


@query(f"""WITH s AS (SELECT o_custkey, count(*) AS n, 100.0 * max(o_totalprice) / sum(o_totalprice) AS dom, avg(o_totalprice) / 100000 AS ratio FROM orders GROUP BY 1), g AS (SELECT unnest([0.8, 1.0, 1.2]) AS cutoff),
    t AS (SELECT CAST(cutoff AS DOUBLE) AS cutoff, count(*) FILTER (ratio >= cutoff AND dom >= 20) AS n11, count(*) FILTER (ratio >= cutoff AND dom < 20) AS n10, count(*) FILTER (ratio < cutoff AND dom >= 20) AS n01, count(*) FILTER (ratio < cutoff AND dom < 20) AS n00 FROM s, g WHERE n >= 2 GROUP BY 1), {fisher_sql("t", "cutoff")}
    SELECT cutoff, n11, n10, n01, n00, round(p_greater, 6) AS p_greater, round(p_two, 6) AS p_two, round(n11 * n00 * 1.0 / nullif(n10 * n01, 0), 6) AS odds_ratio, round(n11 * 1.0 / (n11 + n10), 6) AS rate_over, round(n01 * 1.0 / (n01 + n00), 6) AS rate_below FROM fisher""")
def d50_dominance_test(spark, d):
    s = table(spark, d, "orders").groupBy("o_custkey").agg(N().alias("n"), (100.0 * F.max("o_totalprice") / F.sum("o_totalprice")).alias("dom"), (F.avg("o_totalprice") / 100000).alias("ratio"))
    out = assoc.dominance_test(s, "n", "dom", "ratio", [0.8, 1.0, 1.2], 2, 20)
    return _round(out, "odds_ratio", "rate_over", "rate_below", "p_greater", "p_two")


@query(f"""WITH f AS (SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 180000) AS flag FROM customer), u AS (SELECT DISTINCT o_custkey, v.rank, v.taxon FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey, LATERAL (VALUES ('p_type', p_type), ('p_brand', p_brand)) v(rank, taxon)),
    n AS (SELECT rank, taxon, count(*) AS t, count(*) FILTER (flag) AS n11 FROM u JOIN f ON o_custkey = c_custkey GROUP BY 1, 2), a AS (SELECT count(*) AS n, count(*) FILTER (flag) AS pos FROM f), t AS (SELECT rank, taxon, n11, t - n11 AS n10, pos - n11 AS n01, n - t - pos + n11 AS n00 FROM n, a), {fisher_sql("t", "rank, taxon")},
    o AS (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY p_two, taxon) AS rk, count(*) OVER (PARTITION BY rank) AS m FROM fisher), w AS (SELECT *, least(1, min(p_two * m / rk) OVER (PARTITION BY rank ORDER BY rk DESC)) AS qv FROM o)
    SELECT rank, taxon, n11, n10, n01, n00, round(p_greater, 6) AS p_greater, round(p_two, 6) AS p_two, round(n11 * n00 * 1.0 / nullif(n10 * n01, 0), 6) AS odds_ratio, round(qv, 6) AS q, qv <= 0.05 AS reject FROM w""")
def d51_taxon_association(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 180000").select("o_custkey").distinct().withColumn("flag", F.lit(True))
    outcome = table(spark, d, "customer").select(c("c_custkey").alias("o_custkey")).join(big, "o_custkey", "left").select("o_custkey", F.coalesce("flag", F.lit(False)).alias("flag"))
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), c("l_orderkey") == c("o_orderkey")).join(table(spark, d, "part"), c("l_partkey") == c("p_partkey"))
    out = assoc.taxon_association(shape.rank_ladder(rows, ["o_custkey"], ["p_type", "p_brand"]), outcome, "o_custkey", "flag")
    return _round(out, "p_greater", "p_two", "odds_ratio", "q")


@query("""SELECT l_suppkey, count(*) AS items, count(*) FILTER (l_returnflag = 'R') AS flagged FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_tax, l_extendedprice DESC, l_orderkey, l_linenumber) = 1) GROUP BY 1""")
def d71_best_hit_then_sum(spark, d):
    best = pick.best_per_key(table(spark, d, "lineitem"), ["l_partkey"], ["l_tax", F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"])
    return best.groupBy("l_suppkey").agg(N().alias("items"), F.count_if(c("l_returnflag") == "R").alias("flagged"))

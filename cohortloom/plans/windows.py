"""Queries of window functions, intervals and alignments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortloom.functions import expr as X
from cohortloom.operators import intervals, order, windows

from .registry import query, table

c = F.col
N = lambda: F.count(F.lit(1))


@query("""SELECT p_partkey, round(avg(p_retailprice) OVER w, 6) AS mean, count(*) OVER w AS n, min(p_size) OVER w AS low, round(stddev_samp(p_retailprice) OVER w, 6) AS sd,
    CASE WHEN count(*) OVER w >= 3 AND stddev_samp(p_retailprice) OVER w > 0 THEN round((p_retailprice - avg(p_retailprice) OVER w) / stddev_samp(p_retailprice) OVER w, 6) END AS z FROM part WINDOW w AS (PARTITION BY p_brand)""")
def w1_w8_partition_measures(spark, d):
    w = Window.partitionBy("p_brand")
    return table(spark, d, "part").select("p_partkey", F.round(F.avg("p_retailprice").over(w), 6).alias("mean"), N().over(w).alias("n"), F.min("p_size").over(w).alias("low"), F.round(F.stddev_samp("p_retailprice").over(w), 6).alias("sd"), F.round(X.z_score("p_retailprice", w, 3), 6).alias("z"))


@query("""SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS r,
    round((rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0) / count(*) OVER (PARTITION BY p_brand), 6) AS pct,
    row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS pos, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS idx FROM part""")
def w2_w3_w10_ranks(spark, d):
    w = Window.partitionBy("p_brand")
    return order.with_average_rank(table(spark, d, "part"), ["p_brand"], "p_size", "r").select("p_partkey", "r", F.round(c("r") / c("_total"), 6).alias("pct"), F.row_number().over(w.orderBy(F.desc("p_size"), "p_partkey")).cast("long").alias("pos"), (F.row_number().over(w.orderBy("p_partkey")) - 1).cast("long").alias("idx"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice > 100000 AS big, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos FROM orders),
    f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY pos) = 1 AS first, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY pos) = 2 AS second,
    big AND sum(CAST(big AS INT)) OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY pos ROWS UNBOUNDED PRECEDING) = 1 AS first_ok FROM o)
    SELECT o_orderkey, first, second, first_ok, CAST(sum(CAST(first AS INT)) OVER (PARTITION BY o_custkey ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seen FROM f""")
def w4_w7_occurrences(spark, d):
    o = table(spark, d, "orders")
    order = ["o_orderdate", "o_orderkey"]
    rows = windows.occurrence(windows.occurrence(o, ["o_custkey"], "o_orderstatus", order, 1, "first"), ["o_custkey"], "o_orderstatus", order, 2, "second")
    rows = windows.first_qualifying(rows, ["o_custkey"], "o_orderstatus", order, c("o_totalprice") > 100000)
    return windows.running_sum(rows, ["o_custkey"], order, c("first").cast("int"), "seen").select("o_orderkey", "first", "second", "first_ok", "seen")


@query("""SELECT event_id, date_diff('day', min(CAST(ts AS DATE)) OVER (PARTITION BY user_id), CAST(ts AS DATE)) AS day FROM events""")
def w9_days_since_first(spark, d):
    return windows.days_since_first(table(spark, d, "events").withColumn("d", c("ts").cast("date")), "user_id", "d").select("event_id", "day")


@query("""WITH x AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events), g AS (SELECT user_id, date_diff('day', lag(d) OVER (PARTITION BY user_id ORDER BY d), d) AS gap FROM x)
    SELECT user_id, median(gap) AS median_gap, count(gap) AS n_gaps FROM g GROUP BY 1""")
def w11_gaps(spark, d):
    return windows.gaps(table(spark, d, "events").withColumn("d", c("ts").cast("date")), "user_id", "d")


@query("""SELECT o_orderkey FROM orders QUALIFY (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) % 10 = 0""")
def w12_thinning(spark, d):
    return windows.thinned(table(spark, d, "orders"), ["o_orderstatus"], ["o_orderkey"], 10).select("o_orderkey")


_EVENTS = "SELECT event_id, user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS start, CAST(floor(epoch(ts)) AS BIGINT) + CAST(floor(value * 60) AS BIGINT) AS stop FROM events"


@query(f"""WITH e AS ({_EVENTS}), m AS (SELECT *, CASE WHEN start > max(stop) OVER (PARTITION BY user_id ORDER BY start, stop, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS new FROM e),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY start, stop, event_id ROWS UNBOUNDED PRECEDING) AS i FROM m), u AS (SELECT user_id, i, min(start) AS a, max(stop) AS b FROM g GROUP BY 1, 2)
    SELECT user_id, CAST(sum(b - a + 1) AS BIGINT) AS covered, count(*) AS islands FROM u GROUP BY 1""")
def d40_merge_intervals(spark, d):
    start = F.floor(F.unix_micros(c("ts").cast("timestamp")) / 1_000_000)
    rows = table(spark, d, "events").select("user_id", start.alias("start"), (start + F.floor(c("value") * 60)).alias("stop"))
    return intervals.covered(rows, ["user_id"])


@query(f"""WITH e AS ({_EVENTS}), m AS (SELECT *, CASE WHEN start > max(stop) OVER (ORDER BY start, stop, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS new FROM e),
    g AS (SELECT *, sum(new) OVER (ORDER BY start, stop, event_id ROWS UNBOUNDED PRECEDING) AS i FROM m), u AS (SELECT i, min(start) AS a, max(stop) AS b FROM g GROUP BY 1)
    SELECT CAST(sum(b - a + 1) AS BIGINT) AS covered, count(*) AS islands FROM u""")
def d40_one_axis(spark, d):
    start = F.floor(F.unix_micros(c("ts").cast("timestamp")) / 1_000_000)
    rows = table(spark, d, "events").select(start.alias("start"), (start + F.floor(c("value") * 60)).alias("stop"))
    return intervals.covered(rows, [], bins=True)


def _alignments(spark, d):
    """Alignment lines: the supplier is the query, the part the target; a file for each supplier."""
    q0, span = c("l_linenumber") * 10, c("l_quantity").cast("long")
    rows = table(spark, d, "lineitem").select(
        c("l_suppkey").alias("qname"), c("l_partkey").alias("tname"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("line"), (90 + 100 * c("l_discount")).alias("pid"), (span + 1).cast("double").alias("len"),
        q0.cast("long").alias("qstart"), (q0 + span).alias("qend"), span.alias("tstart"), (2 * span).alias("tend"), F.when(c("l_tax") > 0.07, 1.0).otherwise(1e-9).alias("evalue"), F.lit(100).cast("long").alias("qlen"), F.lit(120).cast("long").alias("tlen"),
    )
    rows = order.over_tasks(rows, ["qname"], rows.count())
    return rows.withColumn("line", F.row_number().over(Window.partitionBy("qname").orderBy("tname", "line", "qend", "pid", "evalue")).cast("long"))


_ALN = """SELECT l_suppkey AS qname, l_partkey AS tname, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey, l_orderkey * 10 + l_linenumber, l_quantity, l_discount, l_tax > 0.07) AS line, 90 + 100 * l_discount AS pid, CAST(l_quantity + 1 AS DOUBLE) AS len, l_linenumber * 10 AS qstart,
    CAST(l_linenumber * 10 + l_quantity AS BIGINT) AS qend, CAST(l_quantity AS BIGINT) AS tstart, CAST(2 * l_quantity AS BIGINT) AS tend, CASE WHEN l_tax > 0.07 THEN 1.0 ELSE 1e-9 END AS evalue FROM lineitem"""


_SUMMARY = f"""WITH a AS (SELECT *, qend - qstart + 1 AS span FROM ({_ALN}) WHERE evalue <= 1e-3), p AS (SELECT *, coalesce(sum(span) OVER (PARTITION BY qname, tname ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM a),
    s AS (SELECT *, max(CAST(prior >= 100 OR prior + span >= 1.1e0 * 100 AS INT)) OVER (PARTITION BY qname, tname ORDER BY line ROWS UNBOUNDED PRECEDING) AS ended FROM p), k AS (SELECT * FROM s WHERE ended = 0),
    pos AS (SELECT qname, tname, 'q' AS side, unnest(range(qstart, qend + 1)) AS x FROM k UNION SELECT qname, tname, 't', unnest(range(tstart, tend + 1)) FROM k),
    cov AS (SELECT qname, tname, count(*) FILTER (side = 'q') AS q, count(*) FILTER (side = 't') AS t FROM pos GROUP BY 1, 2)
    SELECT k.qname, k.tname, count(*) AS num_alns, round(sum(pid * len) / sum(len), 2) AS pid, round(100.0 * any_value(q) / 100, 2) AS qcov, round(100.0 * any_value(t) / 120, 2) AS tcov FROM k JOIN cov ON k.qname = cov.qname AND k.tname = cov.tname GROUP BY 1, 2"""


@query(_SUMMARY)
def d39_alignment_summary(spark, d):
    return intervals.alignment_summary(_alignments(spark, d), groups=["qname"]).select("qname", "tname", "num_alns", "pid", "qcov", "tcov")


@query(_SUMMARY)
def d39_one_file(spark, d):
    # the suppliers' lines one after the other, as lines of one file
    rows = _alignments(spark, d).withColumn("line", c("qname").cast("long") * (1 << 20) + c("line"))
    return intervals.alignment_summary(rows).select("qname", "tname", "num_alns", "pid", "qcov", "tcov")


@query("""WITH e AS (SELECT l_returnflag AS s, l_suppkey AS a, l_partkey AS b, CAST(sum(l_quantity) AS BIGINT) AS f, count(*) * 1000 + CAST(max(l_quantity) AS BIGINT) AS g FROM lineitem GROUP BY 1, 2, 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY s, a ORDER BY f DESC, b) AS rf, row_number() OVER (PARTITION BY s, b ORDER BY g DESC, a) AS rb FROM e) SELECT s, a, b, f, g FROM r WHERE rf = 1 AND rb = 1""")
def d41_reciprocal_best_hits(spark, d):
    e = table(spark, d, "lineitem").groupBy(c("l_returnflag").alias("s"), c("l_suppkey").alias("a"), c("l_partkey").alias("b")).agg(F.sum("l_quantity").cast("long").alias("f"), (N() * 1000 + F.max("l_quantity").cast("long")).alias("g"))
    return intervals.reciprocal_best(e, ["s"], "a", "b", "f", "g")


_PAIRS = """SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'S' || l_suppkey ELSE 'P' || l_partkey END AS query, CASE WHEN l_linenumber % 2 = 0 THEN 'P' || l_partkey ELSE 'S' || l_suppkey END AS reference, l_extendedprice AS score, l_discount AS qcov, l_tax AS rcov FROM lineitem"""


def _pairs(spark, d):
    s, p = F.concat(F.lit("S"), c("l_suppkey").cast("string")), F.concat(F.lit("P"), c("l_partkey").cast("string"))
    even = c("l_linenumber") % 2 == 0
    return table(spark, d, "lineitem").select(F.when(even, s).otherwise(p).alias("query"), F.when(even, p).otherwise(s).alias("reference"), c("l_extendedprice").alias("score"), c("l_discount").alias("qcov"), c("l_tax").alias("rcov"))


@query(f"""WITH e AS ({_PAIRS}), u AS (SELECT * FROM e WHERE query LIKE 'S%' UNION ALL SELECT reference, query, score, rcov, qcov FROM e WHERE reference LIKE 'S%')
    SELECT query, reference, score, qcov, rcov FROM u QUALIFY row_number() OVER (PARTITION BY query, reference ORDER BY score DESC, qcov DESC, rcov DESC) = 1""")
def d42_orient_edges(spark, d):
    ids = table(spark, d, "supplier").select(F.concat(F.lit("S"), c("s_suppkey").cast("string")).alias("id"))
    return intervals.orient_edges(_pairs(spark, d), ids, "id", "score")


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS i FROM part), e AS (SELECT a.p_partkey AS query, b.p_partkey AS reference, abs(a.p_size - b.p_size) * 2 AS score, a.p_type = b.p_type AS parent, a.p_brand = b.p_brand AS child FROM n a JOIN n b ON a.p_name = b.p_name AND b.i BETWEEN a.i + 1 AND a.i + 6)
    SELECT query, reference, score, CAST(1 AS INT) AS level FROM e WHERE parent AND score >= 5.5 UNION ALL SELECT query, reference, score, 2 FROM e WHERE parent AND child AND score >= 32""")
def d37_prune_edges(spark, d):
    part = table(spark, d, "part")
    following = Window.partitionBy("p_name").orderBy("p_partkey").rowsBetween(1, 6)  # edges to the next six of a name
    near = part.withColumn("next", F.collect_list(F.struct(c("p_partkey").alias("k"), c("p_size").alias("s"))).over(following)).withColumn("n", F.explode("next"))
    edges = near.select(c("p_partkey").alias("query"), c("n.k").alias("reference"), (F.abs(c("p_size") - c("n.s")) * 2).alias("score"))
    one = intervals.prune_edges(edges, part, "p_partkey", "p_type", "score", 5.5)
    two = intervals.prune_edges(one, part, "p_partkey", "p_brand", "score", 32)
    return one.withColumn("level", F.lit(1)).unionByName(two.withColumn("level", F.lit(2)))

"""Queries of identifier propagation, consensus and label comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions import expr as X
from cohortloom.operators import consensus, hierarchy, joins, pick, shape

from .registry import query, table

c = F.col
N = lambda: F.count(F.lit(1))

_EVIDENCE = "SELECT o_custkey, p_brand, CASE WHEN p_size > 5 THEN p_type END AS p_type, l_quantity, l_discount FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"
_TOP = """v AS (SELECT o_custkey, rank, label, count(*) AS votes FROM (SELECT o_custkey, 'p_brand' AS rank, p_brand AS label FROM {e} UNION ALL SELECT o_custkey, 'p_type', p_type FROM {e}) WHERE label IS NOT NULL GROUP BY 1, 2, 3),
    t AS (SELECT *, CAST(sum(votes) OVER (PARTITION BY o_custkey, rank) AS BIGINT) AS total, row_number() OVER (PARTITION BY o_custkey, rank ORDER BY votes DESC, label) AS rn FROM v)"""


def _evidence(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), c("l_orderkey") == c("o_orderkey")).join(table(spark, d, "part"), c("l_partkey") == c("p_partkey"))
    return rows.select("o_custkey", "p_brand", F.when(c("p_size") > 5, c("p_type")).alias("p_type"), "l_quantity", "l_discount")


@query(f"""WITH e AS ({_EVIDENCE}), {_TOP.format(e="e")} SELECT o_custkey, rank, label, votes, total, votes * 1.0 / total AS agreement FROM t WHERE rn = 1 AND votes * 1.0 / total >= 0.2""")
def d4_evidence_consensus(spark, d):
    return consensus.evidence_consensus(_evidence(spark, d), "o_custkey", ["p_brand", "p_type"], 0.2)


@query(f"""WITH e AS ({_EVIDENCE}), {_TOP.format(e="e")}, h AS (SELECT o_custkey, count(*) AS total FROM e GROUP BY 1) SELECT t.o_custkey, rank, label, votes, h.total, votes * 1.0 / h.total AS agreement FROM t JOIN h ON t.o_custkey = h.o_custkey WHERE rn = 1""")
def d4_consensus_over_all_hits(spark, d):
    return consensus.evidence_consensus(_evidence(spark, d), "o_custkey", ["p_brand", "p_type"], all_hits=True)


@query(f"""WITH e AS ({_EVIDENCE}), {_TOP.format(e="e")}, g AS (SELECT unnest([0.1, 0.2, 0.3, 0.5]) AS cutoff)
    SELECT rank, CAST(cutoff AS DOUBLE) AS cutoff, count(DISTINCT t.o_custkey) AS entities, count(DISTINCT c_nationkey) AS clusters FROM t JOIN customer ON c_custkey = t.o_custkey JOIN g ON votes * 1.0 / total >= cutoff WHERE rn = 1 GROUP BY 1, 2""")
def d5_threshold_sweep(spark, d):
    top = consensus.evidence_consensus(_evidence(spark, d), "o_custkey", ["p_brand", "p_type"])
    return consensus.threshold_sweep(top, table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey", "c_nationkey", [0.1, 0.2, 0.3, 0.5])


@query(f"""WITH e AS ({_EVIDENCE}), s AS (SELECT * FROM e WHERE l_quantity > 48) SELECT o_custkey, p_brand, 'strict' AS evidence, count(*) AS n FROM s GROUP BY 1, 2 UNION ALL
    SELECT o_custkey, p_brand, 'relaxed', count(*) FROM e WHERE l_quantity > 30 AND o_custkey NOT IN (SELECT o_custkey FROM s) GROUP BY 1, 2""")
def d6_evidence_cascade(spark, d):
    e = _evidence(spark, d)
    return consensus.evidence_cascade(e.where("l_quantity > 48"), e.where("l_quantity > 30"), "o_custkey").groupBy("o_custkey", "p_brand", "evidence").agg(N().alias("n"))


_TWO = f"""a0 AS (SELECT * FROM ({_EVIDENCE}) WHERE l_quantity > 25), b0 AS (SELECT * FROM ({_EVIDENCE}) WHERE l_discount > 0.03),
    a AS (WITH {_TOP.format(e="a0")} SELECT o_custkey, rank, label, votes, votes * 1.0 / total AS agreement FROM t WHERE rn = 1),
    b AS (WITH {_TOP.format(e="b0")} SELECT o_custkey, rank, label, votes, votes * 1.0 / total AS agreement FROM t WHERE rn = 1)"""


def _two(spark, d):
    e = _evidence(spark, d)
    one = lambda rows: consensus.evidence_consensus(rows, "o_custkey", ["p_brand", "p_type"])
    return one(e.where("l_quantity > 25")), one(e.where("l_discount > 0.03"))


_MERGED = """m AS (SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, coalesce(a.rank, b.rank) AS rank, CASE WHEN a.label IS NOT NULL AND (b.label IS NULL OR a.votes >= b.votes) THEN a.label ELSE b.label END AS label,
    CASE WHEN a.label = b.label THEN a.votes + b.votes WHEN a.label IS NOT NULL AND (b.label IS NULL OR a.votes >= b.votes) THEN a.votes ELSE b.votes END AS votes,
    CASE WHEN a.label = b.label THEN least(a.agreement, b.agreement) WHEN a.label IS NOT NULL AND (b.label IS NULL OR a.votes >= b.votes) THEN a.agreement ELSE b.agreement END AS agreement,
    CASE WHEN a.label = b.label THEN 'both' WHEN a.label IS NOT NULL AND (b.label IS NULL OR a.votes >= b.votes) THEN 'large' ELSE 'cheap' END AS method
    FROM (SELECT * FROM a WHERE agreement >= 0.15 AND votes >= 3) a FULL JOIN (SELECT * FROM b WHERE agreement >= 0.15 AND votes >= 3) b ON a.o_custkey = b.o_custkey AND a.rank = b.rank)"""


@query(f"WITH {_TWO}, {_MERGED} SELECT * FROM m")
def d7_merge_methods(spark, d):
    a, b = _two(spark, d)
    return consensus.merge_methods(a, b, ["o_custkey", "rank"], ("large", "cheap"), 0.15, 3)


@query(f"""WITH {_TWO}, {_MERGED} SELECT o_custkey, rank, label, votes, method FROM m WHERE rank = 'p_brand' AND votes >= 5 OR rank = 'p_type' AND votes >= 8 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE rank WHEN 'p_brand' THEN 0 ELSE 1 END, label) = 1""")
def d8_rank_ladder(spark, d):
    a, b = _two(spark, d)
    merged = consensus.merge_methods(a, b, ["o_custkey", "rank"], ("large", "cheap"), 0.15, 3)
    return consensus.assign_by_ladder(merged, "o_custkey", ["p_brand", "p_type"], [5, 8]).select("o_custkey", "rank", "label", "votes", "method")


@query(f"""WITH {_TWO}, w AS (SELECT c_custkey AS o_custkey, max(CASE WHEN s = 'a' AND rank = 'p_brand' THEN label END) AS ba, max(CASE WHEN s = 'a' AND rank = 'p_brand' AND votes > 4 THEN votes ELSE 0 END) AS bav,
    max(CASE WHEN s = 'b' AND rank = 'p_brand' THEN label END) AS bb, max(CASE WHEN s = 'b' AND rank = 'p_brand' AND votes > 4 THEN votes ELSE 0 END) AS bbv, max(CASE WHEN s = 'a' AND rank = 'p_type' THEN label END) AS ta, max(CASE WHEN s = 'a' AND rank = 'p_type' THEN votes ELSE 0 END) AS tav,
    max(CASE WHEN s = 'b' AND rank = 'p_type' THEN label END) AS tb, max(CASE WHEN s = 'b' AND rank = 'p_type' THEN votes ELSE 0 END) AS tbv FROM customer LEFT JOIN (SELECT 'a' AS s, * FROM a UNION ALL SELECT 'b', * FROM b) u ON c_custkey = o_custkey GROUP BY 1)
    SELECT o_custkey, CASE WHEN greatest(bav, bbv) > 0 THEN CASE WHEN bav >= bbv THEN ba ELSE bb END WHEN greatest(tav, tbv) > 0 THEN CASE WHEN tav >= tbv THEN ta ELSE tb END END AS final_label,
    CASE WHEN greatest(bav, bbv) > 0 THEN 'brand' WHEN greatest(tav, tbv) > 0 THEN 'type' END AS final_rank FROM w""")
def d9_a9_label_priority(spark, d):
    a, b = _two(spark, d)
    rows = a.withColumn("s", F.lit("a")).unionByName(b.withColumn("s", F.lit("b")))
    wide = []
    for rank in ("brand", "type"):
        for s in "ab":
            here = (c("rank") == f"p_{rank}") & (c("s") == s)
            wide += [F.max(F.when(here, c("label"))).alias(f"{rank}_{s}_label"), F.max(F.when(here & ((c("votes") > 4) | F.lit(rank == "type")), c("votes"))).alias(f"{rank}_{s}_votes")]
    flat = table(spark, d, "customer").select(c("c_custkey").alias("o_custkey")).join(rows.groupBy("o_custkey").agg(*wide), "o_custkey", "left")
    return consensus.label_priority(flat, ["brand", "type"], ["a", "b"]).select("o_custkey", "final_label", "final_rank")


@query(f"""WITH {_TWO} SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, coalesce(a.rank, b.rank) AS rank, CASE WHEN a.label IS NOT NULL AND coalesce(a.votes * a.agreement, 0) >= coalesce(b.votes * b.agreement, 0) THEN a.label ELSE coalesce(b.label, a.label) END AS label,
    round(greatest(coalesce(a.votes * a.agreement, 0), coalesce(b.votes * b.agreement, 0)), 6) AS weight, CASE WHEN a.label IS NOT NULL AND coalesce(a.votes * a.agreement, 0) >= coalesce(b.votes * b.agreement, 0) OR b.label IS NULL THEN 'large' ELSE 'cheap' END AS method
    FROM a FULL JOIN b ON a.o_custkey = b.o_custkey AND a.rank = b.rank""")
def d10_weighted_merge(spark, d):
    a, b = _two(spark, d)
    return consensus.weighted_merge(a, b, ["o_custkey", "rank"], ("large", "cheap")).withColumn("weight", F.round("weight", 6))


@query("""WITH p AS (SELECT p_partkey, p_brand AS old_name, p_type || (p_size % 3) AS new_name FROM part WHERE p_partkey % 4 <> 0), v AS (SELECT old_name, new_name, count(*) AS votes FROM p GROUP BY 1, 2),
    m AS (SELECT *, CAST(sum(votes) OVER (PARTITION BY old_name) AS BIGINT) AS total FROM v QUALIFY row_number() OVER (PARTITION BY old_name ORDER BY votes DESC, new_name) = 1)
    SELECT p_partkey, coalesce(m.new_name, p_brand) AS name, coalesce(m.new_name, p_brand) = p_type || (p_size % 3) AS same FROM part LEFT JOIN m ON p_brand = old_name AND p_brand <> 'Brand#3'""")
def d12_release_map(spark, d):
    part = table(spark, d, "part").withColumn("new", F.concat("p_type", (c("p_size") % 3).cast("string")))
    shared = part.where("p_partkey % 4 != 0")
    names = consensus.release_map(shared.select("p_partkey", c("p_brand").alias("name")), shared.select("p_partkey", c("new").alias("name")), "p_partkey", "name").where("old_name != 'Brand#3'")
    out = joins.lookup_default(part, "p_brand", names, "old_name", "new_name", "name", c("p_brand"))
    return out.select("p_partkey", "name", consensus.same_species("name", "new").alias("same"))


@query(f"""WITH e AS ({_EVIDENCE}), {_TOP.format(e="e")}, p AS (SELECT o_custkey, label FROM t WHERE rn = 1 AND rank = 'p_type' AND votes * 1.0 / total >= 0.25)
    SELECT c_mktsegment, count(*) AS n, count(label) AS annotated, count(*) FILTER (label = truth) AS tp, count(*) FILTER (label <> truth) AS fp, count(label) * 1.0 / count(*) AS rate, count(*) FILTER (label = truth) * 1.0 / nullif(count(label), 0) AS agreement
    FROM (SELECT c_custkey, c_mktsegment, CASE c_custkey % 3 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'PROMO' ELSE 'LARGE' END AS truth FROM customer) x LEFT JOIN p ON c_custkey = p.o_custkey GROUP BY 1""")
def d13_benchmark_labels(spark, d):
    predicted = consensus.evidence_consensus(_evidence(spark, d), "o_custkey", ["p_type"], 0.25).select("o_custkey", "label")
    truth = table(spark, d, "customer").select(c("c_custkey").alias("o_custkey"), "c_mktsegment", F.when(c("c_custkey") % 3 == 0, "ECONOMY").when(c("c_custkey") % 3 == 1, "PROMO").otherwise("LARGE").alias("truth"))
    return consensus.benchmark_labels(predicted, truth, ["o_custkey"], ["c_mktsegment"])


@query("""WITH r AS (SELECT l_returnflag || l_linestatus AS a, p_type AS b, l_quantity AS s FROM lineitem JOIN part ON l_partkey = p_partkey), v AS (SELECT a, b, count(*) AS n FROM r GROUP BY 1, 2),
    t AS (SELECT a, b, n FROM v QUALIFY row_number() OVER (PARTITION BY a ORDER BY n DESC, b) = 1) SELECT r.a, count(*) AS n, count(DISTINCT r.b) AS partners, median(s) AS median_support, any_value(t.b) AS top_partner, any_value(t.n) AS top_n FROM r JOIN t ON r.a = t.a GROUP BY 1""")
def d14_disagreements(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), c("l_partkey") == c("p_partkey")).select(F.concat("l_returnflag", "l_linestatus").alias("a"), c("p_type").alias("b"), c("l_quantity").alias("s"))
    return consensus.disagreements(rows, "a", "b", "s")


@query("""WITH h AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_brand AS hash FROM part WHERE p_partkey % 5 <> 0), r AS (SELECT p_brand AS hash, arg_min(p_name, p_partkey) AS rep FROM part GROUP BY 1), q AS (SELECT p_name AS rep, min(p_size) AS size FROM part GROUP BY 1),
    s AS (SELECT CAST(p_partkey AS VARCHAR) || CASE WHEN p_partkey % 3 = 0 THEN '.1' ELSE '' END AS id FROM part)
    SELECT s.id, coalesce(a.hash, b.hash) AS hash, r.rep, q.size FROM s LEFT JOIN h a ON s.id = a.id LEFT JOIN h b ON regexp_replace(s.id, '\\.\\d+$', '') = b.id LEFT JOIN r ON coalesce(a.hash, b.hash) = r.hash LEFT JOIN q ON r.rep = q.rep""")
def d1_build_metadata(spark, d):
    part = table(spark, d, "part")
    key = c("p_partkey").cast("string")
    source = part.select(F.concat(key, F.when(c("p_partkey") % 3 == 0, ".1").otherwise("")).alias("id"))
    hashes = part.where("p_partkey % 5 != 0").select(key.alias("id"), c("p_brand").alias("hash"))
    reps = part.select(c("p_brand").alias("hash"), c("p_name").alias("rep"), c("p_partkey").alias("rep_order"))
    return hierarchy.build_metadata(source, hashes, X.normal_id("id"), reps, [part.select(c("p_name").alias("rep"), c("p_size").alias("size"))]).select("id", "hash", "rep", "size")


@query("""SELECT s_suppkey, s_nationkey, n_name, n_regionkey, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def d2_membership(spark, d):
    nation = table(spark, d, "nation").select(c("n_nationkey").alias("s_nationkey"), "n_name", "n_regionkey")
    region = table(spark, d, "region").select(c("r_regionkey").alias("n_regionkey"), "r_name")
    return hierarchy.membership(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), [("s_nationkey", nation), ("n_regionkey", region)])


@query("""SELECT l_partkey, l_suppkey, coalesce(CASE WHEN l_tax > 0.02 THEN l_extendedprice END, 0) AS score FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY score DESC, l_suppkey, l_orderkey) = 1""")
def d3_best_annotation(spark, d):
    rows = table(spark, d, "lineitem").withColumn("score", F.when(c("l_tax") > 0.02, c("l_extendedprice")))
    return hierarchy.best_annotation(rows, "l_partkey", "score", ["l_suppkey", "l_orderkey"]).select("l_partkey", "l_suppkey", "score")


@query("""WITH x AS (SELECT DISTINCT p_brand, p_partkey, l_returnflag AS site FROM part JOIN lineitem ON l_partkey = p_partkey), v AS (SELECT p_brand, site, count(*) AS votes FROM x GROUP BY 1, 2),
    t AS (SELECT *, CAST(sum(votes) OVER (PARTITION BY p_brand) AS BIGINT) AS members FROM v QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY votes DESC, site) = 1) SELECT p_brand, members, site, votes * 1.0 / members AS share, votes = members AS perfect FROM t WHERE members >= 2""")
def d32_site_agreement(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), c("l_partkey") == c("p_partkey")).withColumnRenamed("l_returnflag", "site")
    return hierarchy.site_agreement(rows, ["p_brand"], "p_partkey", "site")


@query("""WITH x AS (SELECT p_type, p_brand, l_returnflag AS site FROM part JOIN lineitem ON l_partkey = p_partkey), u AS (SELECT 'p_type' AS rank, p_type AS taxon, site FROM x UNION ALL SELECT 'p_brand', p_brand, site FROM x)
    SELECT rank, site, count(DISTINCT taxon) AS n FROM u GROUP BY 1, 2 UNION ALL SELECT rank, 'total', count(DISTINCT taxon) FROM u GROUP BY 1""")
def d33_rank_site_counts(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), c("l_partkey") == c("p_partkey"))
    long = shape.rank_ladder(rows, ["l_returnflag"], ["p_type", "p_brand"]).withColumn("site", F.explode(F.array(c("l_returnflag"), F.lit("total"))))
    return long.groupBy("rank", "site").agg(F.countDistinct("taxon").alias("n"))


@query("""WITH u AS (SELECT cr AS cluster_rank, lr AS label_rank, cid, label FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey, LATERAL (VALUES ('p_type', p_type), ('p_brand', p_brand)) a(cr, cid), LATERAL (VALUES ('supplier', s_name), ('nation', CAST(s_nationkey AS VARCHAR))) b(lr, label)),
    v AS (SELECT cluster_rank, label_rank, cid, label, count(*) AS votes FROM u GROUP BY 1, 2, 3, 4), t AS (SELECT *, sum(votes) OVER (PARTITION BY cluster_rank, label_rank, cid) AS total FROM v QUALIFY row_number() OVER (PARTITION BY cluster_rank, label_rank, cid ORDER BY votes DESC, label) = 1)
    SELECT cluster_rank, label_rank, count(*) AS clusters, round(avg(votes * 1.0 / total), 6) AS mean_share, avg(CAST(votes = total AS INT)) AS perfect FROM t WHERE total >= 3 GROUP BY 1, 2""")
def d34_label_consistency(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), c("l_partkey") == c("p_partkey")).join(table(spark, d, "supplier"), c("l_suppkey") == c("s_suppkey"))
    rows = rows.select("p_type", "p_brand", c("s_name").alias("supplier"), c("s_nationkey").cast("string").alias("nation"))
    long = shape.rank_ladder(shape.rank_ladder(rows, ["supplier", "nation"], ["p_type", "p_brand"], "cluster_rank", "cid"), ["cluster_rank", "cid"], ["supplier", "nation"], "label_rank", "label")
    return consensus.agreement_share(long, ["cluster_rank", "label_rank", "cid"], "label").withColumn("mean_share", F.round("mean_share", 6))


@query("""SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING bool_and(l_returnflag = 'R')""")
def d35_one_source_clusters(spark, d):
    return hierarchy.one_source_clusters(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], c("l_returnflag") == "R")


@query("""WITH m AS (SELECT p_name AS cluster, p_partkey AS entity, p_retailprice AS len, p_size % 4 = 0 AS complete, p_size % 10 AS genes FROM part), s AS (SELECT cluster, median(len) AS mid, count(*) AS n, max(genes) AS g FROM m GROUP BY 1),
    t AS (SELECT m.*, CASE WHEN n = 1 THEN 0 WHEN complete AND len >= mid THEN 1 WHEN genes = g THEN 2 ELSE 3 END AS tier, mid FROM m JOIN s ON m.cluster = s.cluster)
    SELECT cluster, entity AS representative, tier FROM t QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY tier, CASE WHEN tier = 1 THEN -len ELSE abs(len - mid) END, entity) = 1""")
def d36_pick_representative(spark, d):
    m = table(spark, d, "part").select(c("p_name").alias("cluster"), c("p_partkey").alias("entity"), c("p_retailprice").alias("len"), (c("p_size") % 4 == 0).alias("complete"), (c("p_size") % 10).alias("genes"))
    return pick.pick_representative(m, "cluster", "entity", "len", "complete", "genes")


@query("""SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 190000 UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 150000) OR c_mktsegment = 'MACHINERY' AS integrated FROM customer""")
def d27_integration_status(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return hierarchy.integration_status(table(spark, d, "customer"), "c_custkey", [o.where("o_totalprice > 190000"), o.where("o_orderstatus = 'P' AND o_totalprice > 150000")], c("c_mktsegment") == "MACHINERY").select("c_custkey", "integrated")


@query("""WITH b AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'x' ELSE p_brand END AS p_brand, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_type END AS p_type FROM part WHERE p_partkey % 9 <> 0), a AS (SELECT p_partkey, p_brand, CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_type END AS p_type FROM part)
    SELECT count(*) AS n, avg(CAST(a.p_brand IS NOT DISTINCT FROM b.p_brand AS INT)) AS match_p_brand, avg(CAST(a.p_type IS NOT DISTINCT FROM b.p_type AS INT)) AS match_p_type, avg(CAST(a.p_brand IS NOT DISTINCT FROM b.p_brand AND a.p_type IS NOT DISTINCT FROM b.p_type AS INT)) AS match_all FROM a JOIN b ON a.p_partkey = b.p_partkey""")
def d28_release_compare(spark, d):
    part = table(spark, d, "part")
    a = part.select("p_partkey", "p_brand", F.when(c("p_size") % 10 != 0, c("p_type")).alias("p_type"))
    b = part.where("p_partkey % 9 != 0").select("p_partkey", F.when(c("p_size") % 7 == 0, "x").otherwise(c("p_brand")).alias("p_brand"), F.when(c("p_size") % 5 != 0, c("p_type")).alias("p_type"))
    return hierarchy.release_compare(a, b, ["p_partkey"], ["p_brand", "p_type"])


@query("""SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, coalesce(a.v, b.v) AS v, CASE WHEN a.v IS NOT NULL AND b.v IS NOT NULL THEN 'both' WHEN a.v IS NOT NULL THEN 'new' ELSE 'old' END AS provenance
    FROM (SELECT p_partkey, p_brand AS v FROM part WHERE p_size > 20) a FULL JOIN (SELECT p_partkey, p_type AS v FROM part WHERE p_size < 30) b ON a.p_partkey = b.p_partkey""")
def d60_source_priority(spark, d):
    part = table(spark, d, "part")
    return hierarchy.source_priority(part.where("p_size > 20").select("p_partkey", c("p_brand").alias("v")), part.where("p_size < 30").select("p_partkey", c("p_type").alias("v")), "p_partkey", "v")


@query("""WITH v AS (SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) WHEN count(DISTINCT l_returnflag) > 1 THEN 'MIXED' END AS l_returnflag FROM lineitem GROUP BY 1) SELECT o_orderkey, l_returnflag AS label FROM orders LEFT JOIN v ON o_orderkey = l_orderkey""")
def d59_cluster_vote(spark, d):
    votes = consensus.cluster_vote(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag")
    return table(spark, d, "orders").join(votes, c("o_orderkey") == c("l_orderkey"), "left").select("o_orderkey", c("l_returnflag").alias("label"))


@query("""WITH r AS (SELECT a.ca, b.cb FROM (SELECT p_partkey, CASE WHEN p_size > 30 THEN 'high' ELSE 'low' END AS ca FROM part WHERE p_partkey % 3 <> 0) a FULL JOIN (SELECT p_partkey, CASE WHEN p_retailprice > 950 THEN 'high' ELSE 'low' END AS cb FROM part WHERE p_partkey % 4 <> 0) b ON a.p_partkey = b.p_partkey)
    SELECT count(*) FILTER (coalesce(ca = 'high', false) AND coalesce(cb = 'high', false)) AS both_high, count(*) FILTER (coalesce(ca = 'high', false) AND NOT coalesce(cb = 'high', false)) AS only_a, count(*) FILTER (NOT coalesce(ca = 'high', false) AND coalesce(cb = 'high', false)) AS only_b,
    count(*) FILTER (NOT coalesce(ca = 'high', false) AND NOT coalesce(cb = 'high', false)) AS neither, count(*) FILTER (ca IS NULL) AS missing_a, count(*) FILTER (cb IS NULL) AS missing_b FROM r""")
def d72_confidence_tally(spark, d):
    part = table(spark, d, "part")
    a = part.where("p_partkey % 3 != 0").select("p_partkey", F.when(c("p_size") > 30, "high").otherwise("low").alias("ca"))
    b = part.where("p_partkey % 4 != 0").select("p_partkey", F.when(c("p_retailprice") > 950, "high").otherwise("low").alias("cb"))
    return consensus.confidence_tally(a.join(b, "p_partkey", "full"), "ca", "cb")


@query("""WITH l AS (SELECT p_partkey, p_brand, CASE p_size % 3 WHEN 0 THEN 100 WHEN 1 THEN 90 ELSE 30 END AS lv FROM part), a AS (SELECT p_brand, arg_min(p_type, p_partkey) AS v FROM part WHERE p_brand < 'Brand#2' GROUP BY 1), b AS (SELECT p_brand, arg_max(p_type, p_partkey) AS v FROM part WHERE p_brand < 'Brand#4' GROUP BY 1), x AS (SELECT p_brand, 'any' AS v FROM part GROUP BY 1)
    SELECT p_partkey, coalesce(CASE WHEN lv >= 100 THEN a.v END, CASE WHEN lv >= 90 THEN b.v END, x.v) AS product FROM l LEFT JOIN a ON l.p_brand = a.p_brand LEFT JOIN b ON l.p_brand = b.p_brand LEFT JOIN x ON l.p_brand = x.p_brand""")
def d73_tiered_lookup(spark, d):
    part = table(spark, d, "part")
    rows = part.select("p_partkey", "p_brand", F.when(c("p_size") % 3 == 0, 100).when(c("p_size") % 3 == 1, 90).otherwise(30).alias("lv"))
    a = part.where("p_brand < 'Brand#2'").groupBy("p_brand").agg(F.min_by("p_type", "p_partkey").alias("v"))
    b = part.where("p_brand < 'Brand#4'").groupBy("p_brand").agg(F.max_by("p_type", "p_partkey").alias("v"))
    return joins.tiered_lookup(rows, "p_brand", "lv", [(100, a), (90, b), (30, part.select("p_brand").distinct().withColumn("v", F.lit("any")))], "v", "product").select("p_partkey", "product")

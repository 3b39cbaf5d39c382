"""Queries of detection measures, features and annotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.operators import coverage

from .registry import query, table

c = F.col
N = lambda: F.count(F.lit(1))


def _lines(spark, d):
    return table(spark, d, "lineitem").join(table(spark, d, "part"), c("l_partkey") == c("p_partkey"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity / 60, 6) AS breadth, round(1 - exp(-0.833 * l_linenumber), 6) AS expected, round(l_quantity / 60 / (1 - exp(-0.833 * l_linenumber)), 6) AS breadth_ratio, round(l_tax / nullif(l_discount, 0), 6) AS dispersion FROM lineitem""")
def d15_coverage_metrics(spark, d):
    rows = table(spark, d, "lineitem").withColumn("size", F.lit(60))
    out = coverage.coverage_metrics(rows, "l_quantity", "size", "l_linenumber", "l_tax", "l_discount")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", *(F.round(x, 6).alias(x) for x in ("breadth", "expected", "breadth_ratio", "dispersion")))


@query("""SELECT l_orderkey, p_brand, l_partkey, l_discount FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_discount > 0 AND p_size % 2 = 0 QUALIFY row_number() OVER (PARTITION BY l_orderkey, p_brand ORDER BY l_discount DESC, l_partkey) = 1""")
def d16_detect_species(spark, d):
    reps = table(spark, d, "part").where("p_size % 2 = 0").select(c("p_partkey").alias("l_partkey"))
    return coverage.detect_species(_lines(spark, d), "l_orderkey", "l_partkey", "p_brand", "l_discount", reps).select("l_orderkey", "p_brand", "l_partkey", "l_discount")


@query("""WITH x AS (SELECT l_suppkey, l_partkey, coalesce(max(CASE WHEN l_linestatus = 'O' THEN l_discount END), 0) AS value_a, coalesce(max(CASE WHEN l_linestatus = 'F' THEN l_discount END), 0) AS value_b FROM lineitem GROUP BY 1, 2)
    SELECT *, CASE WHEN value_a > 0.04 AND value_b > 0.04 THEN 'TP' WHEN value_a > 0.04 THEN 'FN' WHEN value_b > 0.04 THEN 'FP' ELSE 'TN' END AS label FROM x""")
def d17_paired_condition(spark, d):
    return coverage.paired_condition(table(spark, d, "lineitem"), ["l_suppkey", "l_partkey"], "l_linestatus", "O", "F", "l_discount", 0.04)


#: Patterns of the groups over name, type and brand; the first three are hallmarks.
_GENE_GROUPS = {"metal": "ring|rod", "plate": "plate|anvil", "machine": "gear|widget", "small": "small|economy", "large": "large|medium", "promo": "promo|standard", "warm": "hot|red", "first_brands": "brand#[1-5]$"}
_HALLMARKS = ["metal", "plate", "machine"]
_GENE_FLAGS = ", ".join(f"CAST(regexp_matches(p_name || ' | ' || p_type || ' | ' || p_brand, '(?i){p}') AS INT) AS f_{g}" for g, p in _GENE_GROUPS.items())


@query(f"""WITH f AS (SELECT l_suppkey, {_GENE_FLAGS} FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT l_suppkey, count(*) AS genes, {", ".join(f"round(avg(f_{g}), 6) AS prop_{g}" for g in _GENE_GROUPS)}, {", ".join(f"max(f_{h}) AS has_{h}" for h in _HALLMARKS)}, {" + ".join(f"max(f_{h})" for h in _HALLMARKS)} AS hallmarks FROM f GROUP BY 1""")
def d18_gene_groups(spark, d):
    # flags are made once a part, before its lines repeat it
    parts = coverage.group_flags(table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_brand"), ["p_name", "p_type", "p_brand"], _GENE_GROUPS).drop("p_name", "p_type", "p_brand")
    flagged = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").join(parts, c("l_partkey") == c("p_partkey"))
    out = coverage.group_proportions(flagged, ["l_suppkey"], list(_GENE_GROUPS), _HALLMARKS)
    return out.withColumns({x: F.round(x, 6) for x in (f"prop_{g}" for g in _GENE_GROUPS)})


@query("""SELECT l_suppkey, count(*) AS genes, round(avg(b), 6) AS mean_breadth, round(stddev_samp(b), 6) AS sd_breadth, round(avg(CAST(b >= 0.5 AS INT)), 6) AS share_50, round(avg(CAST(b >= 0.8 AS INT)), 6) AS share_80, count(*) FILTER (b > 0) AS occupied,
    round(stddev_samp(b) / avg(b), 6) AS cv_breadth FROM (SELECT l_suppkey, l_quantity / 50 AS b FROM lineitem) GROUP BY 1""")
def d19_breadth_stats(spark, d):
    out = coverage.breadth_stats(table(spark, d, "lineitem").withColumn("b", c("l_quantity") / 50), ["l_suppkey"], "b")
    return out.withColumns({x: F.round(x, 6) for x in ("mean_breadth", "sd_breadth", "share_50", "share_80", "cv_breadth")})


@query("""SELECT p_partkey, try_cast(CASE WHEN p_size % 4 = 0 THEN 'NA' ELSE CAST(p_size AS VARCHAR) END AS DOUBLE) AS size_text, round(1000.0 * p_size / p_retailprice, 6) AS p_size_per_kb, CASE p_type WHEN 'SMALL' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LARGE' THEN 2 END AS p_type_level, round(ln(1 + p_retailprice), 6) AS log_p_retailprice,
    CAST(p_name LIKE 'small%' AS INT) AS little FROM part""")
def d20_features(spark, d):
    rows = table(spark, d, "part").withColumn("size_text", F.when(c("p_size") % 4 == 0, "NA").otherwise(c("p_size").cast("string")))
    out = coverage.features(rows, ["size_text"], {"p_size": "p_retailprice"}, {"p_type": ["SMALL", "MEDIUM", "LARGE"]}, ["p_retailprice"], {"little": c("p_name").startswith("small")})
    return out.select("p_partkey", "size_text", F.round("p_size_per_kb", 6).alias("p_size_per_kb"), "p_type_level", F.round("log_p_retailprice", 6).alias("log_p_retailprice"), "little")


@query("""SELECT s_suppkey, q.qty, n.n_name, p.parts FROM supplier LEFT JOIN (SELECT l_suppkey, CAST(sum(l_quantity) AS BIGINT) AS qty FROM lineitem GROUP BY 1) q ON q.l_suppkey = s_suppkey LEFT JOIN nation n ON n_nationkey = s_nationkey LEFT JOIN (SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem WHERE l_quantity = 50 GROUP BY 1) p ON p.l_suppkey = s_suppkey""")
def d21_assemble_features(spark, d):
    rows = table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "s_suppkey")
    parts = [rows.groupBy("s_suppkey").agg(F.sum("l_quantity").cast("long").alias("qty")), table(spark, d, "nation").select(c("n_nationkey").alias("s_nationkey"), "n_name"), rows.where("l_quantity = 50").groupBy("s_suppkey").agg(F.countDistinct("l_partkey").alias("parts"))]
    out, missing = coverage.assemble(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), parts, ["s_suppkey", "s_nationkey"], ["qty", "parts"])
    assert not missing, missing
    return out.select("s_suppkey", "qty", "n_name", "parts")


@query("""SELECT p.p_partkey, a.suppliers, b.returns, x.best FROM part p JOIN (SELECT l_partkey, count(DISTINCT l_suppkey) AS suppliers FROM lineitem WHERE l_quantity > 40 GROUP BY 1) a ON p.p_partkey = a.l_partkey LEFT JOIN (SELECT l_partkey, count(*) AS returns FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 47 GROUP BY 1) b ON p.p_partkey = b.l_partkey
    LEFT JOIN (SELECT l_partkey, min(l_orderkey) AS best FROM lineitem WHERE l_discount = 0.1 GROUP BY 1) x ON p.p_partkey = x.l_partkey WHERE p_size < 25""")
def d22_annotation_table(spark, d):
    rows = table(spark, d, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    required = rows.where("l_quantity > 40").groupBy("p_partkey").agg(F.countDistinct("l_suppkey").alias("suppliers"))
    optional = [rows.where("l_returnflag = 'R' AND l_quantity > 47").groupBy("p_partkey").agg(N().alias("returns")), rows.where("l_discount = 0.1").select("p_partkey", c("l_orderkey").alias("best"))]
    return coverage.annotation_table(table(spark, d, "part").where("p_size < 25").select("p_partkey"), "p_partkey", required, optional)


@query("""SELECT l_orderkey, count(*) AS n, count(p) AS annotated, count(*) FILTER (p ILIKE '%ring%') AS n_ring, count(*) FILTER (p ILIKE '%small%') AS n_small, CAST(count(*) FILTER (p ILIKE '%bolt%') = 1 AS INT) AS one_bolt FROM (SELECT l_orderkey, CASE WHEN p_size > 5 THEN p_name END AS p FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1""")
def d23_protein_aggregates(spark, d):
    rows = _lines(spark, d).withColumn("p", F.when(c("p_size") > 5, c("p_name")))
    return coverage.protein_aggregates(rows, "l_orderkey", "p", {"ring": "ring", "small": "small"}, {"bolt": "bolt"})


@query("""WITH l AS (SELECT CASE WHEN p_type LIKE 'E%' AND p_size >= 40 THEN 'high' WHEN p_size >= 25 THEN 'mid' ELSE 'low' END AS level FROM part), n AS (SELECT level, count(*) AS n, CASE level WHEN 'high' THEN 0 WHEN 'mid' THEN 1 ELSE 2 END AS pos FROM l GROUP BY 1)
    SELECT level, n, pos, CAST(sum(n) OVER (ORDER BY pos) AS BIGINT) AS cumulative FROM n""")
def d24_hit_levels(spark, d):
    level = F.when(c("p_type").startswith("E") & (c("p_size") >= 40), "high").when(c("p_size") >= 25, "mid").otherwise("low")
    return coverage.hit_levels(table(spark, d, "part"), level, ["high", "mid", "low"])


@query("""WITH o AS (SELECT DISTINCT l_suppkey, p_brand FROM (SELECT l_suppkey, p_brand, l_returnflag, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3) WHERE n = 1), h AS (SELECT l_suppkey, count(*) AS hallmarks FROM o GROUP BY 1) SELECT hallmarks, count(*) AS entities FROM h GROUP BY 1""")
def d25_single_copy(spark, d):
    return coverage.single_copy(_lines(spark, d), "l_suppkey", "p_brand", "l_returnflag").groupBy("hallmarks").agg(N().alias("entities"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_discount > 0.07 AS INT) + CAST(l_tax > 0.06 AS INT) + CAST(l_returnflag = 'R' AS INT) AS signals FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, signals, CASE WHEN signals > 0 THEN 'temperate' ELSE 'virulent' END AS lifestyle FROM s""")
def d26_lifestyle(spark, d):
    rows = table(spark, d, "lineitem").withColumns({"a": c("l_discount") > 0.07, "b": c("l_tax") > 0.06, "r": c("l_returnflag") == "R"})
    return coverage.lifestyle(rows, ["a", "b", "r"]).select("l_orderkey", "l_linenumber", "l_partkey", "signals", "lifestyle")


@query("""SELECT CAST(cutoff AS DOUBLE) AS cutoff, count(*) AS n, round(avg(CAST((l_quantity >= cutoff) = (l_returnflag = 'R') AS INT)), 6) AS agreement FROM lineitem, (SELECT unnest([5, 20, 35, 50]) AS cutoff) GROUP BY 1""")
def d26_threshold_curve(spark, d):
    out = coverage.threshold_curve(table(spark, d, "lineitem"), "l_quantity", c("l_returnflag") == "R", [5, 20, 35, 50])
    return out.withColumn("agreement", F.round("agreement", 6))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount > 0.08 THEN 3 WHEN l_discount > 0.04 THEN 1 ELSE 0 END AS points_price, CASE WHEN l_quantity > 40 THEN 2 ELSE 0 END AS points_size FROM lineitem) SELECT *, points_price + points_size AS points FROM p""")
def d76_evidence_points(spark, d):
    families = {"price": [(c("l_discount") > 0.04, 1), (c("l_discount") > 0.08, 3)], "size": [(c("l_quantity") > 40, 2)]}
    return coverage.evidence_points(table(spark, d, "lineitem"), families).select("l_orderkey", "l_linenumber", "l_partkey", "points_price", "points_size", "points")


def _sequences(spark, d):
    """Letters of documents as sequences over ACGT; every third one begins and ends alike."""
    s = F.translate(F.regexp_replace(F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "[^A-Z]", ""), "BDEFHIJKLMNOPQRSUVWXYZ", "ACGTACGTACGTACGTACGTAC")
    return table(spark, d, "documents").select("doc_id", s.alias("s")).select("doc_id", F.when(c("doc_id") % 3 == 0, F.concat("s", F.substring("s", 1, 40))).when(c("doc_id") % 3 == 1, F.concat("s", F.reverse(F.translate(F.substring("s", 1, 30), "ACGT", "TGCA")))).otherwise(c("s")).alias("s"))


@query()
def d69_terminal_repeats(spark, d):
    return coverage.terminal_repeats(_sequences(spark, d), "doc_id", "s").select("doc_id", "kind", F.length("repeat").alias("repeat_length"), F.round("top_base_pct", 6).alias("top_base_pct"), F.length("trimmed").alias("trimmed_length"))


@query("""WITH r AS (SELECT doc_id, translate(regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^A-Z]', '', 'g'), 'BDEFHIJKLMNOPQRSUVWXYZ', 'ACGTACGTACGTACGTACGTAC') AS s FROM documents),
    q AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN s || s[:40] WHEN doc_id % 3 = 1 THEN s || reverse(translate(s[:30], 'ACGT', 'TGCA')) ELSE s END AS s FROM r),
    p AS (SELECT doc_id, s, least(100, length(s)) AS n, ('0x' || md5(concat_ws(':', doc_id, '1'))[:8])::BIGINT % (length(s) - least(100, length(s)) + 1) AS start FROM q WHERE length(s) > 0) SELECT doc_id, start, substr(s, start + 1, n) AS part FROM p""")
def sp7_subsequences(spark, d):
    return coverage.subsequences(_sequences(spark, d), "doc_id", "s", F.lit(100))

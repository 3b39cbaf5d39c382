"""Queries of scalar functions, projections and filters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from cohortloom.functions import expr as X
from cohortloom.operators import shape

from .registry import query, table

_PART_ID = "concat('src_', lower(p_type), '_', cast(p_partkey as varchar), '.', cast(p_size as varchar))"


def _ids(spark, d):
    return table(spark, d, "part").withColumn("id", F.concat(F.lit("src_"), F.lower("p_type"), F.lit("_"), F.col("p_partkey").cast("string"), F.lit("."), F.col("p_size").cast("string")))


@query(f"""SELECT p_partkey, nullif(regexp_extract(id, '_([a-z]+)_', 1), '') AS kind, nullif(regexp_extract(id, 'zz(\\d+)', 1), '') AS missing,
    regexp_replace(id, '_', '-') AS one, regexp_replace(id, '_', '-', 'g') AS every FROM (SELECT p_partkey, {_PART_ID} AS id FROM part)""")
def f1_f2_extract_replace(spark, d):
    return _ids(spark, d).select("p_partkey", X.extract_group("id", "_([a-z]+)_").alias("kind"), X.extract_group("id", r"zz(\d+)").alias("missing"), X.replace_first("id", "_", "-").alias("one"), X.replace_all("id", "_", "-").alias("every"))


@query(f"""SELECT p_partkey, split_part(id, '_', 2) AS second, nullif(split_part(id, '_', 9), '') AS past, list_extract(string_split(id, '_'), -1) AS last_part,
    split_part(p_name, ' ', 1) AS head, nullif(array_to_string(list_slice(string_split(p_name, ' '), 2, 99), ' '), '') AS tail,
    regexp_replace(id, '_[^_]*$', '') AS grp, regexp_replace(regexp_replace(id, '\\.\\d+$', ''), '^src_', '') AS bare
    FROM (SELECT p_partkey, p_name, {_PART_ID} AS id FROM part)""")
def f3_f4_f11_f15_fields(spark, d):
    two = X.split_fields("p_name", " ", ["head", "tail"])
    return _ids(spark, d).withColumn("s", two).select("p_partkey", X.nth_field("id", "_", 1).alias("second"), X.nth_field("id", "_", 8).alias("past"), X.last_field("id", "_").alias("last_part"), F.col("s.head"), F.col("s.tail"), X.drop_last_part("id").alias("grp"), X.normal_id("id", "src_").alias("bare"))


@query("""SELECT p_partkey, array_to_string(list_sort(string_split(p_name, ' ')), '+') AS joined, list_has_any(string_split(p_name, ' '), ['red', 'small']) AS any_in,
    list_contains(string_split(p_name, ' '), 'ring') AS has_ring, upper(p_type) AS up, lower(p_brand) AS low, trim('  ' || p_name || ' ') AS trimmed,
    substring(p_name, 2, 3) AS middle, p_type || '/' || p_brand AS both, p_type || ' (n=' || p_size || ')' AS shown FROM part""")
def f5_f10_lists_and_text(spark, d):
    words = F.split("p_name", " ")
    return table(spark, d, "part").select(
        "p_partkey", F.array_join(F.array_sort(words), "+").alias("joined"), X.any_in(words, ["red", "small"]).alias("any_in"), F.array_contains(words, "ring").alias("has_ring"), F.upper("p_type").alias("up"),
        F.lower("p_brand").alias("low"), F.trim(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("trimmed"), F.substring("p_name", 2, 3).alias("middle"), F.concat("p_type", F.lit("/"), "p_brand").alias("both"), F.format_string("%s (n=%d)", "p_type", "p_size").alias("shown"),
    )


@query("""SELECT s_suppkey, 'r__' || r_name || ';n__' || CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE n_name END || ';s__' || s_name || '_A' AS lineage, r_name AS region,
    CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_name END AS nation, s_name AS supplier, 'n__' || CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE n_name END AS at_two
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def f12_f14_lineage(spark, d):
    j = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    line = F.concat(F.lit("r__"), "r_name", F.lit(";n__"), F.when(F.col("n_nationkey") % 3 == 0, "").otherwise(F.col("n_name")), F.lit(";s__"), "s_name", F.lit("_A"))
    return j.withColumn("lineage", line).select("s_suppkey", "lineage", X.rank_token("lineage", "r__").alias("region"), X.rank_token("lineage", "n__").alias("nation"), X.strip_suffix(X.rank_token("lineage", "s__")).alias("supplier"), X.nth_field("lineage", ";", 1).alias("at_two"))


@query("""SELECT l_orderkey, l_linenumber, l_quantity / nullif(l_linenumber - 1, 0) AS fraction, 2 * CAST(l_linenumber AS DOUBLE) AS width, CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE -1 END AS level
    FROM lineitem""")
def f16_f18_ratios_and_levels(spark, d):
    rows = table(spark, d, "lineitem")
    frac = F.concat(F.col("l_quantity").cast("string"), F.lit("/"), (F.col("l_linenumber") - 1).cast("string"))
    rng = F.concat(F.lit("10-"), (10 + 2 * F.col("l_linenumber")).cast("string"))
    return rows.select("l_orderkey", "l_linenumber", X.fraction(frac).alias("fraction"), X.range_width(rng).alias("width"), X.ordinal("l_returnflag", ["N", "A"], -1).alias("level"))


@query("""SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, 0.0) AS filled, greatest(c_acctbal, 5000.0) AS high, least(c_acctbal, 5000.0) AS low, abs(c_acctbal) AS size,
    round(sqrt(abs(c_acctbal)), 4) AS root, round(ln(1 + abs(c_acctbal)), 6) AS l1p, round(log10(1 + abs(c_acctbal)), 6) AS l10, round(log2(1 + abs(c_acctbal)), 6) AS l2,
    round(exp(-abs(c_acctbal) / 1000), 6) AS e, round(pow(c_acctbal / 1000, 2), 4) AS sq, (CASE WHEN c_acctbal > 0 THEN c_mktsegment END) IS NOT DISTINCT FROM 'BUILDING' AS same FROM customer""")
def f19_f21_f30_numbers(spark, d):
    b = F.col("c_acctbal")
    a = F.abs(b)
    return table(spark, d, "customer").select(
        "c_custkey", F.coalesce(F.when(b > 0, b), F.lit(0.0)).alias("filled"), F.greatest(b, F.lit(5000.0)).alias("high"), F.least(b, F.lit(5000.0)).alias("low"), a.alias("size"), F.round(F.sqrt(a), 4).alias("root"),
        F.round(F.log1p(a), 6).alias("l1p"), F.round(F.log10(1 + a), 6).alias("l10"), F.round(F.log2(1 + a), 6).alias("l2"), F.round(F.exp(-a / 1000), 6).alias("e"), F.round(F.pow(b / 1000, F.lit(2.0)), 4).alias("sq"),
        F.when(b > 0, F.col("c_mktsegment")).eqNullSafe("BUILDING").alias("same"),
    )


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS days, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS checked,
    try_cast(CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_totalprice AS VARCHAR) ELSE 'n/a' END AS DOUBLE) AS price FROM orders""")
def f22_f24_dates_and_casts(spark, d):
    day = F.col("o_orderdate").cast("date")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(day, "yyyy/MM")).otherwise(day.cast("string"))
    price = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice").cast("string")).otherwise("n/a")
    return table(spark, d, "orders").select("o_orderkey", day.alias("day"), F.datediff(day, F.lit("1995-01-01")).cast("long").alias("days"), X.safe_date(text).alias("checked"), X.safe_double(price).alias("price"))


@query("""SELECT p_partkey, CASE WHEN p_size >= 0 AND p_size < 10 THEN 'tiny' WHEN p_size >= 10 AND p_size < 25 THEN 'small' WHEN p_size >= 25 AND p_size < 50 THEN 'big' END AS bin,
    CASE WHEN p_retailprice < 905 THEN 'low' WHEN p_retailprice < 950 THEN 'mid' ELSE 'high' END AS step,
    CASE WHEN p_name ILIKE '%ring%' THEN 'jewel' WHEN regexp_matches(p_name, '(?i)\\b(small|tiny)\\b') THEN 'little' ELSE 'none' END AS cls FROM part""")
def f25_f27_classes(spark, d):
    return table(spark, d, "part").select("p_partkey", X.binned("p_size", [0, 10, 25, 50], ["tiny", "small", "big"]).alias("bin"), X.stepped("p_retailprice", [(905, "low"), (950, "mid")], "high").alias("step"), X.keyword_class("p_name", [("ring", "jewel"), (r"\b(small|tiny)\b", "little")], "none").alias("cls"))


@query("""WITH s AS (SELECT item_id, regexp_replace(upper(text), '[^ACGTN]', '', 'g') AS s FROM benchmark)
    SELECT item_id, reverse(translate(s, 'ACGT', 'TGCA')) AS rc, length(s) - length(replace(s, 'N', '')) AS n_n,
    CAST(4 * length(s) - length(replace(s, 'A', '')) - length(replace(s, 'C', '')) - length(replace(s, 'G', '')) - length(replace(s, 'T', '')) AS BIGINT) AS acgt,
    round(100.0 * greatest(length(s) - length(replace(s, 'A', '')), length(s) - length(replace(s, 'C', '')), length(s) - length(replace(s, 'G', '')), length(s) - length(replace(s, 'T', ''))) / nullif(length(s), 0), 6) AS top_pct FROM s""")
def f28_f29_sequences(spark, d):
    s = table(spark, d, "benchmark").withColumn("s", F.regexp_replace(F.upper("text"), "[^ACGTN]", ""))
    each = [X.count_letter("s", x) for x in "ACGT"]
    return s.select("item_id", X.reverse_complement("s").alias("rc"), X.count_letter("s", "N").cast("long").alias("n_n"), (each[0] + each[1] + each[2] + each[3]).cast("long").alias("acgt"), F.round(X.ratio(100.0 * F.greatest(*each), F.length("s")), 6).alias("top_pct"))


@query("""SELECT p_partkey AS entity, p_brand AS genus, p_size * 2 AS size, NULL::VARCHAR AS note, CAST(p_size AS DOUBLE) / 10 AS scaled FROM part""")
def p1_p5_fixed_schema(spark, d):
    rows = table(spark, d, "part").withColumnsRenamed({"p_partkey": "entity", "p_brand": "genus"}).withColumns({"size": F.col("p_size") * 2, "scaled": F.col("p_size").cast("double") / 10})
    return shape.to_schema(shape.drop_present(rows, ["p_type", "absent"]), "entity long, genus string, size int, note string, scaled double")


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' AND o_totalprice > 100000 THEN 'urgent' WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'soon' WHEN NOT (o_orderstatus = 'F') THEN 'open' ELSE 'done' END AS tier
    FROM orders WHERE (o_totalprice BETWEEN 20000 AND 150000 OR o_orderstatus IN ('P')) AND o_custkey IS NOT NULL AND o_orderpriority <> '4-NOT SPECIFIED'""")
def p6_p13_predicates(spark, d):
    c = F.col
    rows = table(spark, d, "orders").where((c("o_totalprice").between(20000, 150000) | c("o_orderstatus").isin("P")) & c("o_custkey").isNotNull() & (c("o_orderpriority") != "4-NOT SPECIFIED"))
    first = c("o_orderpriority").startswith("1")
    tier = F.when(first & (c("o_totalprice") > 100000), "urgent").when(first | c("o_orderpriority").like("2%"), "soon").when(~(c("o_orderstatus") == "F"), "open").otherwise("done")
    return rows.select("o_orderkey", tier.alias("tier"))


@query("""SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND c_mktsegment ILIKE '%b%'""")
def p8_p10_membership(spark, d):
    o = table(spark, d, "orders")
    keep = table(spark, d, "customer").where(F.col("c_mktsegment").rlike("(?i)b"))
    big, open_ = o.where("o_totalprice > 150000").select(F.col("o_custkey").alias("c_custkey")), o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return keep.join(big, "c_custkey", "left_semi").join(open_, "c_custkey", "left_anti").select("c_custkey")


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS unit FROM lineitem WHERE l_linenumber = (l_suppkey % 7) + 1 AND l_discount > 0 AND isfinite(l_quantity)""")
def p14_p16_row_filters(spark, d):
    rows = table(spark, d, "lineitem").where((F.col("l_linenumber") == F.col("l_suppkey") % 7 + 1) & (F.col("l_discount") > 0) & ~F.isnan("l_quantity"))
    return rows.withColumn("unit", X.ratio("l_extendedprice", "l_quantity")).dropna(subset=["unit"]).select("l_orderkey", "l_linenumber", "unit")


@query("""SELECT l_orderkey, l_linenumber, CAST(coalesce(l_discount > 0.05, false) AS INT) + CAST(coalesce(l_tax > 0.04, false) AS INT) + CAST(CASE WHEN l_quantity > 10 THEN l_returnflag = 'R' ELSE false END AS INT) AS signals FROM lineitem""")
def p17_signal_count(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.true_count(F.col("l_discount") > 0.05, F.col("l_tax") > 0.04, F.when(F.col("l_quantity") > 10, F.col("l_returnflag") == "R")).alias("signals"))


@query("""SELECT p_partkey, CAST(list_sum(list_transform(string_split(CAST(p_partkey AS VARCHAR), ''), lambda x: CAST(x AS BIGINT))) AS BIGINT) AS digits, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS kind, round(p_retailprice / p_size, 6) AS per_size FROM part""")
def ud1_ud2_row_functions(spark, d):
    """Row functions with declared types over Arrow batches: one value in and out, and structs in and out."""

    @F.pandas_udf("long")
    def digits(numbers: pd.Series) -> pd.Series:
        return numbers.map(lambda n: sum(map(int, str(n))))

    @F.pandas_udf("kind string, per_size double")
    def measured(sizes: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"kind": (sizes["p_size"] > 25).map({True: "big", False: "small"}), "per_size": (sizes["p_retailprice"] / sizes["p_size"]).round(6)})

    out = table(spark, d, "part").select("p_partkey", digits("p_partkey").alias("digits"), measured(F.struct("p_size", "p_retailprice")).alias("m"))
    return out.select("p_partkey", "digits", "m.kind", "m.per_size")


@query("""SELECT p_partkey // 100 AS shelf, count(*) AS n, max(p_size) - min(p_size) AS spread FROM part GROUP BY 1""")
def ud3_group_function(spark, d):
    """A Python function on each of many bounded groups."""

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shelf": pdf["shelf"][:1], "n": [len(pdf)], "spread": [int(pdf["p_size"].max() - pdf["p_size"].min())]})

    rows = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 100).alias("shelf"), "p_size")
    return rows.groupBy("shelf").applyInPandas(spread, "shelf long, n long, spread int")

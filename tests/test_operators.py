"""Micro-fixtures: values by hand or in closed form, and null, tie and empty cases."""

import math

import pytest
from pyspark.sql import functions as F

from cohortloom.functions import expr as X
from cohortloom.functions import tests as T
from cohortloom.operators import consensus, coverage, curves, hierarchy, intervals, joins, ml, pick, shape, stats


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()] if order else [tuple(r) for r in df.collect()]


def test_alignment_summary(spark):
    lines = [  # line, query, target, pid, len, qstart, qend, tstart, tend, evalue
        (1, "q", "t", 90.0, 40.0, 1, 40, 1, 40, 1e-9),
        (2, "q", "t", 99.0, 10.0, 41, 50, 41, 50, 1.0),  # fails the e-value
        (3, "q", "t", 80.0, 20.0, 31, 50, 61, 80, 1e-9),
        (4, "q", "t", 70.0, 90.0, 11, 100, 1, 90, 1e-9),  # 40 + 20 + 90 would pass 110 %
        (5, "q", "t", 70.0, 5.0, 96, 100, 96, 100, 1e-9),  # after the stop
        (6, "q", "u", 50.0, 10.0, 1, 10, 20, 11, 1e-9),
        (7, "q", "t", 60.0, 10.0, 1, 10, 1, 10, 1e-9),  # the same pair again, not adjacent: its own run
        (8, "q", "v", 60.0, 200.0, 1, 200, 1, 10, 1e-9),  # the first line stops: no row
    ]
    df = spark.createDataFrame([(*x, 100, 100) for x in lines], "line long, qname string, tname string, pid double, len double, qstart long, qend long, tstart long, tend long, evalue double, qlen long, tlen long")
    got = rows(intervals.alignment_summary(df).drop("block"), "tname", "num_alns")
    assert got == [("q", "t", 1, 60.0, 10.0, 10.0), ("q", "t", 2, 86.67, 50.0, 60.0), ("q", "u", 1, 50.0, 10.0, 10.0)]


def test_islands(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 11, 20), ("a", 25, 30), ("b", 5, 9), ("b", 6, 7)], "k string, start long, stop long")
    assert rows(intervals.covered(df, ["k"]), "k") == [("a", 26, 2), ("b", 5, 1)]
    assert rows(intervals.covered(df.limit(0), ["k"])) == []


def test_interval_pairs_cross_bins_once(spark):
    a = spark.createDataFrame([("x", "a1", 0, 100), ("x", "a2", 95, 95)], "k string, a string, start long, stop long")
    b = spark.createDataFrame([("x", "b1", 100, 300), ("x", "b2", 40, 60), ("y", "b3", 0, 9)], "k string, b string, start2 long, stop2 long")
    got = rows(joins.interval_pairs(a, b, ["k"], 10).select("a", "b", "overlap"), "a", "b")
    assert got == [("a1", "b1", 1), ("a1", "b2", 21)]
    tied = spark.createDataFrame([("x", "b1", 10, 20), ("x", "b0", 30, 40)], "k string, b string, start2 long, stop2 long")
    assert rows(joins.best_interval(a.where("a = 'a1'"), tied, ["k"], "a", "b", 16).select("a", "b")) == [("a1", "b1")]


def test_reciprocal_best(spark):
    grid = [("a", "x", 9, 9), ("a", "y", 8, 1), ("b", "x", 7, 5), ("b", "y", 6, 6), ("c", "y", 1, 9), ("c", "z", 2, 2)]
    df = spark.createDataFrame([("s", *g) for g in grid], "s string, a string, b string, f int, g int")
    assert rows(intervals.reciprocal_best(df, ["s"], "a", "b", "f", "g").select("a", "b"), "a") == [("a", "x"), ("c", "z")]


def test_merge_methods(spark):
    cols = "k int, label string, votes int, agreement double"
    a = spark.createDataFrame([(1, "p", 3, 0.9), (2, "p", 3, 0.9), (3, "p", 2, 0.6), (4, "p", 3, 0.8)], cols)
    b = spark.createDataFrame([(1, "p", 2, 0.8), (2, "q", 3, 1.0), (3, "q", 1, 0.7), (5, "r", 4, 1.0)], cols)
    assert rows(consensus.merge_methods(a, b, ["k"], ("A", "B")), "k") == [(1, "p", 5, 0.8, "both"), (2, "p", 3, 0.9, "A"), (3, "q", 1, 0.7, "B"), (4, "p", 3, 0.8, "A"), (5, "r", 4, 1.0, "B")]


def test_consensus_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, None)], "e int, label string")
    assert rows(consensus.evidence_consensus(df, "e", ["label"]), "e") == [(1, "label", "a", 1, 2, 0.5)]
    assert rows(consensus.evidence_consensus(df, "e", ["label"], all_hits=True), "e") == [(1, "label", "a", 1, 3, 1 / 3)]


def test_fisher():
    greater, two = T.fisher(8, 2, 1, 5)
    assert greater == pytest.approx((math.comb(10, 8) * math.comb(6, 1) + math.comb(10, 9) * math.comb(6, 0)) / math.comb(16, 9), rel=1e-9)
    assert two == pytest.approx(0.034965, abs=1e-6)
    assert T.fisher(0, 3, 0, 4) == (1.0, 1.0)


def test_tails():
    assert T.gamma_tail(1, 3) == pytest.approx(math.exp(-3))
    assert T.gamma_tail(0.5, 1.92) == pytest.approx(math.erfc(math.sqrt(1.92)), rel=1e-9)
    assert T.beta_share(2, 3, 0.4) == pytest.approx(6 * 0.4**2 * 0.6**2 + 4 * 0.4**3 * 0.6 + 0.4**4, rel=1e-9)
    assert T.normal_tail(1.959964) == pytest.approx(0.05, abs=1e-6)


def test_bh(spark):
    df = spark.createDataFrame([(i, p, 1) for i, p in enumerate((0.01, 0.04, 0.03, 0.005))], "i int, p double, f int")
    assert [round(r["q"], 6) for r in stats.bh_fdr(df, "p", ["f"]).orderBy("i").collect()] == [0.02, 0.04, 0.04, 0.02]


def test_rank_tests(spark):
    df = spark.createDataFrame([("t", g, float(v)) for g, v in (("a", 1), ("a", 2), ("a", 2), ("b", 2), ("b", 5), ("b", 6))], "t string, g string, v double")
    r = stats.mann_whitney(df, ["t"], "g", "v", "a", "b").first()
    assert (r["n_a"], r["n_b"], r["u"]) == (3, 3, 1.0)
    sd = math.sqrt(9 / 12 * (7 - 24 / 30))
    assert r["z"] == pytest.approx((3.5 - 0.5) / sd)
    assert stats.kruskal_wallis(df, ["t"], "g", "v").first()["h"] == pytest.approx((12 / 42 * (7**2 / 3 + 14**2 / 3) - 21) / (1 - 24 / 210))


def test_wilcoxon(spark):
    pairs = [(i, c, v) for i, (x, y) in enumerate(((5, 1), (6, 3), (4, 4), (7, 9))) for c, v in (("a", float(x)), ("b", float(y)))]
    r = stats.wilcoxon(spark.createDataFrame([("t", *p) for p in pairs], "t string, i int, c string, v double"), ["t"], "i", "c", "v", "a", "b").first()
    assert (r["n"], r["w_plus"], r["p_value"]) == (3, 5.0, 0.5)  # ranks 3, 2, 1; P(min <= 1) = 2 * 2 / 8


def test_cluster_agreement(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y"), ("b", "z")], "p string, n string")
    same = stats.cluster_agreement(df, "p", "p").first()
    assert [round(v, 9) for v in same] == [1.0, 1.0, 1.0]
    assert stats.cluster_agreement(df, "p", "n").first()["homogeneity"] == pytest.approx(1.0)
    kinds = {r["kind"]: r["n"] for r in stats.split_merge(df, "p", "n").collect()}
    assert kinds == {"unchanged": 1, "split": 1}


def test_accumulation(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate("abac")], "i int, l string")
    got = curves.accumulation_curve(df, "i", "l", F.lit(True), 20).orderBy("pos").collect()
    assert (got[0]["total"], got[-1]["total"], got[-1]["non_singleton"], got[-1]["flagged"]) == (1.0, 3.0, 1.0, 3.0)
    exact = {r["n"]: r["expected"] for r in curves.expected_curve(df, "l", 4).collect()}
    assert exact[1] == pytest.approx(1.0) and exact[2] == pytest.approx(2 - 1 / 6) and exact[4] == pytest.approx(3.0)


def test_lowess_follows_a_line(spark):
    df = spark.createDataFrame([("g", float(i), 2.0 * i + 1) for i in range(8)] + [("h", 1.0, 1.0)], "g string, x double, y double")
    assert [(r["x0"], round(r["fitted"], 9)) for r in stats.lowess(df, ["g"], "x", "y", [3.0, 99.0]).collect()] == [(3.0, 7.0)]


def test_scalar_rules(spark):
    df = spark.createDataFrame([("d__A;p__;s__x_B", "3/0", "a-b-c", "NA")], "l string, f string, s string, n string")
    r = df.select(X.rank_token("l", "d__").alias("d"), X.rank_token("l", "p__").alias("p"), X.strip_suffix(X.rank_token("l", "s__")).alias("s"), X.fraction("f").alias("f"), X.replace_first("s", "-", "+").alias("one"), X.nth_field("s", "-", 7).alias("far"), X.null_tokens("n").alias("n"), X.safe_date(F.lit("2024-02-31")).alias("day")).first()
    assert tuple(r) == ("A", None, "x", None, "a+b-c", None, None, None)
    ranks = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 3.0), ("a", None)], "g string, v double").select("v", X.average_rank(["g"], "v").alias("r"))
    assert sorted((x for x in rows(ranks) if x[1]), key=lambda x: x[1]) == [(1.0, 1.5), (1.0, 1.5), (3.0, 3.0)]


def test_representative_tiers(spark):
    members = [("one", 1, 10.0, False, 1), ("full", 2, 100.0, True, 1), ("full", 3, 120.0, True, 1), ("full", 4, 90.0, True, 9), ("part", 5, 50.0, False, 4), ("part", 6, 80.0, False, 4), ("part", 7, 60.0, False, 1)]
    df = spark.createDataFrame(members, "cluster string, entity int, len double, complete boolean, genes int")
    assert rows(pick.pick_representative(df, "cluster", "entity", "len", "complete", "genes"), "cluster") == [("full", 3, 1), ("one", 1, 0), ("part", 5, 2)]


def test_terminal_repeats(spark):
    core = "ACGTTGCAAC" * 6
    back = core[:25][::-1].translate(str.maketrans("ACGT", "TGCA"))
    df = spark.createDataFrame([(1, "GATTACAGATTACAGATTACACC" + "TTTTGGGG" * 9 + "GATTACAGATTACAGATTACACC"), (2, core + "TT" * 40 + back), (3, "ACGT"), (4, None)], "id int, s string")
    got = {r["id"]: r for r in coverage.terminal_repeats(df, "id", "s").collect()}
    assert got[1]["kind"] == "direct" and got[1]["repeat"] == "GATTACAGATTACAGATTACACC" and got[1]["trimmed"].endswith("GGGG")
    assert got[2]["kind"] == "inverted" and got[2]["repeat"].startswith(core[:25])
    assert got[3]["kind"] == got[4]["kind"] == "none"


def test_metrics(spark):
    df = spark.createDataFrame([(0.9, True), (0.8, False), (0.8, True), (0.1, False)], "s double, t boolean")
    r = ml.ranking_metrics(df, "s", F.col("t")).first()
    assert r["auroc"] == pytest.approx((2 + 1.5) / 4) and r["average_precision"] == pytest.approx((1 + 2 / 3) / 2)
    best = ml.threshold_for(df, "s", F.col("t"), 0.6).first()
    assert best["threshold"] == 0.8 and best["recall"] == 1.0
    assert ml.threshold_for(df.where("NOT t"), "s", F.col("t"), 0.6).count() == 0


def test_folds_keep_groups_together(spark):
    df = spark.range(200).select("id", (F.col("id") % 17).alias("g"))
    folds = ml.group_folds(df, "g", 5).groupBy("g").agg(F.countDistinct("fold").alias("n")).agg(F.max("n")).first()[0]
    assert folds == 1


def test_shares_sum_to_one(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 0)], "g string, n int")
    got = rows(df.withColumn("s", X.share("n", "g")), "g", "n")
    assert got == [("a", 1, 0.25), ("a", 3, 0.75), ("b", 0, None)]


def test_metadata_falls_back_to_the_trimmed_id(spark):
    source = spark.createDataFrame([("x.1",), ("y",), ("z",)], "id string")
    hashes = spark.createDataFrame([("x", "h1"), ("y", "h2"), ("y", "h3")], "id string, hash string")
    reps = spark.createDataFrame([("h1", "r1", 2), ("h1", "r0", 1)], "hash string, rep string, rep_order int")
    got = hierarchy.build_metadata(source, hashes, X.normal_id("id"), reps, [spark.createDataFrame([("r0", 5), ("r0", 6)], "rep string, size int")])
    assert rows(got.select("id", "hash", "rep", "size"), "id") == [("x.1", "h1", "r0", 5), ("y", "h2", None, None), ("z", None, None, None)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "e int, label string, v double")
    assert consensus.evidence_consensus(none, "e", ["label"]).count() == 0
    assert stats.spearman(none, ["label"], "e", "v").count() == 0
    assert shape.set_overlap(none, "e", "label", ["a"]).count() == 0
    assert pick.majority_label(none, ["e"], "label").count() == 0

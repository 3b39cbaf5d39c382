"""Closed forms, running sums over blocks and readers of outside stores, against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cohortloom.operators import assoc, curves, joins, stats, windows
from cohortloom.sources import tables as S


def test_log_missed_against_factorials(spark):
    from fractions import Fraction

    cases = [(m, n, every) for every in (70, 300, 2000) for n in (1, 3, every // 2, every - 70, every - 1) for m in (1, 5, 63, 64, 65, 66, 100, every - n - 9, every - n - 3, every - n, every - n + 1) if 1 <= m <= every and n >= 1]
    rows = spark.createDataFrame(cases, "m long, n long, every long").withColumn("x", F.exp(curves.log_missed(F.col("m"), F.col("n"), F.col("every"))))
    for r in rows.collect():
        want = float(Fraction(math.comb(r["every"] - r["m"], r["n"]), math.comb(r["every"], r["n"]))) if r["m"] + r["n"] <= r["every"] else 0.0
        assert r["x"] == pytest.approx(want, rel=1e-8, abs=1e-12), tuple(r)


def test_log_missed_of_very_large_groups(spark):
    """A label of 10**9 of 10**10 rows, a subset of 20: nearly (1 - 0.1)**20."""
    row = spark.range(1).select(F.exp(curves.log_missed(F.lit(10**9), F.lit(20), F.lit(10**10))).alias("x")).first()
    assert row["x"] == pytest.approx(0.9**20, rel=1e-6)


def test_blocked_sums(spark):
    rng = random.Random(1)
    rows = [(g, rng.randrange(5), i, rng.randrange(9)) for g in "ab" for i in range(200)]
    got = windows.blocked_sums(spark.createDataFrame(rows, "g string, b int, i int, v int"), ["g"], "b", ["i"], {"s": F.col("v"), "n": F.lit(1)})
    assert set(got.columns) == {"g", "b", "i", "v", "s", "n"}
    for g in "ab":
        total = 0
        for k, r in enumerate(sorted((r for r in got.collect() if r["g"] == g), key=lambda r: (r["b"], r["i"])), 1):
            total += r["v"]
            assert (r["s"], r["n"]) == (total, k)


def test_accumulation_curve_against_a_walk(spark):
    rng = random.Random(2)
    rows = [(i, f"l{rng.randrange(6)}" if rng.random() < 0.9 else None, rng.random() < 0.3) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, label string, f boolean")
    ordered = curves.hash_order(df, "k", 3).collect()
    got = {r["pos"]: r for r in curves.accumulation_curve(df, "k", "label", F.col("f"), 3).collect()}
    sums = {}
    for rep in range(3):
        seen, flagged = {}, set()
        own = sorted((r for r in ordered if r["rep"] == rep), key=lambda r: r["pos"])
        assert [r["pos"] for r in own] == list(range(1, 61))
        for r in own:
            seen[r["label"]] = seen.get(r["label"], 0) + 1
            flagged |= {r["label"]} if r["f"] else set()
            sums.setdefault(r["pos"], []).append((len(seen), sum(n > 1 for n in seen.values()), len(flagged)))
    for pos, values in sums.items():
        r = got[pos]
        assert [r["total"], r["non_singleton"], r["flagged"]] == pytest.approx([sum(v[i] for v in values) / 3 for i in range(3)])
        assert (r["least"], r["most"]) == (min(v[0] for v in values), max(v[0] for v in values))


def test_plans_stay_flat(spark):
    from cohortloom.plans import registry

    joins_of = lambda name: registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins_of("d43_ratio_cascade") <= 4 and joins_of("d46_association_scan") <= 10 and joins_of("j13_match_in_order") <= 2


def test_match_in_order_keeps_the_first_rule(spark):
    left = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "z")], "id int, k string, t string")
    exact, loose = spark.createDataFrame([("a", 10), ("a", 11)], "k string, v int"), spark.createDataFrame([("x", 20)], "t string, v int")
    got = joins.match_in_order(left, [("exact", exact, ["k"]), ("loose", loose, ["t"])], "id")
    assert sorted((r["id"], r["v"], r["matched_by"]) for r in got.collect()) == [(1, 10, "exact"), (1, 11, "exact"), (2, 20, "loose")]


def test_signed_ranks_have_a_stated_limit(spark, monkeypatch):
    monkeypatch.setattr(stats, "EXACT_PAIRS", 5)
    rows = [("t", i, c, float(i if c == "a" else -1)) for i in range(8) for c in "ab"]
    df = spark.createDataFrame(rows, "test string, pair int, cond string, v double")
    with pytest.raises(Exception, match="more than 5 pairs"):
        stats.wilcoxon(df, ["test"], "pair", "cond", "v", "a", "b").collect()


def test_signed_ranks_against_all_signs(spark):
    rng = random.Random(3)
    rows = [(t, i, c, float(rng.randrange(6))) for t in ("x", "y") for i in range(9) for c in "ab"]
    got = {r["test"]: r for r in stats.wilcoxon(spark.createDataFrame(rows, "test string, pair int, cond string, v double"), ["test"], "pair", "cond", "v", "a", "b").collect()}
    for t in got:
        value = {(i, c): v for s, i, c, v in rows if s == t}
        diffs = [value[i, "a"] - value[i, "b"] for i in range(9) if value[i, "a"] != value[i, "b"]]
        size = sorted(map(abs, diffs))
        rank = [sum(k + 1 for k, s in enumerate(size) if s == abs(d)) / size.count(abs(d)) for d in diffs]
        plus, total = sum(r for r, d in zip(rank, diffs, strict=True) if d > 0), sum(rank)
        low = min(plus, total - plus)
        hits = sum(sum(r for k, r in enumerate(rank) if bits >> k & 1) <= low + 1e-9 for bits in range(1 << len(rank)))
        assert got[t]["w_plus"] == plus and got[t]["p_value"] == pytest.approx(min(1.0, 2 * hits / (1 << len(rank))))


def test_random_partners_are_never_the_true_ones(spark):
    pairs = spark.createDataFrame([(i, i % 7) for i in range(40)] + [(99, 500)], "e int, p int")
    pool = spark.createDataFrame([(i,) for i in range(7)], "p int")
    got = assoc.random_partners(pairs, "e", "p", pool, 30).collect()
    assert len(got) == 41 * 30 and all(r["p"] != r["drawn"] for r in got)
    assert {r["drawn"] for r in got if r["e"] == 3} == {0, 1, 2, 4, 5, 6}


def test_database_reader():
    """What it asks of a driver that this machine lacks."""

    class Reader:
        def __init__(self):
            self.options_ = {}

        def format(self, name):
            self.options_["format"] = name
            return self

        def option(self, k, v):
            self.options_[k] = v
            return self

        def options(self, **more):
            self.options_.update(more)
            return self

        def load(self):
            return self.options_

    class Session:
        read = Reader()

    got = S.read_database(Session(), "jdbc:sqlite:x.db", "SELECT id FROM t", "org.sqlite.JDBC", fetchsize="1000")
    assert got == {"format": "jdbc", "url": "jdbc:sqlite:x.db", "query": "SELECT id FROM t", "driver": "org.sqlite.JDBC", "fetchsize": "1000"}

"""Scans over blocks against windows over whole groups."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortloom.operators import intervals, windows


def ordered(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("own", [True, False])
def test_scans_of_each_kind(spark, own):
    rng = random.Random(2)
    rows = [(g, i, rng.choice([None, *range(9)]), rng.randint(-5, 5)) for g in "ab" for i in range(60)]
    df = spark.createDataFrame(rows, "g string, i int, v int, w int").repartition(3)
    got = windows.blocked_scan(df.withColumn("_blk", F.floor(F.col("i") / 7)), ["g"], "_blk", ["i"], {"s": ("sum", F.col("w")), "m": ("max", F.col("v")), "l": ("last", F.col("v"))}, own).drop("_blk")
    over = Window.partitionBy("g").orderBy("i").rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    want = df.withColumns({"s": F.coalesce(F.sum("w").over(over), F.lit(0)), "m": F.max("v").over(over), "l": F.last("v", ignorenulls=True).over(over)})
    assert ordered(got.select(want.columns)) == ordered(want)


def test_islands_in_bins(spark, monkeypatch):
    monkeypatch.setattr(intervals, "BIN", 16)
    rng = random.Random(3)
    rows = []
    for k in ("a", "b", None):
        for _ in range(150):
            start = rng.randint(-200, 900)
            rows.append((k, start, start + rng.choice([0, 1, 3, 40, 120])))
    df = spark.createDataFrame(rows, "k string, start long, stop long")
    got = {r["k"]: (r["covered"], r["islands"]) for r in intervals.covered(df, ["k"], bins=True).collect()}
    for k in ("a", "b", None):
        spots = {x for key, a, b in rows if key == k for x in range(a, b + 1)}
        assert got[k] == (len(spots), sum(x - 1 not in spots for x in spots))
    assert ordered(intervals.covered(df, ["k"])) == ordered(intervals.covered(df, ["k"], bins=True))
    assert intervals.covered(df.limit(0), ["k"], bins=True).count() == 0


def test_alignments_of_one_file(spark, monkeypatch):
    """Runs, stops and coverage over borders of blocks, as those of a window over the whole file."""
    monkeypatch.setattr(intervals, "LINES", 5)
    monkeypatch.setattr(intervals, "BIN", 8)
    rng = random.Random(4)
    rows, q = [], 0
    for line in range(300):
        q += rng.random() < 0.08
        start = rng.randint(1, 80)
        rows.append((0, line, f"q{q % 5}", f"t{q % 3}" if q % 7 else None, 90.0 + line % 10, float(rng.randint(5, 30)), start, start + rng.randint(0, 25), 2 * start, 2 * start + rng.randint(0, 9), rng.choice([1e-9, 1e-9, 1.0]), 100, 120))
    names = "f int, line long, qname string, tname string, pid double, len double, qstart long, qend long, tstart long, tend long, evalue double, qlen long, tlen long"
    df = spark.createDataFrame(rows, names).repartition(4)
    one = intervals.alignment_summary(df)
    assert ordered(one) == ordered(intervals.alignment_summary(df, groups=["f"]).drop("f"))
    assert one.count() > 10
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(line" not in plan  # no window without partition

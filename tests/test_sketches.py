"""Sketches that merge upwards, and association scans by bitmaps, against exact counts."""

import math
import random

from pyspark.sql import functions as F

from cohortloom.operators import assoc, sketches


def test_roll_up_merges_sketches(spark):
    df = spark.range(60_000).select((F.col("id") % 6).alias("genus"), (F.col("id") % 12).alias("species"), (F.col("id") % 20_000).alias("entity"), (F.col("id") * 1.0).alias("x"), F.lit(None).cast("double").alias("none"))
    fine = sketches.sketch(df, ["genus", "species"], ["entity"], ["x", "none"])
    whole = sketches.estimates(sketches.roll_up_levels(fine, [["genus", "species"], ["genus"], []]), {"mid": 0.5, "high": 0.9}).collect()
    assert sorted((r["level"], r["n"]) for r in whole) == [(0, 5000)] * 12 + [(1, 10_000)] * 6 + [(2, 60_000)]
    for r in whole:
        exact = {0: 5000, 1: 10_000, 2: 20_000}[r["level"]]
        assert abs(r["distinct_entity"] - exact) <= 4 * sketches.distinct_error() * exact
        assert abs(r["x_mid"] / 60_000 - 0.5) < 0.05 and abs(r["x_high"] / 60_000 - 0.9) < 0.05 and r["none_mid"] is None
    # the merged sketch of a level is that of its rows, whatever was below it
    direct = {r["genus"]: r["distinct_entity"] for r in sketches.estimates(sketches.sketch(df, ["genus"], ["entity"])).collect()}
    merged = {r["genus"]: r["distinct_entity"] for r in sketches.estimates(sketches.roll_up(fine.drop("kll_x", "kll_none"), ["genus"])).collect()}
    assert all(abs(direct[k] - merged[k]) <= 0.02 * direct[k] for k in direct) and direct.keys() == merged.keys()
    assert sketches.estimates(sketches.sketch(df.limit(0), ["genus"], ["entity"], ["x"])).count() == 0


def test_small_groups_have_exact_quantiles(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(1, 100)] + [("b", 7.0), ("c", None)], "k string, v double")
    got = {r["k"]: (r["n"], r["v_median"]) for r in sketches.estimates(sketches.sketch(df, ["k"], numbers=["v"])).collect()}
    assert got == {"a": (99, 50.0), "b": (1, 7.0), "c": (1, None)}


def average_ranks(v):
    return [sum(y < x for y in v) + (sum(y == x for y in v) + 1) / 2 for x in v]


def test_association_scan_by_bitmaps(spark):
    """More samples than a bitmap has, ties, zero values, a candidate that never meets, one whose partner is nowhere, and keys."""
    rng = random.Random(8)
    a = [(s, e, float(rng.randint(0, 5))) for e in "xyz" for s in range(200) if rng.random() < 0.5]
    b = [(s, p, float(rng.randint(0, 4))) for p in (1, 2) for s in range(100, 300) if rng.random() < 0.6]
    a.append((900, "lone", 1.0))
    candidates = [(k, e, p) for k in (0, 1) for e in ("x", "y", "z", "lone") for p in (1, 2) if (k, e) != (1, "y")] + [(0, "x", 99), (0, "nobody", 1)]
    scan = assoc.association_scan(spark.createDataFrame(a, "s int, e string, value_a double"), spark.createDataFrame(b, "s int, p int, value_b double"), spark.createDataFrame(candidates, "k int, e string, p int"), "s", "e", "p", 1000, keys=["k"])
    got = {(r["k"], r["e"], r["p"]): r for r in scan.collect()}
    assert set(got) == {c for c in candidates if c[1] != "nobody" and c[2] != 99}
    for (_, e, p), r in got.items():
        va, vb = {s: v for s, x, v in a if x == e}, {s: v for s, x, v in b if x == p}
        both = sorted(va.keys() & vb.keys())
        assert (r["n11"], r["n10"], r["n01"], r["n00"]) == (len(both), len(va) - len(both), len(vb) - len(both), 1000 - len(va) - len(vb) + len(both))
        assert math.isclose(r["pct"], 100 * len(both) / len(va), abs_tol=1e-12)
        if not both:
            assert r["ratio_mean"] is r["rho"] is r["ratio_sd"] is None
            continue
        ratios = [va[s] / vb[s] for s in both if vb[s]]
        mean = sum(ratios) / len(ratios)
        assert math.isclose(r["ratio_mean"], mean, rel_tol=1e-12) and r["ratio_max"] == max(ratios)
        assert math.isclose(r["ratio_sd"], math.sqrt(sum((x - mean) ** 2 for x in ratios) / (len(ratios) - 1)), rel_tol=1e-9)
        middle = sorted(ratios)
        assert math.isclose(r["ratio_median"], (middle[(len(middle) - 1) // 2] + middle[len(middle) // 2]) / 2, rel_tol=1e-12)
        x, y = average_ranks([va[s] for s in both]), average_ranks([vb[s] for s in both])
        mx, my = sum(x) / len(x), sum(y) / len(y)
        rho = sum((i - mx) * (j - my) for i, j in zip(x, y, strict=True)) / math.sqrt(sum((i - mx) ** 2 for i in x) * sum((j - my) ** 2 for j in y))
        assert math.isclose(r["rho"], rho, rel_tol=1e-9, abs_tol=1e-12)

"""Ranks and quantiles, with and without blocks, against numpy and plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import order, stats


@pytest.fixture(params=["window", "blocks"])
def way(request, monkeypatch):
    """Blocks are for large tables; here they serve any."""
    if request.param == "blocks":
        monkeypatch.setattr(order, "ONE_TASK", 0)
        monkeypatch.setattr(order, "STEPS", 3)
    return request.param


def rows(seed=4):
    rng = np.random.default_rng(seed)
    out = [("a", float(v)) for v in rng.normal(0, 1, 300)] + [("a", 0.5)] * 40 + [("b", float(v)) for v in rng.integers(0, 4, 90)]
    out += [("c", 7.0), ("d", None), ("d", -1e300), ("d", 1e300), (None, 2.0), (None, 2.0), (None, 3.0)]
    return [out[i] for i in rng.permutation(len(out))]


def by_group(data):
    groups = {}
    for g, v in data:
        if v is not None:
            groups.setdefault(g, []).append(v)
    return groups


def test_quantiles(spark, way):
    data = rows()
    got = order.quantiles(spark.createDataFrame(data, "g string, v double"), ["g"], "v", {"q1": 0.25, "mid": 0.5, "q9": 0.9}).collect()
    groups = by_group(data)
    assert len(got) == len(groups)
    for r in got:
        v = groups[r["g"]]
        assert r["n"] == len(v)
        assert np.allclose([r["q1"], r["mid"], r["q9"]], np.percentile(v, [25, 50, 90]), rtol=1e-12), r
    # the same numbers as the built-in aggregate, to the last bit
    df = spark.createDataFrame([(g, v) for g, v in data if g], "g string, v double")
    want = {r["g"]: r["x"] for r in df.groupBy("g").agg(F.percentile("v", 0.37).alias("x")).collect()}
    assert {r["g"]: r["x"] for r in order.quantiles(df, ["g"], "v", {"x": 0.37}).collect()} == want


def test_average_ranks(spark, way):
    data = [(i, g, v) for i, (g, v) in enumerate(rows(5))]
    got = {r["i"]: r for r in order.with_average_rank(spark.createDataFrame(data, "i long, g string, v double"), ["g"], "v", "r").collect()}
    assert len(got) == len(data)
    for i, g, v in data:
        same = [x for _, h, x in data if h == g and x is not None]
        assert got[i]["r"] == (None if v is None else sum(x < v for x in same) + (sum(x == v for x in same) + 1) / 2)
        assert got[i]["_total"] == len(same)


def test_blocks_part_the_values(spark, monkeypatch):
    """A group with very many distinct values is dealt over many blocks, none of which has much more than its share."""
    monkeypatch.setattr(order, "ONE_TASK", 1000)
    held = []
    whole = order.blocked_sums
    monkeypatch.setattr(order, "blocked_sums", lambda df, *rest: held.append(df) or whole(df, *rest))
    df = spark.range(200_000).select(F.lit("one").alias("g"), (F.pow(F.col("id") + 1.0, F.lit(3.0))).alias("v"))
    got = order.quantiles(df, ["g"], "v", {"mid": 0.5}).first()
    assert got["n"] == 200_000 and got["mid"] == (100_000.0**3 + 100_001.0**3) / 2
    sizes = [r["count"] for r in held[0].groupBy("_block").count().collect()]
    assert len(sizes) > 3000 and max(sizes) < 200_000 / len(sizes) * 8


def test_spearman_and_lowess_in_blocks(spark, way):
    rng = np.random.default_rng(9)
    x = np.round(rng.uniform(0, 50, 400), 0)
    y = x * 2 + rng.normal(0, 9, 400)
    data = [("a", float(a), float(b)) for a, b in zip(x, y, strict=True)] + [("few", 1.0, 2.0), ("few", 2.0, 2.0), ("flat", 5.0, 1.0), ("flat", 5.0, 3.0), ("flat", 5.0, 4.0), ("a", None, 1.0)]
    df = spark.createDataFrame(data, "g string, x double, y double")

    def ranks(v):
        return np.array([(v < t).sum() + ((v == t).sum() + 1) / 2 for t in v])

    got = {r["g"]: r for r in stats.spearman(df, ["g"], "x", "y").collect()}
    assert abs(got["a"]["rho"] - np.corrcoef(ranks(x), ranks(y))[0, 1]) < 1e-12
    assert got["few"]["rho"] is None and got["flat"]["rho"] is None and got["a"]["n"] == 400

    fitted = {(r["g"], r["x0"]): r["fitted"] for r in stats.lowess(df, ["g"], "x", "y", [-1.0, 5.0, 25.0]).collect()}
    assert set(fitted) == {("a", 5.0), ("a", 25.0), ("flat", 5.0)}
    assert abs(fitted["flat", 5.0] - 8 / 3) < 1e-9  # all points in one place: their mean
    for x0 in (5.0, 25.0):
        far = np.abs(x - x0)
        h = np.sort(far)[int(np.ceil(2 / 3 * 400)) - 1]
        w = np.clip(1 - (far / h) ** 3, 0, None) ** 3
        slope, cut = np.polyfit(x - x0, y, 1, w=np.sqrt(w))
        assert abs(fitted["a", x0] - cut) < 1e-6

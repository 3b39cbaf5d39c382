"""What went wrong on larger tables or odd partitions: small cases of it."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.functions import tests
from cohortloom.functions.store import kept
from cohortloom.operators import assoc, curves, intervals, order, stats, windows
from cohortloom.plans import registry
from cohortloom.sources.sqlite import read_sqlite, write_sqlite

from .test_queries import ordered, plain


def against_sql(spark, name, folder, **tables):
    """The query's rows on tables of one's own, and its SQL's."""
    import duckdb

    con = duckdb.connect()
    for t, df in tables.items():
        df.write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    df = registry.QUERIES[name](spark, str(folder))
    result = con.execute(registry.ORACLES[name])
    names = sorted(x[0] for x in result.description)
    at = [[x[0] for x in result.description].index(n) for n in names]
    assert sorted(df.columns) == names
    return ordered(tuple(plain(r[n]) for n in names) for r in df.collect()), ordered(tuple(plain(r[i]) for i in at) for r in result.fetchall())


PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


def test_top_part_by_price_and_key(spark, tmp_path):
    """A key of 120,000 outweighs a price that is higher by less than 1.2; names that are null are no candidates."""
    rows = [(5, "dear", "a", "t", 1, 901.0), (120_000, "far", "a", "t", 1, 900.0), (1, None, "b", "t", 1, 999.0), (2, "named", "b", "u", 1, 1.0), (3, "priceless", "c", "t", 1, None)]
    got, want = against_sql(spark, "a7_a8_a17_first_and_top", tmp_path, part=spark.createDataFrame(rows, PART))
    assert got == want and "far" in got[0]


def test_types_of_a_query_come_from_files_with_rows(spark, tmp_path):
    """The first file by name is empty; a column without a declared type is known from another one."""
    path = str(tmp_path / "files")
    for name, rows in (("a", []), ("b", [(1, 2.5), (1, 4.0)])):
        write_sqlite(spark.createDataFrame(rows, "k long, v double").coalesce(1), str(tmp_path / name), "t")
        os.makedirs(path, exist_ok=True)
        for i, f in enumerate(sorted((tmp_path / name).glob("*.sqlite"))):
            os.rename(f, f"{path}/{name}{i}.sqlite")
    assert len(os.listdir(path)) >= 2
    got = read_sqlite(spark, path, query="SELECT k, sum(v) AS s, count(*) AS n FROM t GROUP BY 1")
    assert got.dtypes == [("k", "bigint"), ("s", "double"), ("n", "bigint")]
    assert [tuple(r) for r in got.collect()] == [(1, 6.5, 2)]


def test_curve_of_each_group_even_one_without_a_name(spark):
    """Groups and labels that are null have curves like any other, and rows of one key count one by one."""
    rows = [(i // 2, g, f"l{i % 5}" if i % 3 else None, i % 4 == 0) for g in ("a", None) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, g string, l string, f boolean")
    got = curves.accumulation_curve(df, "k", "l", F.col("f"), 4, ["g"]).collect()
    for g in ("a", None):
        own = sorted((r for r in got if r["g"] == g), key=lambda r: r["pos"])
        assert [r["pos"] for r in own] == list(range(1, 41))
        assert own[0]["total"] == 1 and own[0]["non_singleton"] == 0
        assert tuple(own[-1])[2:] == (6, 6, 6, 6, 6)


def test_subset_richness_needs_no_whole_curve(spark, monkeypatch):
    """Rows past the last first place are not counted, against a walk; keys come twice, labels and sites may be null, one site is too small."""
    import hashlib

    monkeypatch.setattr(curves, "accumulation_curve", lambda *a: pytest.fail("a curve of all positions"))
    rows = [(i * 2 // 3, f"l{i * i % 7}" if i % 5 else None, site) for i in range(70) for site in ("a", "b")] + [(i, "x", None) for i in range(30)] + [(i, "x", "c") for i in range(5)]
    df = spark.createDataFrame(rows, "k int, l string, site string")
    got = {(r["site"], r["n"]): (r["mean"], r["least"], r["most"]) for r in curves.subset_richness(df, "k", "l", "site", 8, 6, 10).collect()}
    want = {}
    for site in ("a", "b"):
        own = [r for r in rows if r[2] == site]
        orders = [sorted(own, key=lambda r: (hashlib.md5(f"{r[0]}:{rep}:1".encode()).hexdigest(), r[0], r[1] or "")) for rep in range(6)]
        for n in {max(1, i * len(own) // 8) for i in range(1, 9)}:
            seen = [len({r[1] for r in o[:n]}) for o in orders]
            want[site, n] = (pytest.approx(sum(seen) / 6), min(seen), max(seen))
    assert got == want
    held = []
    whole = curves.blocked_sums
    monkeypatch.setattr(curves, "blocked_sums", lambda df, *rest: held.append(df) or whole(df, *rest))
    many = spark.range(3000).selectExpr("id AS k", "concat('l', id % 3) AS l", "'s' AS site")
    assert {r["least"] for r in curves.subset_richness(many, "k", "l", "site", 4, 2).collect()} == {3}
    assert sum(r["_n"] for df in held for r in df.collect()) < 200  # of 6,000 in both orders


def test_cascade_sends_a_row_once(spark, monkeypatch):
    """No row is sent once a rank; samples too large for a task are, and give the same rows."""
    e = spark.createDataFrame([(s, i, float(i % 4 + (s or 0)), f"n{i % 9}", f"g{i % 4}" if i % 5 else None) for s in (1, 2, None) for i in range(12 // (s or 1))], "s int, e int, v double, name string, genus string")
    p = spark.createDataFrame([(s, float(i), f"n{i * 2}", f"g{i % 3}") for s in (1, 2, 3, None) for i in range(4)], "s int, pv double, name string, genus string")
    scan = lambda: assoc.ratio_cascade(e, p, "s", "e", "v", "pv", ["name", "genus"])
    whole = scan()
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    want = []
    for s, i, v, name, genus in map(tuple, e.where("s IS NOT NULL").collect()):
        there = [r for r in p.collect() if r["s"] == s]
        first, second = [r["pv"] for r in there if r["name"] == name], [r["pv"] for r in there if r["genus"] == genus]
        if first or len(second) == 1:
            pv = max(first) if first else second[0]
            want.append((s, i, "name" if first else "genus", v / pv if pv else None))
    assert {r[2] for r in want} == {"name", "genus"} and ordered(map(tuple, whole.collect())) == ordered(want)
    monkeypatch.setattr(order, "ONE_TASK", 12)  # sample 1 has 16 rows
    assert "_part" in scan()._jdf.queryExecution().executedPlan().toString()
    assert ordered(map(tuple, scan().collect())) == ordered(want)


def test_distinct_samples_are_gathered_in_tasks_of_their_own(spark, monkeypatch):
    """What a task gathers does not grow with the file that it reads."""
    query = registry.QUERIES["j14_j18_many_to_many"]
    want = ordered(map(tuple, query(spark, "/root/testdata/sf0.001").collect()))
    monkeypatch.setattr(order, "ONE_TASK", 500)
    monkeypatch.setattr(curves, "SENT", 1000)  # orders have more rows
    dealt = query(spark, "/root/testdata/sf0.001")
    first, reading = dealt._jdf.queryExecution().executedPlan().toString().split("REPARTITION_BY_NUM")
    assert "HashAggregate" in first and "HashAggregate" not in reading and reading.count("ShuffledHashJoin") == 1
    assert ordered(map(tuple, dealt.collect())) == want


def test_block_totals_are_not_sent_to_all_tasks(spark):
    """Totals of exploded rows may be many while the planner takes them for few."""
    rows = spark.range(9).selectExpr("explode(sequence(1, 9)) AS g", "id % 3 AS b", "id AS v")
    plan = windows.blocked_sums(rows, ["g"], "b", ["v"], {"s": F.col("v")})._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_many_small_groups_need_no_blocks(spark, monkeypatch):
    """Each group is one task's work, though all together are not."""
    monkeypatch.setattr(order, "ONE_TASK", 10)
    monkeypatch.setattr(order, "blocked_sums", lambda *a: pytest.fail("dealt over blocks"))
    rows = [(g, float(i * 7 % 5), float(i * i % 6)) for g in range(6) for i in range(8)]
    df = spark.createDataFrame(rows, "g int, x double, y double")
    counts = order.running_counts(order.count_values(df, ["g"], "x"), ["g"], "x").collect()
    assert {(r["x"], r["_before"]) for r in counts if r["g"] == 3} == {(x, sum(v < x for g, v, _ in rows if g == 3)) for x in range(5)}
    small = {r["g"]: r["rho"] for r in stats.spearman(df, ["g"], "x", "y").collect()}
    monkeypatch.undo()
    monkeypatch.setattr(order, "ONE_TASK", 1)
    assert {r["g"]: r["rho"] for r in stats.spearman(df, ["g"], "x", "y").collect()} == pytest.approx(small)


def test_summary_keeps_no_map_of_all_values(spark):
    plan = registry.QUERIES["a23_a24_a27_a28_summary"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan


def test_signed_tail_is_a_sum_over_few_terms():
    """A thousand pairs with ties against the dynamic program, which has two million places; far tails keep their digits."""
    r = 2 * np.arange(100) * 10 + 11
    n = np.full(100, 10)
    ways = np.ones(1)
    for x in np.repeat(r, n):
        longer = np.zeros(len(ways) + x)
        longer[: len(ways)] += ways / 2
        longer[x:] += ways / 2
        ways = longer
    for share in (0.5, 0.45, 0.3, 0.1):
        w = int(len(ways) * share) - 1
        assert tests.signed_tail(r, n, w) == pytest.approx(float(ways[: w + 1].sum()), rel=1e-9)
    assert tests.signed_tail(r, n, 0) == pytest.approx(2.0**-1000)


def test_a_file_is_read_twice_whatever_its_scans(spark, monkeypatch):
    """Runs that go over several blocks are those of one window; each line is read for its block's row and for itself, no more."""
    monkeypatch.setattr(intervals, "LINES", 3)
    rows = [(i, f"q{i // 11}", f"t{i // 11}", 90.0 + i % 7, 5.0, i % 5 * 9, i % 5 * 9 + 4, i % 5, i % 5 + 7, 1e-9 if i % 6 else 1.0, 40, 50) for i in range(60)]
    df = spark.createDataFrame(rows, "line long, qname string, tname string, pid double, len double, qstart long, qend long, tstart long, tend long, evalue double, qlen long, tlen long")
    whole = intervals.alignment_summary(df)
    own = intervals.alignment_summary(df.withColumn("g", F.lit(1)), groups=["g"]).drop("g")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, own.collect())) and whole.count() == 6
    assert whole._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 2


def test_null_association_reads_lines_once(spark, monkeypatch):
    """Both sides' sums are made of one scan of the lines, and where many pairs are wanted, no bitmaps are."""
    plans = []
    monkeypatch.setattr(assoc, "meet_by_bitmaps", lambda *a: pytest.fail("bitmaps for pairs of all kinds"), raising=False)
    monkeypatch.setattr(assoc, "kept", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or kept(df))
    assert registry.QUERIES["d47_sp3_null_association"](spark, "/root/testdata/sf0.001").count() > 0
    # a relation that is read is one line of the plan
    assert sum("l_quantity" in line for plan in plans for line in plan.splitlines() if "Relation [" in line) == 1


def test_scan_of_few_pairs_by_bitmaps(spark, monkeypatch):
    """Both ways of meeting give the same rows; a row may have both names, come in parts, or have no sample."""
    rows = [(s if s % 9 else None, f"e{s * k % 5}" if k % 3 else None, s * k % 7 if k % 4 else None, float(s % 3 + k)) for s in range(150) for k in range(6)]
    df = spark.createDataFrame(rows, "s int, e string, p int, v double")
    wanted = spark.createDataFrame([(k, f"e{i}", p) for k in (1, 2) for i in range(5) for p in range(k, 7, 3)] + [(1, None, 2), (1, "e1", None), (1, "none", 1)], "k int, e string, p int")
    way = assoc.meet_by_bitmaps
    scan = lambda: ordered(tuple(plain(v) for v in r) for r in assoc.scan_of_sums(df, wanted, "s", "e", "p", "v", 150, keys=["k"]).collect())
    monkeypatch.setattr(assoc, "meet_by_bitmaps", lambda *a: pytest.fail("many pairs"))
    dense = scan()
    monkeypatch.setattr(assoc, "meet_by_bitmaps", way)
    monkeypatch.setattr(assoc, "DENSE", 0)
    assert len(dense) == 20 and scan() == dense and any(r[8] is not None for r in dense)
    sums = {}
    for s, e, p, v in rows:
        for who in {("e", e), ("p", p)}:
            sums.setdefault(who, {})[s] = sums.get(who, {}).get(s, 0) + v
    for _, e, p, n11, mean, *_ in dense:
        a, b = sums["e", e], sums["p", p]
        both = [s for s in a if s is not None and s in b]
        assert n11 == len(both) and mean == pytest.approx(sum(a[s] / b[s] for s in both) / len(both))


@pytest.mark.parametrize("sent", [1 << 19, 2])
def test_association_scan_with_odd_keys(spark, tmp_path, monkeypatch, sent):
    """Parts and suppliers that come twice or nowhere, orders without a customer, and tables that are sent or dealt by key."""
    from cohortloom.plans import association

    monkeypatch.setattr(association, "_SENT", sent, raising=False)
    make = spark.createDataFrame
    lines = [(o, 1 + (o * 7 + i) % 9, 1 + (o + i * i) % 6, float(1 + (o * i) % 11)) for o in range(60) for i in range(4)]
    tables = {
        "lineitem": make(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double"),
        "orders": make([(o, o % 8 if o % 11 else None) for o in range(58)] + [(5, 6)], "o_orderkey long, o_custkey long"),
        "part": make([(k, "LARGE" if k % 2 else "SMALL") for k in range(1, 8)] + [(3, "PROMO"), (3, "LARGE")], "p_partkey long, p_type string"),
        "supplier": make([(k, k % 3) for k in range(1, 6)] + [(2, 1), (4, 1)], "s_suppkey long, s_nationkey int"),
        "nation": make([(k,) for k in range(4)], "n_nationkey int"),
        "customer": make([(k,) for k in range(20)], "c_custkey long"),
    }
    got, want = against_sql(spark, "d46_association_scan", tmp_path, **tables)
    assert got == want and len(got) == 9


@pytest.mark.parametrize("limits", [{}, {"BLOCK": 7}, {"RANKS": -1}, {"COLUMNS": 0}])
def test_association_scan_with_sums_that_are_null(spark, tmp_path, monkeypatch, limits):
    """Sums that are null rank last and count as common samples, sums below 0 have ratios in order, however pairs meet."""
    for k, v in limits.items():
        monkeypatch.setattr(assoc, k, v, raising=False)
    make = spark.createDataFrame
    value = lambda o, i: None if (o * 5 + i) % 4 == 0 else float((o * 3 + i * i) % 9 - 3.3)
    lines = [(o, 1 + (o * 7 + i) % 9, 1 + (o + i * i) % 6, value(o, i)) for o in range(80) for i in range(3)]
    tables = {
        "lineitem": make(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double"),
        "orders": make([(o, o % 31 if o % 11 else None) for o in range(80)], "o_orderkey long, o_custkey long"),
        "part": make([(k, ("LARGE", "SMALL", "PROMO")[k % 3]) for k in range(1, 10)], "p_partkey long, p_type string"),
        "supplier": make([(k, k % 3) for k in range(1, 7)], "s_suppkey long, s_nationkey int"),
        "nation": make([(k,) for k in range(4)], "n_nationkey int"),
        "customer": make([(k,) for k in range(40)], "c_custkey long"),
    }
    got, want = against_sql(spark, "d46_association_scan", tmp_path, **tables)
    assert got == want and len(got) == 9


def test_association_scan_keeps_a_row_a_sample(spark, monkeypatch):
    """With few names neither the sums of a sample nor its pairs are rows of their own, though all values differ."""
    most = []

    def counted(df):
        out = kept(df)
        most.append(out.count())
        return out

    monkeypatch.setattr(assoc, "kept", counted)
    rows = [(s, f"e{i % 4}", i % 9, 1.0 + (s * 7 + i) % 11) for s in range(300) for i in range(36)]
    wanted = spark.createDataFrame([(f"e{i}", p) for i in range(4) for p in range(9)], "e string, p int")
    got = assoc.scan_of_sums(spark.createDataFrame(rows, "s int, e string, p int, v double"), wanted, "s", "e", "p", "v", 300).collect()
    assert len(got) == 36 and all(r["n11"] == 300 for r in got)
    # values of 36 pairs, of two sides and of ratios, are counted from the rows
    assert sorted(most)[-3] <= 300 * 36 // 2 and 300 in most and 300 * 13 not in most

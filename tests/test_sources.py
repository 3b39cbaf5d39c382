import gzip

from pyspark.sql import functions as F

from cohortloom.sources import tables as S
from cohortloom.streaming import each_batch


def test_delimited(spark, tmp_path):
    for s in ("s1", "s2"):
        (tmp_path / s).mkdir()
        with gzip.open(tmp_path / s / "x.tsv.gz", "wt") as f:
            f.write(f"id\tn\tkind\n{s}a\t1\tNA\n{s}b\toops\tgood\n!note\n")
    df = S.read_delim(spark, f"{tmp_path}/*/x.tsv.gz", "id string, n int, kind string", nulls=["NA"], comment="!", bad_rows="bad")
    got = {r["id"]: (r["n"], r["kind"], r["bad"]) for r in df.collect()}
    assert got["s1a"] == (1, None, None) and got["s2b"][0] is None and got["s2b"][2]
    named = S.with_sample(S.read_delim(spark, f"{tmp_path}/*/x.tsv.gz", "id string, n int, kind string", comment="!"), r"/(s\d)/")
    assert {(r["id"][:2], r["sample"]) for r in named.collect()} == {("s1", "s1"), ("s2", "s2")}
    assert S.read_delim(spark, f"{tmp_path}/s1/x.tsv.gz", "id string, n int, kind string", columns={"n": "count"}).columns == ["count"]
    assert S.columns_of(spark, f"{tmp_path}/s1/x.tsv.gz") == ["id", "n", "kind"]
    assert S.optional(spark, f"{tmp_path}/none/*.tsv", "a string, b int").dtypes == [("a", "string"), ("b", "int")]
    assert S.optional(spark, f"{tmp_path}/s1/*.gz", "id string, n int, kind string").count() == 3


def test_line_formats(spark, tmp_path):
    (tmp_path / "pre").write_text("tool 1\nmore\nID\tN\na\t1\nb\tx\n")
    assert [tuple(r) for r in S.read_after_preamble(spark, str(tmp_path / "pre"), "ID", "id string, n int").orderBy("id").collect()] == [("a", 1), ("b", None)]
    (tmp_path / "ws").write_text("# head\n a   1.5 \n\nb 2\n")
    assert [tuple(r) for r in S.read_white_space(spark, str(tmp_path / "ws"), "id string, v double").orderBy("id").collect()] == [("a", 1.5), ("b", 2.0)]
    (tmp_path / "clusters").write_text("a b\tc\nd\n")
    universe = spark.createDataFrame([(x,) for x in "abcdefg"], "entity string")
    got = {r["entity"]: r["cluster_id"] for r in S.read_clusters(spark, str(tmp_path / "clusters"), universe).collect()}
    assert (got["a"], got["b"], got["c"], got["d"]) == (0, 0, 0, 1) and sorted(got[x] for x in "efg") == [2, 3, 4]
    (tmp_path / "fa").write_text(">x one\nACGT\n>y\nAC\n>x again\n")
    assert {r["id"] for r in S.fasta_ids(spark, str(tmp_path / "fa")).collect()} == {"x", "y"}
    (tmp_path / "x.xml").write_text("<set><rec><acc>A1</acc></rec><rec><acc>A2</acc></rec></set>")
    assert [r["acc"] for r in S.read_xml(spark, str(tmp_path / "x.xml"), "rec", "acc string").orderBy("acc").collect()] == ["A1", "A2"]


def test_logs_over_splits(spark, tmp_path):
    """Records that go on over borders of splits, several files, fields that are missing or come twice."""
    names = {"sample": r"^start (\w+)", "reads": r"reads: (\d+)", "rate": r"rate=([0-9.]+)"}
    want = []
    for f in ("a.log", "b.log"):
        said = ["tool 1.0", "reads: 999"]
        for i in range(200):
            said += [f"start {f[0]}{i}", *["working on it"] * (i % 7), *([f"reads: {i}", "reads: 7"] if i % 3 else []), f"rate={i / 8}"]
            want.append((f, i + 1, f"{f[0]}{i}", str(i) if i % 3 else None, str(i / 8)))
        (tmp_path / f).write_text("\n".join(said) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        got = S.mined_logs(spark, f"{tmp_path}/*.log", "^start ", names)
        assert spark.read.text(f"{tmp_path}/*.log").rdd.getNumPartitions() > 10
        assert sorted((r["file"].rsplit("/", 1)[1], *tuple(r)[1:]) for r in got.collect()) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    S.write_delim(df, str(tmp_path / "t"), gzip=True)
    assert S.read_delim(spark, str(tmp_path / "t"), "id int, v string").count() == 2
    S.write_ids(df, "id", str(tmp_path / "ids"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "ids")).collect()) == ["1", "2"]
    S.run_summary(df, {"top": F.max("id")}, ["v"]).write.json(str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().asDict() == {"rows": 2, "top": 2, "null_v": 0}
    calls = []
    build = lambda: calls.append(1) or df
    assert S.cached(spark, str(tmp_path / "c"), build).count() == S.cached(spark, str(tmp_path / "c"), build).count() == 2
    assert len(calls) == 1
    S.sql_copy(spark, {"loom_t": df}, "SELECT id FROM loom_t WHERE v LIKE 'b%'", str(tmp_path / "q"))
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "q")).collect()] == [2]


def test_stream_of_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id int, v string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    each_batch(stream, lambda b: b.groupBy("id").count(), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert {(r["id"], r["count"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, 2), (2, 1)}

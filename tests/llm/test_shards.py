"""Shards with very frequent ids, rows without id, and repeated rows."""

import zlib

import pytest

from cohortloom.llm import sharding

ROWS = [(5, f"text {i}") for i in range(300)] + [(None, f"no id {i}") for i in range(200)] + [(i, "same") for i in range(200)] + [(7, "same")] * 3 + [(2**63 - 1, None), (-(2**63), "é")]


def expected(rows, shards):
    order = sorted(((i is not None, i or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for i, t in rows))
    total, at, out, slots = sum(r[3] for r in order), 0, [], {}
    for r in order:
        s = min(shards - 1, (2 * at + r[3]) * shards // (2 * total))
        at += r[3]
        out.append((*r, s, slots.setdefault(s, 0)))
        slots[s] += 1
    return out


@pytest.mark.parametrize("partitions", [2, 16, 100])
def test_frequent_ids(spark, partitions):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(5)
    bounds, frequent = sharding.partition_bounds(df, "doc_id", 16)
    assert frequent == [5] and {4, 5} <= set(bounds)
    got = sharding.shard_by_bytes(df, 6, partitions=partitions).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"], r["shard"], r["slot"]) for r in got) == expected(ROWS, 6)


def test_written_shards_hold_every_row(spark, tmp_path):
    rows = [(i, t, "x", 1.5) for i, t in ROWS]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, size double")
    sharding.write_shards(df, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select(*df.columns).collect()), key=str) == sorted(rows, key=str)
    for r in back.groupBy("_shard").agg({"_shard": "count", "slot": "max"}).collect():
        assert r["max(slot)"] == r["count(_shard)"] - 1


def test_a_shard_is_written_by_many_tasks(spark, tmp_path):
    import os

    df = spark.createDataFrame([(i, "x" * 40) for i in range(400)], "doc_id long, text string")
    sharding.write_shards(df, str(tmp_path / "out"), shards=2, file_bytes=2000)
    files = [sorted(f for f in os.listdir(tmp_path / "out" / f"shard={k}") if f.endswith(".parquet")) for k in (0, 1)]
    assert min(map(len, files)) >= 4
    for k in (0, 1):
        slots = [[r["slot"] for r in spark.read.parquet(str(tmp_path / "out" / f"shard={k}" / f)).collect()] for f in files[k]]
        assert [x for each in slots for x in each] == list(range(200))  # file after file in slot order

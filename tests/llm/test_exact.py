"""Batches against one index, and repeated rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from cohortloom.llm import exact_dedup

ROWS = [(i, f"Text {i % 7}" if i % 3 else f"own {i}") for i in range(60)] + [(None, "Text 1"), (None, "lone"), (None, "Lone"), (8, "TEXT 1"), (59, "text 3"), (59, "text 3"), (4, None), (6, ""), (100, "z" * 100_000), (101, "Z" * 100_000)]


def brute(rows):
    by = {}
    for i, t in rows:
        by.setdefault(hashlib.sha256((t or "").encode().lower()).digest(), []).append(i)
    return {d: (max((i for i in ids if i is not None), default=None), len(ids)) for d, ids in by.items()}


@pytest.mark.parametrize("rows_a_task", [exact_dedup.LOOKUP_ROWS, 4])
@pytest.mark.parametrize("past", ["pmod(coalesce(doc_id, 1), 2) = 0", "false", "true", "coalesce(doc_id < 30, false)"])
def test_batches(spark, monkeypatch, rows_a_task, past):
    monkeypatch.setattr(exact_dedup, "LOOKUP_ROWS", rows_a_task)
    want = brute(ROWS)
    got = exact_dedup.repeats_of_batches(spark.createDataFrame(ROWS, "doc_id long, text string"), F.expr(past)).collect()
    assert len(got) == len(ROWS)
    assert all((r["keep_id"], r["group_size"]) == want[bytes(r["digest"])] for r in got)
    kept = sorted((bytes(r["digest"]), r["doc_id"]) for r in got if r["kept"])
    assert kept == sorted((d, i) for d, (i, _) in want.items())  # one row each, of repeated rows too


def test_repeated_rows_with_other_columns(spark):
    rows = [(1, "a", "later"), (1, "A", "first"), (0, "a", "x"), (2, "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for _ in range(2):
        assert sorted(map(tuple, exact_dedup.dedup(docs.repartition(3)).collect())) == [(1, "A", "first"), (2, "b", None)]

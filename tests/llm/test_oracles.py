"""The training-data queries that SQL can express, against that SQL."""

import pytest

from cohortloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = con.execute(ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    want = [tuple(dict(zip(names, r, strict=True))[c] for c in columns) for r in found.fetchall()]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == sorted(want, key=str)


def test_ties_of_turn_and_role(spark, tmp_path):
    """Turns of one number and role with unlike texts come in one order, in the operator and in its SQL."""
    import duckdb

    rows = [(c, t, r, x) for c in range(4) for t in (0, 0, 1) for r in ("user", "assistant") for x in (f"b{c}", f"a{c}", "é", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    df = QUERIES["op1_chat_tree"](spark, str(tmp_path))
    found = con.execute(ORACLES["op1_chat_tree"])
    names = [x[0] for x in found.description]
    assert sorted(tuple(r[n] for n in names) for r in df.collect()) == sorted(found.fetchall())

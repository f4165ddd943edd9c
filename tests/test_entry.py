"""The driver contract, and that the engine doesn't lean on the llm subpackage."""

import pathlib

import duckdb

import __spark_entry__ as entry


def test_engine_stands_alone():
    top = pathlib.Path(entry.__file__).parent / "tidewright"
    for p in top.rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p


def test_contract(spark):
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q)
    assert entry.entry(spark).columns == ["t", "cash", "position", "equity"]
    assert q["bars_daily"](spark, "/root/testdata/sf0.001").count() > 1000


def test_leak_queries_equal_their_sql(spark):
    """At this size the first leaky weights lie at their limit whatever the future."""
    at, q, sql = "/root/testdata/sf0.001", entry.queries(), entry.oracle_sql()
    with duckdb.connect() as con:
        con.execute(f"create view lineitem as select * from read_parquet('{at}/lineitem.parquet')")
        for name in ("leak_detector", "leak_check_random_futures", "leak_check_leaky"):
            want = sorted(con.execute(sql[name]).fetchall(), key=str)
            assert sorted((tuple(r) for r in q[name](spark, at).collect()), key=str) == want, name

"""Cylinders are made row by row; extrusions equal their SQL."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
def test_cylinders_move_nothing_but_sums(spark):
    plan = entry.queries()["cylinders"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
@pytest.mark.parametrize("name", ["cylinders", "extrusions"])
def test_prisms_equal_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{SF}/part.parquet'")
    con.execute(f"CREATE TABLE want AS {entry.oracle_sql()[name]}")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM want").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want) and want

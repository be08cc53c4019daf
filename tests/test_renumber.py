"""Dense numbers of vertices."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.operators import topology

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("held", [1 << 17, 5])
def test_ranks_within_a_solid(spark, monkeypatch, held):
    """Solids of one and of many triangles, over several batches, in a file where they are large; null is a solid too."""
    monkeypatch.setattr(topology, "HELD_ROWS", held)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = [(m, t, *((m or 5) * 7 + (t * j) % (n + 3) * 10 - 20 for j in (1, 2, 3)), f"r{t}", t / 2) for m, n in ((1, 1), (2, 40), (3, 2), (4, 7), (None, 9), (6, 23)) for t in range(n)]
        df = spark.createDataFrame([*rows, (6, 99, None, 1, 2, "none", 0.0)], "mesh_id long, tri int, v0 int, v1 int, v2 long, name string, x double")
        got = topology.renumber(df.coalesce(1))
        assert got.columns == df.columns and {dict(got.dtypes)[f"v{k}"] for k in range(3)} == {"bigint"}
        ranks = {m: {v: i for i, v in enumerate(sorted({v for r in rows if r[0] == m for v in r[2:5]}))} for m in {r[0] for r in rows}}
        want = [(r[0], r[1], *(ranks[r[0]][v] for v in r[2:5]), *r[5:]) for r in rows]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
        assert topology.renumber(df.where("false")).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
def test_numbers_are_not_joined(spark):
    plan = entry.queries()["dense_numbers"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and "MapInArrow" in plan

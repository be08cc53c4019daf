"""Plans of queries: sizes of exploded rows are underestimated, so no join may broadcast by them."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.functions import linalg

SF = "/root/testdata/sf0.001"
PLAIN = [
    "projections", "trims", "face_orders", "vertex_orbits", "self_intersections", "solid_gaps", "exported_records", "edge_crossings",
]


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
@pytest.mark.parametrize("name", PLAIN)
def test_nothing_is_broadcast(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Broadcast" not in plan


def test_first_coordinate_takes_the_bits_left(spark):
    places = [(-1, -1, -1), (0, 2**20 - 2, 7), (2**20 - 1, 3, -1), (1_200_000, 60_000, 7), (2**23 - 2, 2**20 - 2, 2**20 - 2)]
    df = spark.createDataFrame(places, "x long, y long, z long")
    back = linalg.decode_place(linalg.encode_place(F.col("x"), F.col("y"), F.col("z")))
    assert sorted(tuple(r) for r in df.select(*back).collect()) == sorted(places)


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
@pytest.mark.parametrize("name", ["level_sets", "cylinders"])
def test_few_rows_are_dealt_before_they_become_many(spark, name):
    """A small file is read by one task, which would make all triangles."""
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" in plan

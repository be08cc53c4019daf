"""Functions of one group each: called over sorted batches, never through a frame a group."""

from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from tessera.operators import booleans, groups, shapes

SF = "/root/testdata/sf0.001"
BATCHED = ["pinched_solids", "ring_extrusions", "hollow_cubes", "solid_booleans", "section_pieces", "hull_solids", "axis_revolutions", "batch_booleans", "triangulations"]


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
@pytest.mark.parametrize("name", BATCHED)
def test_no_frame_a_group(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "InPandas" not in plan


def test_groups_go_on_over_batches():
    keys = [[1, 1], [1], [], [1, 2, 3, 3], [3, 3], [4], [5, None]]
    batches = [pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array([float(x or 0) for x in k], pa.float64())], names=["k", "x"]) for k in keys]
    parts = list(groups.whole_groups(batches))
    assert [p[:, 0].tolist() for p in parts] == [[1, 1, 1, 1, 2], [3, 3, 3, 3], [4, 5], [groups.NULL]]
    assert parts[1][:, 1:].copy().view(float).reshape(-1).tolist() == [3.0] * 4


def test_keys_and_values_that_are_null(spark):
    df = spark.createDataFrame([(1, 2, 0.5), (1, 1, 1.5), (2, None, 2.0), (None, 7, None), (3, 1, 1.5), (3, 2, 0.5)], "k long, i long, x double")
    last = lambda whole, real: (whole[-1:, 0], np.array([np.nansum(real)]))
    out = groups.each_group(df, "k", ["i"], ["i"], ["x"], last, "k long, i long, s double", ("last",))
    assert sorted(map(tuple, out.collect()), key=str) == [(1, 2, 2.0), (2, None, 2.0), (3, 2, 2.0), (None, 7, 0.0)]


def test_settings_are_told_apart(spark):
    """Results are held by what they are made from and by what makes them."""
    rows = [(k, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0) for k in (1, 2, None)]
    a = shapes.triangles(spark.createDataFrame(rows, "mesh_id long, sx double, sy double, sz double, tx double, ty double, tz double")).coalesce(1)
    b = a.withColumns({f"{p}x": a[f"{p}x"] + 0.5 for p in "abc"})
    size = {op: {r[0]: r[1] for r in booleans.boolean(a, b, op).groupBy("mesh_id").agg({"bx": "max"}).collect()} for op in ("add", "subtract", "intersect")}
    assert size == {"add": dict.fromkeys((1, 2, None), 1.5), "subtract": dict.fromkeys((1, 2, None), 0.5), "intersect": dict.fromkeys((1, 2, None), 1.0)}


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
def test_faces_are_made_once(spark):
    plan = entry.queries()["face_facts"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "tessera-faced" in plan and "tessera-faces" in plan and "Python" not in plan and "Broadcast" not in plan

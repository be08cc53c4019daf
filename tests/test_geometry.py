"""Golden values of single solids, and every query against its SQL."""

import math
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.operators import measure, shapes, solids, spatial, topology
from tessera.plans import MODULES
from tessera.sources import obj

QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
SF = "/root/testdata/sf0.001"
TABLES = ("part", "supplier", "lineitem", "embeddings", "orders", "customer", "nation", "region")


def one(spark, **scale):
    row = {"mesh_id": 1, **{f"s{c}": 1.0 for c in "xyz"}, **{f"t{c}": 0.0 for c in "xyz"}, **scale}
    return spark.createDataFrame([row])


def text(v):
    return "~" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    rel = con.sql(ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    listed = ", ".join(f'"{c}"' for c in columns)
    expected = con.execute(f"select {listed} from ({ORACLE_SQL[name]})").fetchall()
    got = found.select(*columns).collect()
    assert Counter(tuple(map(text, r)) for r in got) == Counter(tuple(map(text, r)) for r in expected) and got


@pytest.mark.parametrize("sign", [1.0, -1.0])
def test_unit_cube(spark, sign):
    r = measure.measures(shapes.triangles(one(spark, sx=sign, sy=sign, sz=sign))).first()
    assert abs(r["volume"] - 1) < 1e-12 and abs(r["area"] - 6) < 1e-12 and (r["n_vert"], r["n_tri"], r["n_edge"], r["genus"]) == (8, 12, 18, 0)
    c = topology.manifold_check(shapes.triangles(one(spark, sx=sign))).first()
    assert c["is_2_manifold"] and c["n_halfedge"] == 36


def test_tetrahedron_and_mirror(spark):
    tris = shapes.triangles(one(spark), "tetrahedron")
    r = measure.measures(tris).first()
    assert abs(r["volume"] - 8 / 3) < 1e-12 and r["n_vert"] == 4
    m = measure.measures(shapes.affine(tris, [-1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0])).first()
    assert abs(m["volume"] - 8 / 3) < 1e-12
    # four corners of three equilateral triangles: the angle left is pi, a third of the area 2 sqrt(3)
    for r in measure.curvature(tris).collect():
        assert abs(r["gauss"] - math.pi * 3 / (6 * 2 * math.sqrt(3))) < 1e-9


def test_curvature_of_balls(spark):
    for radius, mean, gauss in ((1.0, 2.0, 1.0), (2.0, 1.0, 0.25)):
        ball = solids.sphere(spark.createDataFrame([(1, radius, 64)], "mesh_id long, radius double, n int"))
        found = measure.curvature(ball)
        far = found.agg(F.max(F.abs(F.col("mean") - mean)), F.max(F.abs(F.col("gauss") - gauss))).first()
        assert far[0] < 0.015 * mean and far[1] < 0.015 * gauss and found.count() == 4 * 64 * 64 + 2


def union_find(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        parent[hi] = lo
    return {x: find(x) for x in list(parent)}


def test_components_of_all_edges(spark):
    line = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_partkey", "l_suppkey").collect()
    expected = union_find((p, s + 1_000_000_000) for p, s in line)
    found = QUERIES["components"](spark, SF).collect()
    assert {(r["node"], r["component"]) for r in found} == set(expected.items()) and len(found) == len(expected)


def test_components_of_hubs_chains_and_scattered_pairs(spark):
    hub = [(5000, 1000 + k) for k in range(300)] + [(1000 + k, 1001 + k) for k in range(0, 300, 3)]
    chain = [(k, k + 1) for k in range(100, 112)]
    edges = hub + chain + [(9000 + 2 * k, 9001 + 2 * k) for k in range(50)] + [(7, 7), (8, 6), (6, 8), (8, 6)]
    found = topology.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    expected = union_find(edges)
    assert {(r["node"], r["component"]) for r in found} == set(expected.items()) and len(found) == len(expected)


def test_components_of_sorted_chains_take_few_rounds(spark, monkeypatch):
    rounds = []
    whole = topology.materialize
    monkeypatch.setattr(topology, "materialize", lambda df, label: (rounds.append(label), whole(df, label))[1])
    links = [(k, k + 1) for k in range(1000)] + [(5000, 5000), (6000, None), (None, None)] + [(7000, 7000 + k) for k in range(1, 500)]
    found = {r["node"]: r["component"] for r in topology.connected_components(spark.createDataFrame([(*x, "n") for x in links], "a long, b long, node string")).collect()}
    assert found == {**dict.fromkeys(range(1001), 0), 5000: 5000, **{7000 + k: 7000 for k in range(500)}}
    assert rounds.count("hop") <= 25
    assert topology.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_slices_of_a_cube(spark):
    for height, area in ((0.0, 1.0), (0.5, 1.0), (1.0, None)):
        cut = spatial.slice_segments(shapes.triangles(one(spark)).withColumn("height", F.lit(height)))
        assert cut.agg(F.sum(F.expr("x0 * y1 - x1 * y0") / 2)).first()[0] == area


def test_sphere_points(spark):
    p = shapes.sphere_vertices(spark.createDataFrame([(1, 2.0, 4)], "mesh_id long, radius double, n int")).collect()
    assert len(p) == 4 * 16 + 2 and all(abs(math.hypot(r["x"], r["y"], r["z"]) - 2) < 1e-12 for r in p)


def test_spheres_of_every_part(spark):
    sizes = {r["p_partkey"]: r["p_size"] for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    found = {r["mesh_id"]: r["n_vert"] for r in QUERIES["sphere_vertices"](spark, SF).collect()}
    assert found == {k: 4 * n * n + 2 for k, n in sizes.items()} and max(sizes.values()) > 4


def test_hulls_hold_all_points(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    hulls = {}
    for r in sorted(QUERIES["hulls"](spark, SF).collect(), key=lambda r: (r["mesh_id"], r["pos"])):
        hulls.setdefault(r["mesh_id"], []).append((r["x"], r["y"]))
    for r in e:
        ring = hulls[r["label"]]
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            assert (bx - ax) * (r["embedding"][1] - ay) - (by - ay) * (r["embedding"][0] - ax) >= -1e-12
    flat = spark.createDataFrame([(1, float(k), 0.0) for k in range(2)] + [(2, None, 1.0)], "mesh_id long, x double, y double")
    assert spatial.hull_2d(flat).count() == 0


def test_convex_triangles_cover_the_polygon(spark):
    circle = shapes.circle(spark.createDataFrame([(n, 1.0, n) for n in range(3, 12)], "mesh_id long, radius double, segments int"))
    at = {(r["mesh_id"], r["pos"]): (r["x"], r["y"]) for r in circle.collect()}
    area = Counter()
    for r in spatial.triangulate_convex(circle).collect():
        (ax, ay), (bx, by), (cx, cy) = (at[r["mesh_id"], r[f"v{k}"]] for k in range(3))
        part = ((bx - ax) * (cy - ay) - (by - ay) * (cx - ax)) / 2
        assert part > 0
        area[r["mesh_id"]] += part
    for r in measure.polygon_measures(circle).collect():
        assert abs(area[r["mesh_id"]] - r["area"]) < 1e-9


def test_obj_round_trip(spark, tmp_path):
    tris = shapes.triangles(one(spark))
    verts = spark.createDataFrame([(1, k, *map(float, v)) for k, v in enumerate(shapes.CUBE_VERTS)], "mesh_id long, vert int, x double, y double, z double")
    heads = spark.createDataFrame([(1, 1e-9, 2e-10)], "mesh_id long, tolerance double, epsilon double")
    folder = obj.write_obj(verts, tris, heads, str(tmp_path / "out"))
    v, f, files = obj.read_obj(spark, f"{folder}/*/*.txt")
    assert [(r["x"], r["y"], r["z"]) for r in v.orderBy("vert").collect()] == [tuple(map(float, x)) for x in shapes.CUBE_VERTS]
    assert [(r["v0"], r["v1"], r["v2"]) for r in f.orderBy("tri").collect()] == list(shapes.CUBE)
    assert [tuple(r)[1:] for r in files.collect()] == [(1e-9, 2e-10, "NoError")]


def test_obj_files_that_are_odd(spark, tmp_path):
    points = "v 0 0 0\nv 1 0 0\nv 0 1 0\nv 0 0 1\n"
    cases = {
        "ok": (points + "f 1/1 3/2/1 2//3\r\nf -4 -3 -1\n\n# note\nvn 0 0 1\n", "NoError", {(0, 2, 1), (0, 1, 3)}),
        "quad": (points + "f 1 2 3 4\nf 1 2 3\n", "InvalidConstruction", set()),
        "out": (points + "f 1 2 5\n", "VertexOutOfBounds", set()),
        "word": (points + "f 1 2 x\n", "VertexOutOfBounds", set()),
        "far": (points.replace("v 1 0 0", "v inf 0 0") + "f 1 2 3\n", "NonFiniteVertex", set()),
        "none": ("\n", "NoError", set()),
    }
    for name, (text_, _, _) in cases.items():
        (tmp_path / f"{name}.obj").write_text(text_)
    _, f, files = obj.read_obj(spark, str(tmp_path))
    name = lambda r: r["file"].rsplit("/", 1)[1][:-4]
    assert {name(r): r["status"] for r in files.collect()} == {k: status for k, (_, status, _) in cases.items()}
    found = {}
    for r in f.collect():
        found.setdefault(name(r), set()).add((r["v0"], r["v1"], r["v2"]))
    assert found == {k: faces for k, (_, _, faces) in cases.items() if faces}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 200
    assert set(e.oracle_sql()) <= set(e.queries())


def test_constructors_are_closed(spark):
    ring = shapes.circle(spark.createDataFrame([(1, 1.0, 7)], "mesh_id long, radius double, segments int"))
    knobs = {"height": F.lit(2.0), "divisions": F.lit(3), "twist": F.lit(50.0), "scale_top": F.lit(0.5)}
    twisted = solids.extrude(ring.withColumns(knobs))
    cone = solids.extrude(ring.withColumns({**knobs, "scale_top": F.lit(0.0)}))
    turned = solids.revolve(ring.withColumns({"x": F.col("x") + 2, "segments": F.lit(5)}))
    ball = solids.sphere(spark.createDataFrame([(1, 1.0, 3)], "mesh_id long, radius double, n int"))
    for tris in (twisted, cone, turned, ball, solids.refine(twisted, 4)):
        assert tris.groupBy("mesh_id", "tri").count().where("count > 1").count() == 0
        check, size = topology.manifold_check(tris).first(), measure.measures(tris).first()
        assert check["is_2_manifold"] and size["volume"] > 0
    assert ball.count() == 72 and solids.extrude(ring.withColumns({**knobs, "height": F.lit(0.0)})).count() == 0
    assert solids.refine(ball, 1).count() == 72


def test_winding_and_pieces(spark):
    ball = solids.sphere(spark.createDataFrame([(1, 1.0, 4)], "mesh_id long, radius double, n int"))
    points = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 0.0, 0.0, 1.5), (3, 0.3, 0.3, -0.3), (4, 0.9, 0.9, 0.0), (5, None, 0.0, 0.0)], "id long, x double, y double, z double")
    inside = {(r["id"], r["winding"]) for r in solids.winding_numbers(points, ball).collect()}
    assert inside == {(1, 1), (3, 1)}
    two = solids.compose(shapes.triangles(one(spark)), shapes.triangles(one(spark, tx=5.0)))
    assert {r["piece"] for r in solids.decompose(two).select("piece").distinct().collect()} == {0, 8}


def test_trim_of_a_ball(spark):
    ball = solids.sphere(spark.createDataFrame([(1, 1.0, 8)], "mesh_id long, radius double, n int"))
    whole = measure.measures(ball).first()["volume"]
    halves = [measure.measures(solids.trim_above(t.withColumn("height", F.lit(0.2))).withColumns({"v0": F.lit(0), "v1": F.lit(0), "v2": F.lit(0)})).first()["volume"] for t in (ball, shapes.affine(ball, [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, -1, 0.4]))]
    assert abs(sum(halves) - whole) < 1e-9 and 0 < halves[0] < halves[1]

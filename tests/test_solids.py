"""Kernels and operators of solids and regions against counts, volumes and brute force that are known otherwise."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.functions import linalg, quality
from tessera.kernels import plane, solid
from tessera.operators import booleans, construct, csg, fields, measure, sections, shapes, solids, spatial, topology
from tessera.sources import exchange, mesh_files

CUBE = np.array(shapes.CUBE_VERTS, float)[np.array(shapes.CUBE)]


def facts(points, tris):
    """Volume, area, vertices, triangles, genus, open half-edges."""
    if not len(tris):
        return 0.0, 0.0, 0, 0, 0, 0
    at = points[tris]
    n = np.cross(at[:, 1] - at[:, 0], at[:, 2] - at[:, 0])
    sides = Counter((t[k], t[(k + 1) % 3]) for t in tris.tolist() for k in range(3))
    loose = sum(max(0, c - sides.get((b, a), 0)) for (a, b), c in sides.items())
    return float((n * at[:, 0]).sum() / 6), float(np.linalg.norm(n, axis=1).sum() / 2), len(points), len(tris), 1 - (len(points) - 3 * len(tris) // 2 + len(tris)) // 2, loose


def turned(corners, a, b, c):
    m = np.array(shapes.rotation(a, b, c)).reshape(3, 4)[:, :3]
    return corners @ m.T


def one(spark, **scale):
    return spark.createDataFrame([{"mesh_id": 1, **{f"s{c}": 1.0 for c in "xyz"}, **{f"t{c}": 0.0 for c in "xyz"}, **scale}])


def cube(spark, **scale):
    return shapes.triangles(one(spark, **scale))


def ball(spark, n=6, radius=1.0):
    return solids.sphere(spark.createDataFrame([(1, radius, n)], "mesh_id long, radius double, n int"))


def size_of(tris):
    r, c = measure.measures(tris).first(), topology.manifold_check(tris).first()
    return r["volume"], r["area"], r["n_vert"], r["n_tri"], r["genus"], c["n_open"]


# ---- kernels


@pytest.mark.parametrize(
    ("move", "op", "expected"),
    [
        ((0.5, 0.5, 0.0), "subtract", (0.75, 5.5, 12, 20, 0)), ((1, 0, 0), "add", (2.0, 10.0, 12, 20, 0)), ((1, 1, 0), "add", (2.0, 12.0, 16, 24, -1)), ((1, 1, 1), "add", (2.0, 12.0, 16, 24, -1)),
        ((0, 0, 0), "add", (1.0, 6.0, 8, 12, 0)), ((0, 0, 0), "subtract", (0.0, 0.0, 0, 0, 0)), ((3, 0, 0), "intersect", (0.0, 0.0, 0, 0, 0)), ((1, 0, 0), "intersect", (0.0, 0.0, 0, 0, 0)),
    ],
)
def test_booleans_of_cubes_that_touch(move, op, expected):
    points, tris, _ = booleans.combine(CUBE, CUBE + np.array(move, float), op)
    found = facts(points, tris)
    assert np.allclose(found[:2], expected[:2]) and found[2:5] == expected[2:] and found[5] == 0


def test_boolean_counts_of_known_solids():
    assert facts(*booleans.combine(2 * CUBE, 2 * CUBE + [1.0, 1.0, 0.0], "add")[:2])[2:4] == (18, 32)
    points, tris, _ = booleans.combine(4 * CUBE, CUBE + 1.0, "subtract")
    assert facts(points, tris) == (63.0, 102.0, 16, 24, -1, 0)
    half = solid.half_space(points[tris], (0, 0, 1), 1.5, False)
    assert np.allclose(facts(*half[:2])[:2], (23.5, 58.0)) and facts(*half[:2])[4:] == (0, 0)
    octa = np.array(shapes.OCTA_VERTS, float)[np.array(shapes.OCTA)]
    assert abs(facts(*booleans.combine(CUBE - 0.5, octa, "intersect")[:2])[0] - 5 / 6) < 1e-9
    three = booleans.combine(CUBE, CUBE + [0.4, 0.0, 0.0], "add")
    assert np.allclose(facts(*booleans.combine(three[0][three[1]], CUBE + [0.6, 0.0, 0.0], "add")[:2])[:2], (1.6, 8.4))


def test_booleans_of_turned_cubes_add_up():
    rng = random.Random(3)
    for _ in range(40):
        a = turned(CUBE - 0.5, *(rng.uniform(-180, 180) for _ in range(3)))
        b = turned(CUBE - 0.5, *(rng.uniform(-180, 180) for _ in range(3))) + np.array([rng.uniform(-0.6, 0.6) for _ in range(3)])
        union, less, both = (facts(*booleans.combine(a, b, op)[:2]) for op in ("add", "subtract", "intersect"))
        assert abs(union[0] + both[0] - 2) < 1e-6 and abs(less[0] + both[0] - 1) < 1e-6
        assert union[5] == less[5] == both[5] == 0


def test_hulls():
    corners = np.array(shapes.CUBE_VERTS, float)
    more = np.vstack([corners, [[0.5, 0.5, 0.5], [0.1, 0.2, 0.3], [0.5, 0.5, 0.0]]])
    assert facts(*solid.hull(more)) == (1.0, 6.0, 8, 12, 0, 0)
    for few in (corners[:3], corners[:4], corners[:1], corners[:0], np.zeros((9, 3))):
        assert len(solid.hull(few)[1]) == 0
    points = np.random.default_rng(1).normal(size=(600, 3))
    at, tris = solid.hull(points)
    n = np.cross(at[tris][:, 1] - at[tris][:, 0], at[tris][:, 2] - at[tris][:, 0])
    assert ((points @ n.T - (n * at[tris][:, 0]).sum(axis=1)) < 1e-9).all() and facts(at, tris)[4:] == (0, 0)


def test_hulls_of_all_kinds(spark, tmp_path):
    """The hull of a ball's vertices is the ball, which is convex; the query has it for every part, beside the others."""
    duckdb = pytest.importorskip("duckdb")
    sizes = {1: 1, 2: 7, 40000: 50, 5: 7}
    spark.createDataFrame([*sizes.items()], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    found = entry.queries()["hull_solids"](spark, str(tmp_path))
    rows = [tuple(r) for r in found.select("mesh_id", "kind", "n_tri", "n_vert", "genus", "volume", "area").collect()]
    assert sorted(r[:2] for r in rows) == sorted((k, kind) for k in sizes for kind in ("points", "two", "ball"))
    for key, _, n_tri, n_vert, genus, volume, area in (r for r in rows if r[1] == "ball"):
        whole = size_of(ball(spark, 3, float(sizes[key])))
        assert (n_vert, n_tri, genus) == whole[2:5] == (38, 72, 0) and np.allclose((volume, area), whole[:2], atol=1e-4)
    told = duckdb.connect()
    told.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    assert sorted(told.execute(entry.oracle_sql()["hull_solids"]).fetchall()) == sorted(rows)


def test_triangle_gaps_against_sampling():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(60, 3, 3)), rng.normal(size=(60, 3, 3)) + [1.5, 0, 0]
    w = rng.dirichlet(np.ones(3) * 0.6, size=500)
    w = np.vstack([w, np.eye(3)])
    found = solid.triangle_gaps(a, b)
    for k in range(60):
        p, q = w @ a[k], w @ b[k]
        near = np.sqrt(((p[:, None] - q[None]) ** 2).sum(axis=2)).min()
        assert found[k] <= near + 1e-9 and near - found[k] < 0.5
    same = np.array([[[-1.0, 0, 0], [1, 0, 0], [0, 1, 0]]])
    assert solid.triangle_gaps(same, same + [0, 0, 2])[0] == 2 and solid.triangle_gaps(same, same)[0] == 0
    assert solid.triangle_gaps(same, same + [4.0, 0, 0])[0] == 2


def sampled(contours, p):
    w = 0
    for c in contours:
        for a, b in zip(c, c[1:] + c[:1], strict=True):
            if (a[1] <= p[1]) != (b[1] <= p[1]) and a[0] + (p[1] - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) > p[0]:
                w += 1 if b[1] > a[1] else -1
    return w


def test_fill_rules_and_triangles_of_random_contours():
    rng = random.Random(1)
    turned_over = 0
    for _ in range(80):
        contours = [[(rng.randint(0, 20), rng.randint(0, 20)) for _ in range(rng.randint(3, 8))] for _ in range(rng.randint(1, 3))]
        for rule, inside in plane.FILL.items():
            found = plane.filled(contours, rule)
            for _ in range(30):
                p = (rng.uniform(0, 20), rng.uniform(0, 20))
                assert sum((1 if plane.area(c) > 0 else -1) * plane.contains(c, p) for c in found) == inside(sampled(contours, p))
            if found:
                flat = [p for c in found for p in c]
                tris = plane.triangulate(found)
                sides = Counter((t[k], t[(k + 1) % 3]) for t in tris for k in range(3))
                at = 0
                for c in found:
                    sides.update((at + (k + 1) % len(c), at + k) for k in range(len(c)))
                    at += len(c)
                assert all(sides[b, a] == n for (a, b), n in sides.items())
                areas = [plane.area([flat[i] for i in t]) for t in tris]
                assert abs(sum(areas) - sum(map(plane.area, found))) < 1e-5
                turned_over += sum(a < -1e-9 for a in areas)
    assert turned_over <= 5


def test_offsets_of_squares():
    square = [[(0.0, 0.0), (20.0, 0.0), (20.0, 20.0), (0.0, 20.0)]]
    grown = plane.offset(square, 5, "round", segments=20)
    assert len(grown[0]) == 24 and abs(5 * sum(map(plane.area, grown)) - 4386) < 1
    assert plane.offset(square, -10.5) == [] and abs(sum(map(plane.area, plane.offset(square, -5, "miter"))) - 100) < 1e-6
    hole = [*square, [(5.0, 5.0), (5.0, 15.0), (15.0, 15.0), (15.0, 5.0)]]
    assert abs(sum(map(plane.area, plane.offset(hole, 1, "miter"))) - (22 * 22 - 8 * 8)) < 1e-6


def test_degenerate_contours_give_nothing():
    for contours in ([], [[]], [[(0.0, 0.0)]], [[(0.0, 0.0), (1.0, 1.0)]], [[(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)]], [[(0.0, 0.0), (0.0, 0.0), (0.0, 0.0)]], [[(math.nan, 0.0), (1.0, 0.0), (0.0, 1.0)]]):
        assert plane.filled(contours) == [] and plane.offset(contours, 1.0) == [] and plane.triangulate(plane.filled(contours)) == []


def test_searched_roots_lie_on_the_surface():
    rng = np.random.default_rng(4)
    f = lambda p: 1 - (p**2).sum(axis=1)
    p, q = rng.uniform(-0.4, 0.4, (200, 3)), rng.normal(size=(200, 3))
    q = 2 * q / np.linalg.norm(q, axis=1)[:, None]
    at = fields.find_surface(f, p, q, f(p), f(q), 1e-7)
    assert np.abs(np.linalg.norm(at, axis=1) - 1).max() < 1e-6


# ---- operators


def test_gaps_of_solids(spark):
    gap = lambda a, b, search: booleans.min_gap(a, b, search).first()["gap"]
    assert abs(gap(cube(spark), cube(spark, tx=2.0, ty=2.0), 1.5) - math.sqrt(2)) < 1e-12
    assert abs(gap(cube(spark), cube(spark, tx=3.0, ty=3.0), 3.0) - 2 * math.sqrt(2)) < 1e-12
    assert gap(cube(spark), ball(spark), 0.1) == 0 and gap(cube(spark, sx=0.1, sy=0.1, sz=0.1), ball(spark), 0.01) == 0
    assert gap(ball(spark, 8), shapes.translate(ball(spark, 8), 2.0, 2.0, 0.0), 0.8) == 0.8
    assert abs(gap(cube(spark), cube(spark, sx=10.0, sy=10.0, sz=10.0, tx=2.0, ty=-5.0, tz=-1.0), 1.1) - 1) < 1e-12
    assert booleans.min_gap(cube(spark), cube(spark).where("false"), 1.0).count() == 0


def test_level_sets_close(spark):
    box = spark.createDataFrame([(1, -2.0, -2.0, -2.0, 2.0, 2.0, 2.0), (2, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0), (3, None, 0.0, 0.0, 1.0, 1.0, 1.0)], "mesh_id long, lo_x double, lo_y double, lo_z double, hi_x double, hi_y double, hi_z double")
    void = fields.level_set(box, lambda x, y, z: F.greatest(F.abs(x), F.abs(y), F.abs(z)) - 1.0, 1.0)
    assert size_of(void)[4:] == (-1, 0) and abs(size_of(void)[0] - 56) < 1e-9
    rest = booleans.difference(cube(spark, sx=4.0, sy=4.0, sz=4.0, tx=-2.0, ty=-2.0, tz=-2.0), void)
    assert np.allclose(size_of(rest)[:2], (8, 24)) and size_of(rest)[4:] == (0, 0)
    round_ = size_of(fields.level_set(box, lambda x, y, z: 1.5 - F.sqrt(x * x + y * y + z * z), 0.25))
    searched = size_of(fields.level_set_batch(box, lambda p: 1.5 - np.linalg.norm(p, axis=1), 0.25, tolerance=1e-6))
    assert round_[4:] == searched[4:] == (0, 0) and abs(searched[0] - 4 / 3 * math.pi * 1.5**3) < 0.1
    assert fields.level_set(box, lambda x, y, z: F.lit(None).cast("double"), 1.0).count() == 0
    gyroid = fields.level_set(spark.createDataFrame([(1, *[0.0] * 3, *[2 * math.pi] * 3)], box.schema), lambda x, y, z: F.cos(x) * F.sin(y) + F.cos(y) * F.sin(z) + F.cos(z) * F.sin(x), 0.5)
    assert size_of(gyroid)[5] == 0


def test_solids_of_contours(spark):
    square = sections.squares(spark.createDataFrame([(1, 4.0, 4.0)], "cs_id long, width double, height double"), center=True)
    hole = sections.scale(square, 0.5, 0.5)
    ring = sections.boolean(square, hole, "subtract")
    knobs = {"height": F.lit(1.0), "divisions": F.lit(0), "twist": F.lit(0.0), "scale_x": F.lit(1.0), "scale_y": F.lit(1.0)}
    prism = size_of(construct.extrude(ring.withColumns(knobs)))
    assert np.allclose(prism[:2], (12, 48 - 48 + 24 + 24)) and prism[4:] == (1, 0)
    cone = size_of(construct.extrude(ring.withColumns({**knobs, "scale_x": F.lit(0.0), "scale_y": F.lit(0.0)})))
    assert abs(cone[0] - 4) < 1e-9 and cone[4:] == (0, 0)
    twisted = size_of(construct.extrude(ring.withColumns({**knobs, "divisions": F.lit(6), "twist": F.lit(90.0), "scale_y": F.lit(0.5)})))
    assert twisted[4:] == (1, 0) and twisted[0] > 0
    assert construct.extrude(ring.withColumns({**knobs, "height": F.lit(0.0)})).count() == 0
    vug = size_of(construct.revolve(ring.withColumns({"segments": F.lit(64), "degrees": F.lit(720.0)})))
    assert abs(vug[0] - 14 * math.pi) < 0.2 and abs(vug[1] - 30 * math.pi) < 0.2 and vug[4:] == (-1, 0)
    part = size_of(construct.revolve(ring.withColumns({"segments": F.lit(16), "degrees": F.lit(180.0)})))
    assert abs(part[0] - 7 * math.pi) < 0.2 and part[5] == 0
    assert construct.revolve(sections.translate(square, -9.0, 0.0).withColumns({"segments": F.lit(8), "degrees": F.lit(360.0)})).count() == 0
    n = size_of(construct.cylinders(spark.createDataFrame([(1, 2.0, 3.0, -1.0, 7)], "mesh_id long, height double, radius_low double, radius_high double, segments int")))
    assert n[2:] == (14, 24, 0, 0)


def test_plans_of_solids_are_flattened(spark):
    a, b, c, d = (csg.Solid(cube(spark, tx=0.3 * k)) for k in range(4))
    assert ((a + b) + (c + d)).flat().describe() == "add(leaf, leaf, leaf, leaf)"
    assert (((a - b) - c) - (d + b)).flat().describe() == "subtract(leaf, leaf, leaf, leaf, leaf)"
    assert ((a + b) ^ (c ^ d)).flat().describe() == "intersect(add(leaf, leaf), leaf, leaf)"
    moved = (a + b.translate(0.2, 0.0, 0.0)).rotate(0.0, 0.0, 90.0).scale(2.0, 1.0, 1.0).mirror(1.0, 0.0, 0.0)
    assert abs(size_of(moved.triangles())[0] - 3.0) < 1e-9
    assert csg.Solid.batch([a]) is a


def test_boxes_meet_as_by_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for k in range(150):
        size = rng.choice((0.0, 0.01, 0.5, 3.0, 200.0))
        lo = [rng.uniform(-5, 5) for _ in range(3)]
        rows.append((k, *lo, *(x + size * rng.random() for x in lo)))
    inf = float("inf")
    rows += [(200, -inf, -inf, -inf, inf, inf, inf), (201, 0.0, 0.0, 0.0, inf, 1.0, 1.0), (202, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0), (203, None, 0.0, 0.0, 1.0, 1.0, 1.0), (5, *rows[5][1:])]
    schema = "id long, " + ", ".join(f"{e}_{c} double" for e in ("lo", "hi") for c in "xyz")
    boxes = spark.createDataFrame(rows, schema)
    good = [r for r in rows if None not in r and all(r[1 + k] <= r[4 + k] for k in range(3))]
    meet = lambda a, b: all(a[1 + k] <= b[4 + k] and b[1 + k] <= a[4 + k] for k in range(3))
    found = Counter(tuple(r) for r in spatial.overlap_join(boxes, boxes).select("a_id", "b_id").collect())
    assert found == Counter((a[0], b[0]) for a in good for b in good if meet(a, b))
    mine = Counter(tuple(r) for r in spatial.overlap_join(boxes, boxes, self_join=True).select("a_id", "b_id").collect())
    assert mine == Counter((a[0], b[0]) for a in good for b in good if a[0] < b[0] and meet(a, b))
    assert spatial.overlap_join(boxes.where("false"), boxes).count() == 0


def test_pairing_and_open_edges_agree(spark):
    rows = [(1, 0, 0, 1, 2), (1, 1, 0, 1, 3), (1, 2, 1, 0, 4)]
    tris = spark.createDataFrame(rows, "mesh_id long, tri long, v0 long, v1 long, v2 long")
    loose = topology.paired(topology.halfedges(tris)).where("paired is null").count()
    assert loose == topology.open_edges(tris).count() == topology.manifold_check(tris).first()["n_open"] == 7


def test_operators_on_awkward_tables(spark):
    tris = cube(spark).unionByName(cube(spark).withColumn("mesh_id", F.lit(None).cast("long"))).unionByName(cube(spark, tx=9.0).withColumn("mesh_id", F.lit(2).cast("long")))
    none = tris.where("false")
    extra = tris.withColumns({"part": F.lit("x"), "id": F.lit("y"), "level": F.lit(1), "row": F.lit(2), "node": F.lit(3)})
    assert {r["mesh_id"]: round(r["volume"], 9) for r in measure.measures(extra).collect()} == {1: 1.0, None: 1.0, 2: 1.0}
    assert booleans.union(none, none).count() == 0 and measure.measures(none).count() == 0 and measure.curvature(none).count() == 0 and measure.checks(none).count() == 0
    assert booleans.simplify(none).count() == booleans.hull_of_solids(none).count() == booleans.split_pinched(none).count() == booleans.is_self_intersecting(none).count() == 0
    assert booleans.union(extra, none).groupBy("mesh_id").count().count() == 3
    far = tris.withColumn("ax", F.when(F.col("tri") == 0, float("inf")).otherwise(F.col("ax")))
    assert {r["status"] for r in fields.status_of(far).collect()} == {"NonFiniteVertex"} and not any(r["is_finite"] for r in measure.checks(far).collect())
    assert booleans.difference(far, none).count() > 0
    assert {r["piece"] for r in solids.decompose(extra.where("mesh_id is not null").withColumn("_at", F.lit("z"))).select("_at", "piece").distinct().collect()} == {0}
    points = none.select("mesh_id", F.col("ax").alias("x"), F.col("ay").alias("y"), F.col("az").alias("z"))
    assert booleans.hull(points).count() == 0
    contours = sections.squares(spark.createDataFrame([(1, 1.0, 1.0), (2, -1.0, 1.0), (3, 0.0, 0.0), (None, 2.0, 2.0)], "cs_id long, width double, height double"))
    assert {r["cs_id"]: r["area"] for r in sections.measures(sections.filled(contours)).collect()} == {1: 1.0, None: 4.0}
    assert sections.offset(contours.where("false"), 1.0).count() == sections.triangulate(contours.where("false")).count() == 0
    twice = contours.unionByName(contours)
    assert {r["cs_id"]: round(r["area"], 6) for r in sections.measures(sections.hull(twice)).collect()} == {1: 1.0, None: 4.0}


def test_barycentric_weights_snap(spark):
    tri = ((0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0))
    cases = {(0.0, 0.0, 0.0): (1, 0, 0), (0.001, 0.0, 0.0): (1, 0, 0), (0.5, 0.001, 0.0): (0.5, 0.5, 0), (0.25, 0.25, 5.0): (0.5, 0.25, 0.25), (0.5, 0.5, 0.0): (0, 0.5, 0.5)}
    df = spark.createDataFrame([(*p,) for p in cases], "x double, y double, z double")
    w = linalg.barycentric(tuple(F.col(c) for c in "xyz"), tuple(tuple(F.lit(v) for v in c) for c in tri), 0.01)
    for r in df.select("x", "y", "z", *(v.alias(f"w{k}") for k, v in enumerate(w))).collect():
        assert np.allclose((r["w0"], r["w1"], r["w2"]), cases[r["x"], r["y"], r["z"]]), r
    flat = linalg.barycentric((F.lit(0.5), F.lit(0.0), F.lit(0.0)), tuple(tuple(F.lit(v) for v in c) for c in ((0.0, 0.0, 0.0), (2.0, 0.0, 0.0), (1.0, 0.0, 0.0))), 0.01)
    assert np.allclose(tuple(spark.range(1).select(*(v.alias(f"w{k}") for k, v in enumerate(flat))).first()), (0.75, 0.25, 0))


def test_mesh_files_round_trip(spark, tmp_path):
    records = exchange.export(solids.compose(cube(spark), cube(spark, tx=3.0)))
    for kind in mesh_files.WRITERS:
        written = mesh_files.export_meshes(records, kind, str(tmp_path / kind))
        assert [r["mesh_id"] for r in written.collect()] == [1]
        (tmp_path / kind / f"broken.{kind}").write_bytes(b"no mesh")
        (tmp_path / kind / "other.txt").write_text("x")
        found = mesh_files.import_meshes(spark, str(tmp_path / kind))
        assert {r["file"].rsplit("/", 1)[1]: r["status"] for r in found.collect()} == {f"1.{kind}": "NoError", f"broken.{kind}": "InvalidConstruction"}
        meshes = found.where("status = 'NoError'").withColumn("mesh_id", F.lit(1).cast("long"))
        status, tris = exchange.load(exchange.merge(meshes))
        assert status.first()["status"] == "NoError" and np.allclose(size_of(tris)[:2], (2, 12)) and size_of(tris)[4:] == (-1, 0)
    assert mesh_files.supports("a/b.GLB") and not mesh_files.supports("a.obj2")
    with pytest.raises(ValueError):
        mesh_files.export_meshes(records, "doc")


def test_quality_settings():
    assert [quality.circular_segments(r) for r in (0.01, 1.0, 10.0)] == [4, 8, 36]
    quality.set_circular_segments(2)
    quality.set_min_circular_edge_length(0.0)
    assert quality.settings() == quality.DEFAULTS
    quality.set_circular_segments(5)
    assert quality.circular_segments(1.0) == 5
    quality.reset_to_defaults()


def test_refinement_keeps_solids_closed(spark):
    for tris, size in ((cube(spark, sx=3.0, sy=0.3), 0.31), (ball(spark, 5), 0.11), (cube(spark), 0.9)):
        before, after = size_of(tris), size_of(construct.refine_to_length(tris, size))
        assert np.allclose(before[:2], after[:2]) and after[4:] == (0, 0)
        assert size_of(topology.renumber(solids.refine(tris, 3)))[3] == 9 * before[3]

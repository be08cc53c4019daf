"""Queries of faces, normals and smoothing, and closed forms in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import booleans, measure, smooth, solids, spatial, topology
from tessera.plans.boolean_queries import _CUBES_SQL, _cubes
from tessera.plans.queries import _N, _SQRT, _rounded
from tessera.storage import materialize


def face_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat faces of cubes, whole and refined: triangles, sides, and vertices that few faces surround."""
    out = None
    for kind, tris in (("whole", _cubes(spark, sf_dir)), ("fine", topology.renumber(solids.refine(_cubes(spark, sf_dir), 2)))):
        # each is read by several steps, which would make it anew
        tris = materialize(tris, "faced")
        faces = materialize(booleans.coplanar_faces(tris), "faces")
        sides = topology.face_sides(tris, faces)
        few = topology.collapsible_starts(tris, faces).groupBy("mesh_id").agg(F.count("*").alias("n_few"))
        part = sides.groupBy("mesh_id").agg(F.count("*").alias("n_face"), F.sum("n_tri").alias("n_tri"), F.sum("n_side").alias("n_side"), F.count_if("is_flat_group").alias("n_flat"))
        part = part.hint("merge").join(few, "mesh_id", "left").withColumns({"n_few": F.coalesce("n_few", F.lit(0)).cast("long"), "kind": F.lit(kind)})
        out = part if out is None else out.unionByName(part)
    return out


FACE_SQL = """SELECT p_partkey AS mesh_id, kind, CAST(6 AS BIGINT) AS n_face, CAST(t AS BIGINT) AS n_tri, CAST(s AS BIGINT) AS n_side, CAST(f AS BIGINT) AS n_flat, CAST(v AS BIGINT) AS n_few
FROM part, (VALUES ('whole', 12, 24, 0, 0), ('fine', 48, 48, 6, 18)) k(kind, t, s, f, v)"""


def unbroken_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cubes in two by the edges that another cube's faces cross."""
    a, b = _cubes(spark, sf_dir), _cubes(spark, sf_dir, 0.5, -1.0, -1.0, size=3.0)
    pieces = topology.unbroken_pieces(a, spatial.edge_crossings(a, b))
    return pieces.groupBy("mesh_id", "piece").agg(F.count("*").alias("n_vert"))


UNBROKEN_SQL = "SELECT p_partkey AS mesh_id, CAST(k AS BIGINT) AS piece, CAST(4 AS BIGINT) AS n_vert FROM part, (VALUES (0), (4)) v(k)"


def normal_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normals carried through a matrix, held against turned triangles, and the longest sides of flat ones."""
    a = _cubes(spark, sf_dir).withColumns({"nx": F.lit(0.0), "ny": F.lit(0.0), "nz": F.lit(0.0)})
    n = {"x": ("y", "z"), "y": ("z", "x"), "z": ("x", "y")}
    real = {f"n{c}": (F.col("b" + p) - F.col("a" + p)) * (F.col("c" + q) - F.col("a" + q)) - (F.col("b" + q) - F.col("a" + q)) * (F.col("c" + p) - F.col("a" + p)) for c, (p, q) in n.items()}
    held = a.withColumns(real)
    wrong = held.withColumn("nx", F.when(F.col("mesh_id") % 3 == 0, -F.col("nx")).otherwise(F.col("nx")))
    moved = measure.transform_normals(held, [2.0, 0.0, 0.0, 5.0, 0.0, 1.0, 0.0, 0.0, 0.0, 3.0, 1.0, 0.0])
    sums = moved.groupBy("mesh_id").agg(F.sum(F.abs("nx")).alias("sx"), F.sum(F.abs("ny")).alias("sy"), F.sum(F.abs("nz")).alias("sz"))
    flat = _cubes(spark, sf_dir).withColumns({f"{p}z": F.lit(0.0) for p in "abc"})
    long = measure.longest_of_degenerate(flat, 1e-9).groupBy("mesh_id").agg(F.count("*").alias("n_long"))
    out = _rounded(sums, "sx", "sy", "sz").hint("merge").join(measure.matches_normals(wrong, 1e-9), "mesh_id").hint("merge").join(long, "mesh_id")
    return out


NORMAL_SQL = """SELECT p_partkey AS mesh_id, 4.0::DOUBLE AS sx, round(4 + 4 * 3 / sqrt(10), 4) AS sy, round(4 / sqrt(10), 4) AS sz, p_partkey % 3 <> 0 AS matches_normals, CAST(8 AS BIGINT) AS n_long FROM part"""


def corner_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normals of cubes' corners, split at their edges, and how many edges are sharp."""
    a = _cubes(spark, sf_dir)
    sharp = smooth.sharp_edges(a, 60.0).groupBy("mesh_id").agg(F.count("*").alias("n_sharp"))
    return _rounded(smooth.corner_normals(a, 60.0), "nx", "ny", "nz").hint("merge").join(sharp, "mesh_id")


CORNER_SQL = f"""WITH {_CUBES_SQL}, f AS (SELECT *, {", ".join(f"round(({_N[k]}) / {_SQRT}, 4) + 0.0 AS n{c}" for k, c in enumerate("xyz"))} FROM t)
SELECT mesh_id, CAST(tri AS INTEGER) AS tri, CAST(k AS INTEGER) AS k, CAST(CASE k WHEN 0 THEN v0 WHEN 1 THEN v1 ELSE v2 END AS INTEGER) AS vert, nx, ny, nz, CAST(12 AS BIGINT) AS n_sharp FROM f, (VALUES (0), (1), (2)) c(k)"""


QUERIES = {f.__name__: f for f in (face_facts, unbroken_pieces, normal_checks, corner_normals)}
ORACLE_SQL = {"face_facts": FACE_SQL, "unbroken_pieces": UNBROKEN_SQL, "normal_checks": NORMAL_SQL, "corner_normals": CORNER_SQL}

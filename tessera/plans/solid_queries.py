"""Queries of constructors, refinement, cuts, silhouettes, pieces and winding numbers, and closed forms of them in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import measure, shapes, solids, topology
from tessera.plans.queries import INSTANCES, _boxes, _rounded, _table, instances

_FACTS = ["mesh_id", "n_tri", "n_vert", "genus", "volume"]


def _facts(tris: DataFrame) -> DataFrame:
    return _rounded(measure.measures(tris).select(*_FACTS), "volume")


def _contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    part = _table(spark, sf_dir, "part").select(key.alias("mesh_id"), F.col("p_size").cast("double").alias("radius"), (3 + key % 10).cast("int").alias("segments"))
    return shapes.circle(part)


_PARTS = "i AS (SELECT p_partkey AS mesh_id, p_partkey AS p, p_size::DOUBLE AS r, 3 + p_partkey % 10 AS n FROM part)"
_AREA = "n / 2.0::DOUBLE * sin(2 * pi() / n)"


def extrusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prisms, frusta and cones."""
    key = F.col("mesh_id")
    return _facts(solids.extrude(_contours(spark, sf_dir).select("*", (1.0 + key % 5).alias("height"), (key % 3).cast("int").alias("divisions"), F.lit(0.0).alias("twist"), (key % 4 / 4).alias("scale_top"))))


EXTRUDE_SQL = f"""WITH {_PARTS}, d AS (SELECT *, (p % 4) / 4.0::DOUBLE AS s, 1 + p % 3 AS k, 1 + p % 5 AS h FROM i)
SELECT mesh_id, CAST(CASE WHEN s = 0 THEN 2*n*(k-1) + n + n - 2 ELSE 2*n*k + 2*(n-2) END AS BIGINT) AS n_tri, CAST(CASE WHEN s = 0 THEN n*k + 1 ELSE n*(k+1) END AS BIGINT) AS n_vert,
CAST(0 AS BIGINT) AS genus, round({_AREA}*r*r*h*(1+s+s*s)/3, 4) + 0.0 AS volume FROM d"""


def revolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings: contours moved away from the axis."""
    ring = _contours(spark, sf_dir).hint("merge").join(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("mesh_id"), F.col("p_size").alias("r")), "mesh_id")
    return _facts(solids.revolve(ring.select("mesh_id", "pos", (F.col("x") + 3 * F.col("r")).alias("x"), "y", (4 + F.col("mesh_id") % 5).cast("int").alias("segments"))))


REVOLVE_SQL = f"""WITH {_PARTS}, d AS (SELECT *, 4 + p % 5 AS k FROM i)
SELECT mesh_id, CAST(2*n*k AS BIGINT) AS n_tri, CAST(n*k AS BIGINT) AS n_vert, CAST(1 AS BIGINT) AS genus, round({_AREA}*r*r*3*r*k*sin(2*pi()/k), 4) + 0.0 AS volume FROM d"""


def spheres(spark: SparkSession, sf_dir: str) -> DataFrame:
    tris = solids.sphere(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("mesh_id"), F.lit(2.0).alias("radius"), (1 + F.col("p_partkey") % 6).cast("int").alias("n")))
    return _rounded(measure.measures(tris).select(*_FACTS, "area"), "volume", "area")


def _place_sql(name: str, di: int, dj: int) -> str:
    x, y, z = (f"sin(pi() / 2 * ({e}) / n)" for e in (f"i + {di}", f"j + {dj}", f"n - i - j - {di} - {dj}"))
    size = f"(2 / sqrt({x}*{x} + {y}*{y} + {z}*{z}))"
    return ", ".join(f"{c} * {size} AS {name}{k}" for c, k in zip((x, y, z), "xyz", strict=True))


_UV = [(f"(bb{k} - aa{k})", f"(cc{k} - aa{k})") for k in "xyz"]
_NORMAL = [f"({_UV[k - 2][0]}*{_UV[k - 1][1]} - {_UV[k - 1][0]}*{_UV[k - 2][1]})" for k in range(3)]
_FACES = " UNION ALL ".join(
    f"SELECT n, {', '.join(_place_sql(f'{name}{name}', *at) for name, at in zip('abc', corners, strict=True))} FROM l WHERE {where}"
    for corners, where in ((((1, 0), (0, 1), (0, 0)), "true"), (((1, 1), (0, 1), (1, 0)), "i + j < n - 1"))
)
SPHERE_SQL = f"""WITH s AS (SELECT unnest(range(1, 7)) AS n), l0 AS (SELECT n, unnest(range(n)) AS i FROM s), l AS (SELECT n, i, unnest(range(n - i)) AS j FROM l0), f AS ({_FACES}),
m AS (SELECT n, sum({" + ".join(f"{_NORMAL[k]}*aa{c}" for k, c in enumerate("xyz"))}) / 6 AS v, sum(sqrt({" + ".join(f"{x}*{x}" for x in _NORMAL)})) / 2 AS a FROM f GROUP BY n)
SELECT p_partkey AS mesh_id, CAST(8*n*n AS BIGINT) AS n_tri, CAST(4*n*n + 2 AS BIGINT) AS n_vert, CAST(0 AS BIGINT) AS genus, round(8*v, 4) + 0.0 AS volume, round(8*a, 4) + 0.0 AS area FROM part JOIN m ON n = 1 + p_partkey % 6"""


def refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cubes with every edge in three: the same solid, still closed."""
    tris = solids.refine(shapes.triangles(instances(spark, sf_dir)), 3)
    sums = _rounded(measure.measures(tris).select(*_FACTS, "area"), "volume", "area")
    return sums.hint("merge").join(topology.manifold_check(tris).select("mesh_id", "is_2_manifold"), "mesh_id")


REFINE_SQL = f"""WITH {INSTANCES} SELECT mesh_id, CAST(108 AS BIGINT) AS n_tri, CAST(56 AS BIGINT) AS n_vert, CAST(0 AS BIGINT) AS genus, round(abs(sx*sy*sz), 4) + 0.0 AS volume, round(2*(abs(sx*sy) + abs(sy*sz) + abs(sx*sz)), 4) + 0.0 AS area, true AS is_2_manifold FROM i"""


def projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silhouettes seen from above, and their area."""
    edges = solids.silhouette(shapes.triangles(instances(spark, sf_dir)))
    area = F.sum(F.col("x0") * F.col("y1") - F.col("y0") * F.col("x1")) / 2
    return _rounded(edges.groupBy("mesh_id").agg(F.count("*").alias("n_edge"), area.alias("area")), "area")


PROJECT_SQL = f"WITH {INSTANCES} SELECT mesh_id, CAST(4 AS BIGINT) AS n_edge, round(abs(sx*sy), 4) + 0.0 AS area FROM i"


def trims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of cubes and pyramids lies above a plane; solids without anything above it have no row."""
    cut = solids.trim_above(shapes.triangles(instances(spark, sf_dir)).withColumn("height", F.when(F.col("mesh_id") % 3 == 0, -1.75).otherwise(0.5)))
    a, b, c = V.vec("a"), V.vec("b"), V.vec("c")
    n = V.cross(V.sub(b, a), V.sub(c, a))
    df = cut.groupBy("mesh_id").agg(F.sum(V.dot(n, a) / 6).alias("volume"), F.max(F.greatest("az", "bz", "cz")).alias("top"))
    return _rounded(df, "volume", "top")


TRIM_SQL = f"""WITH {INSTANCES}, b AS (SELECT *, least(tz, tz+sz) AS lo, greatest(tz, tz+sz) AS hi, (CASE WHEN mesh_id % 3 = 0 THEN -1.75 ELSE 0.5 END)::DOUBLE AS h FROM i)
SELECT mesh_id, round(abs(sx*sy)*(hi - greatest(lo, h)), 4) + 0.0 AS volume, round(hi, 4) + 0.0 AS top FROM b WHERE hi > h"""


def compose_decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cube and a pyramid as one solid, taken apart again."""
    both = solids.compose(shapes.triangles(instances(spark, sf_dir)), shapes.triangles(instances(spark, sf_dir), "tetrahedron"))
    return solids.decompose(both).groupBy("mesh_id", "piece").agg(F.count("*").alias("n_tri"))


COMPOSE_SQL = """SELECT p_partkey AS mesh_id, CAST(piece AS BIGINT) AS piece, CAST(n AS BIGINT) AS n_tri FROM part, (VALUES (0, 12), (8, 4)) v(piece, n)"""


def winding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings in cubes around others."""
    boxes = _boxes(spark, sf_dir)
    cubes = shapes.triangles(boxes.select(F.col("id").alias("mesh_id"), *(F.lit(0.04).alias(f"s{k}") for k in "xyz"), *(F.col(f"lo_{k}").alias(f"t{k}") for k in "xyz")))
    e = F.col("embedding")
    points = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *((e[n].cast("double") + 0.0007).alias(k) for n, k in enumerate("xyz")))
    return solids.winding_numbers(points, cubes)


_INSIDE = " AND ".join(f"q.{k} > b.{k} - 0.02::DOUBLE AND q.{k} < b.{k} + 0.02::DOUBLE" for k in "xyz")
WINDING_SQL = f"""WITH b AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings), q AS (SELECT id, x + 0.0007::DOUBLE AS x, y + 0.0007::DOUBLE AS y, z + 0.0007::DOUBLE AS z FROM b)
SELECT q.id, b.id AS mesh_id, CAST(1 AS BIGINT) AS winding FROM q JOIN b ON {_INSIDE}"""


def matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Determinants and products of 3x3 matrices and quaternions from embeddings."""
    e = F.col("embedding")
    x = [e[k].cast("double") for k in range(9)]
    rows = (tuple(x[:3]), tuple(x[3:6]), tuple(x[6:9]))
    inv = V.inverse(rows)
    trace = sum((rows[0][k] * inv[k][0] for k in range(3)), F.lit(0.0))
    q = V.quaternion_product(tuple(x[:4]), tuple(x[4:8]))
    unit = V.normalized(rows[0])
    cols = [V.determinant(rows).alias("det"), trace.alias("one"), q[0].alias("qx"), q[3].alias("qw"), V.length(unit).alias("unit"), V.clamp(V.lerp(x[0], x[1], F.lit(0.25)), -0.05, 0.05).alias("mix")]
    return _rounded(_table(spark, sf_dir, "embeddings").select("vec_id", *cols), "det", "one", "qx", "qw", "unit", "mix", places=7)


MATRIX_SQL = f"""WITH m AS (SELECT vec_id, {", ".join(f"embedding[{k + 1}]::DOUBLE AS m{k}" for k in range(9))} FROM embeddings)
SELECT vec_id, round(m0*m4*m8 + m1*m5*m6 + m2*m3*m7 - m2*m4*m6 - m1*m3*m8 - m0*m5*m7, 7) + 0.0 AS det, 1.0::DOUBLE AS one,
round(m3*m4 + m7*m0 + m1*m6 - m2*m5, 7) + 0.0 AS qx, round(m3*m7 - m0*m4 - m1*m5 - m2*m6, 7) + 0.0 AS qw, 1.0::DOUBLE AS unit,
round(least(greatest(0.75::DOUBLE*m0 + 0.25::DOUBLE*m1, -0.05), 0.05), 7) + 0.0 AS mix FROM m"""


def circle_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", V.circular_segments(F.col("p_size") / 7.0).alias("segments"))


CIRCLE_SQL = """WITH q AS (SELECT p_partkey, CAST(least(36, floor(2 * pi() * p_size / 7.0)) AS INTEGER) + 3 AS n FROM part) SELECT p_partkey, CAST(greatest(n - n % 4, 4) AS INTEGER) AS segments FROM q"""


def degenerate_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of solids of which some are flat and some have a corner at no finite place."""
    key = F.col("mesh_id")
    flat = F.when(key % 4 == 0, 0.0).otherwise(F.col("sz"))
    far = F.when(key % 10 == 3, float("inf")).otherwise(F.col("tx"))
    return measure.checks(shapes.triangles(instances(spark, sf_dir).withColumns({"sz": flat, "tx": far})), 1e-9)


DEGENERATE_SQL = f"""WITH {INSTANCES} SELECT mesh_id, CAST(CASE WHEN mesh_id % 10 = 3 THEN 0 WHEN mesh_id % 4 = 0 THEN 8 ELSE 0 END AS BIGINT) AS n_degenerate, mesh_id % 10 <> 3 AS is_finite,
true AS is_dense, CAST(8 AS BIGINT) AS n_used FROM i"""


QUERIES = {f.__name__: f for f in (extrusions, revolutions, spheres, refinement, projections, trims, compose_decompose, winding, matrices, circle_quality, degenerate_triangles)}
ORACLE_SQL = {
    "extrusions": EXTRUDE_SQL,
    "revolutions": REVOLVE_SQL,
    "spheres": SPHERE_SQL,
    "refinement": REFINE_SQL,
    "projections": PROJECT_SQL,
    "trims": TRIM_SQL,
    "compose_decompose": COMPOSE_SQL,
    "winding": WINDING_SQL,
    "matrices": MATRIX_SQL,
    "circle_quality": CIRCLE_SQL,
    "degenerate_triangles": DEGENERATE_SQL,
}

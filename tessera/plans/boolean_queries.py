"""Queries of booleans, cuts, comparisons, level sets, exchange records and topology, and closed forms in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import booleans, columns, csg, fields, measure, shapes, solids, spatial, topology
from tessera.plans.queries import _EDGES, INSTANCES, _rounded, _table, _tri_sql, instances
from tessera.sources import exchange

def _key() -> Column:
    return F.col("p_partkey")


def _facts(tris: DataFrame, *drop: str) -> DataFrame:
    return _rounded(measure.measures(tris).select("mesh_id", "n_tri", "n_vert", "genus", "volume", "area"), "volume", "area").drop(*drop)


def _placed(rows: DataFrame, key: Column, s: Column, x, y, z, size) -> DataFrame:
    shift = {"tx": x, "ty": y, "tz": z}
    return shapes.triangles(rows.select(key.alias("mesh_id"), *((s * size).alias(f"s{c}") for c in "xyz"), *((s * v).alias(k) for k, v in shift.items())))


def _cubes(spark: SparkSession, sf_dir: str, x=0.0, y=0.0, z=0.0, size=1.0) -> DataFrame:
    """A cube for each part, of its size times ``size``, moved by shares of its size."""
    return _placed(_table(spark, sf_dir, "part"), _key(), F.col("p_size").cast("double"), x, y, z, size)


def _supplied(spark: SparkSession, sf_dir: str, x=0.0, y=0.0, z=0.0) -> DataFrame:
    """The same for each supplier, for queries that take many steps a solid."""
    return _placed(_table(spark, sf_dir, "supplier"), F.col("s_suppkey"), (1 + F.col("s_suppkey") % 9).cast("double"), x, y, z, 1.0)


_SIZES = "s AS (SELECT p_partkey AS mesh_id, p_size::DOUBLE AS s FROM part)"
_SUPPLIED = "s AS (SELECT s_suppkey AS mesh_id, (1 + s_suppkey % 9)::DOUBLE AS s FROM supplier)"


def solid_booleans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cubes with the same moved (through a corner, along an edge, face to face, edge to edge, apart): united, taken off or
    met, one after another along the parts."""
    a = _cubes(spark, sf_dir)
    step = [F.when(_key() % 5 == 0, 0.5).when(_key() % 5 == 1, 0.5).when(_key() % 5 == 2, 1.0).when(_key() % 5 == 3, 1.0).otherwise(3.0), F.when(_key() % 5 < 2, 0.5).when(_key() % 5 == 3, 1.0).otherwise(0.0), F.when(_key() % 5 == 0, 0.5).otherwise(0.0)]
    b = _cubes(spark, sf_dir, *step)
    out = None
    for k, op in enumerate(("add", "subtract", "intersect")):
        mine = F.floor(F.col("mesh_id") / 5) % 3 == k
        part = _facts(booleans.boolean(a.where(mine), b.where(mine), op)).withColumn("op", F.lit(op))
        out = part if out is None else out.unionByName(part)
    return out


_BOOLEAN_CASES = """(0, 'add', 36, 20, 0, 1.875, 10.5), (0, 'subtract', 24, 14, 0, 0.875, 6), (0, 'intersect', 12, 8, 0, 0.125, 1.5), (1, 'add', 32, 18, 0, 1.75, 9.5), (1, 'subtract', 20, 12, 0, 0.75, 5.5), (1, 'intersect', 12, 8, 0, 0.25, 2.5),
(2, 'add', 20, 12, 0, 2, 10), (2, 'subtract', 12, 8, 0, 1, 6), (3, 'add', 24, 16, -1, 2, 12), (3, 'subtract', 12, 8, 0, 1, 6), (4, 'add', 24, 16, -1, 2, 12), (4, 'subtract', 12, 8, 0, 1, 6)"""
BOOLEAN_SQL = f"""WITH {_SIZES} SELECT mesh_id, op, CAST(t AS BIGINT) AS n_tri, CAST(v AS BIGINT) AS n_vert, CAST(g AS BIGINT) AS genus, round(vol::DOUBLE*s*s*s, 4) + 0.0 AS volume, round(ar::DOUBLE*s*s, 4) + 0.0 AS area
FROM s JOIN (VALUES {_BOOLEAN_CASES}) c(k, op, t, v, g, vol, ar) ON mesh_id % 5 = k AND op = CASE mesh_id // 5 % 3 WHEN 0 THEN 'add' WHEN 1 THEN 'subtract' ELSE 'intersect' END"""


def hollow_cubes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cubes with a room inside, and the part of them below half their height."""
    room = booleans.difference(_cubes(spark, sf_dir, size=4.0), _cubes(spark, sf_dir, 1.0, 1.0, 1.0)).select(*booleans._NAMES)
    s = _table(spark, sf_dir, "part").select(_key().alias("mesh_id"), (1.5 * F.col("p_size")).alias("offset"))
    cut = booleans.trim_by_plane(room.hint("merge").join(s, "mesh_id").withColumns({"nx": F.lit(0.0), "ny": F.lit(0.0), "nz": F.lit(-2.0), "offset": -F.col("offset")}))
    return _facts(room, "n_tri", "n_vert").withColumn("kind", F.lit("whole")).unionByName(_facts(cut, "n_tri", "n_vert").withColumn("kind", F.lit("cut")))


HOLLOW_SQL = f"""WITH {_SIZES} SELECT mesh_id, kind, CAST(g AS BIGINT) AS genus, round(vol::DOUBLE*s*s*s, 4) + 0.0 AS volume, round(ar::DOUBLE*s*s, 4) + 0.0 AS area
FROM s, (VALUES ('whole', -1, 63, 102), ('cut', 0, 23.5, 58)) c(kind, g, vol, ar)"""


def _volumes(tris: DataFrame) -> DataFrame:
    return _rounded(measure.measures(tris).select("mesh_id", "genus", "volume"), "volume", places=5)


def plane_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of cubes cut through the middle by a slanted plane, or by another solid, in turn along the parts."""
    a = _cubes(spark, sf_dir)
    normal = [1.0, 2.0, 3.0]
    length = sum(x * x for x in normal) ** 0.5
    at = _table(spark, sf_dir, "part").select(_key().alias("mesh_id"), *(F.lit(x).alias(n) for n, x in zip(("nx", "ny", "nz"), normal, strict=True)), (F.col("p_size") * (sum(normal) / 2 / length)).alias("offset"))
    both = booleans.split_by_plane(a.where("mesh_id % 2 = 0").hint("merge").join(at, "mesh_id"))
    sides = _volumes(both.withColumn("mesh_id", 2 * F.col("mesh_id") + F.col("side")).drop("side"))
    out = sides.withColumn("kind", F.concat(F.lit("plane "), (F.col("mesh_id") % 2).cast("string"))).withColumn("mesh_id", F.floor(F.col("mesh_id") / 2))
    odd = a.where("mesh_id % 2 = 1")
    for name, part in zip(("inside", "outside"), booleans.split(odd, _cubes(spark, sf_dir, 0.25, 0.25, 0.5).where("mesh_id % 2 = 1")), strict=True):
        out = out.unionByName(_volumes(part.select(*booleans._NAMES)).withColumn("kind", F.lit(name)))
    return out


SPLIT_SQL = f"""WITH {_SIZES} SELECT mesh_id, kind, CAST(0 AS BIGINT) AS genus, round(k::DOUBLE*s*s*s, 5) + 0.0 AS volume FROM s JOIN (VALUES (0, 'plane 0', 0.5), (0, 'plane 1', 0.5), (1, 'inside', 0.28125), (1, 'outside', 0.71875)) c(i, kind, k) ON mesh_id % 2 = i"""


def batch_booleans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three cubes in a row that overlap: all together, the first less the others, or what all share, one after another
    along the parts."""
    parts = None
    for k in range(3):
        cube = _cubes(spark, sf_dir, 0.4 * k).withColumn("part", F.lit(k))
        parts = cube if parts is None else parts.unionByName(cube)
    out = None
    for k, op in enumerate(("add", "subtract", "intersect")):
        part = _facts(booleans.batch(parts.where(F.col("mesh_id") % 3 == k), op), "n_tri", "n_vert").withColumn("op", F.lit(op))
        out = part if out is None else out.unionByName(part)
    return out


BATCH_SQL = f"""WITH {_SIZES} SELECT mesh_id, op, CAST(0 AS BIGINT) AS genus, round(k::DOUBLE*s*s*s, 4) + 0.0 AS volume, round((2 + 4*k::DOUBLE)*s*s, 4) + 0.0 AS area FROM s JOIN (VALUES (0, 'add', 1.8), (1, 'subtract', 0.4), (2, 'intersect', 0.2)) c(i, op, k) ON mesh_id % 3 = i"""


def csg_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a + b) - c - d ^ e as a plan of solids: nests are flattened before anything is computed."""
    a, b = csg.Solid(_supplied(spark, sf_dir)), csg.Solid(_supplied(spark, sf_dir, 0.5))
    c, d = csg.Solid(_supplied(spark, sf_dir, 1.0)), csg.Solid(_supplied(spark, sf_dir, 0.0, 0.5))
    e = csg.Solid(_supplied(spark, sf_dir, 0.0, 0.0, 0.5)).translate(0.0, 0.0, 0.0)
    return _facts((((a + b) - c - d) ^ (a + e)).triangles(), "n_tri", "n_vert")


CSG_SQL = f"WITH {_SUPPLIED} SELECT mesh_id, CAST(0 AS BIGINT) AS genus, round(0.5::DOUBLE*s*s*s, 4) + 0.0 AS volume, round(4.0::DOUBLE*s*s, 4) + 0.0 AS area FROM s"


def hull_solids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hulls of points in a cube with its corners, of two cubes apart, and of the vertices of a ball."""
    part = _table(spark, sf_dir, "part").select(_key().alias("mesh_id"), F.col("p_size").cast("double").alias("s"))
    inner = F.array(*(F.struct(*(F.lit(x).alias(c) for c, x in zip("xyz", p, strict=True))) for p in ([(float(v >> 2 & 1), float(v >> 1 & 1), float(v & 1)) for v in range(8)] + [(0.5, 0.5, 0.5), (0.1, 0.2, 0.3), (0.5, 0.5, 0.0)])))
    points = part.select("mesh_id", "s", F.explode(inner).alias("p")).select("mesh_id", *((F.col("s") * F.col(f"p.{c}")).alias(c) for c in "xyz"))
    two = solids.compose(_cubes(spark, sf_dir), _cubes(spark, sf_dir, 2.0))
    ball = shapes.sphere_vertices(part.select("mesh_id", F.col("s").alias("radius"), F.lit(BALL).alias("n")))
    out = _facts(booleans.hull(points)).withColumn("kind", F.lit("points"))
    out = out.unionByName(_facts(booleans.hull_of_solids(two)).withColumn("kind", F.lit("two")))
    return out.unionByName(_facts(booleans.hull(ball)).withColumn("kind", F.lit("ball")))


#: Cuts of an octahedron's edge in the balls whose vertices get a hull.
BALL = 3
_BENT = [f"(sign({c}) * sin(pi() / 2 * abs({c}) / {BALL}))" for c in "ijk"]
_LATTICE = ", ".join(f"range(-{BALL}, {BALL + 1}) r{c}({c})" for c in "ijk")
_TURN = [f"((b.{y} - a.{y})*(c.{z} - a.{z}) - (b.{z} - a.{z})*(c.{y} - a.{y}))" for y, z in ("yz", "zx", "xy")]
_BEYOND = "nx*(o.x - t.x) + ny*(o.y - t.y) + nz*(o.z - t.z)"
#: Three vertices of the unit ball are a face of its hull if no other lies beyond them; the middle of the ball is inside.
HULL_SQL = f"""WITH {_SIZES}, l AS (SELECT *, sqrt({" + ".join(f"{b}*{b}" for b in _BENT)}) AS size FROM {_LATTICE} WHERE abs(i) + abs(j) + abs(k) = {BALL}),
v AS (SELECT row_number() OVER (ORDER BY i, j, k) AS id, {", ".join(f"{b} / size AS {c}" for b, c in zip(_BENT, "xyz", strict=True))} FROM l),
t AS (SELECT a.id AS v0, b.id AS v1, c.id AS v2, a.x, a.y, a.z, {", ".join(f"{e} AS n{c}" for e, c in zip(_TURN, "xyz", strict=True))} FROM v a JOIN v b ON a.id < b.id JOIN v c ON b.id < c.id),
f AS (SELECT v0, v1, v2, any_value(abs(nx*t.x + ny*t.y + nz*t.z)) AS volume, any_value(sqrt(nx*nx + ny*ny + nz*nz)) AS area FROM t JOIN v o ON o.id NOT IN (v0, v1, v2) GROUP BY v0, v1, v2 HAVING max({_BEYOND}) < 1e-9 OR min({_BEYOND}) > -1e-9),
b AS (SELECT count(*) AS n_tri, sum(volume) / 6 AS volume, sum(area) / 2 AS area, (SELECT count(DISTINCT w) FROM (SELECT unnest([v0, v1, v2]) AS w FROM f)) AS n_vert FROM f)
SELECT mesh_id, kind, CAST(12 AS BIGINT) AS n_tri, CAST(8 AS BIGINT) AS n_vert, CAST(0 AS BIGINT) AS genus, round(k*s*s*s, 4) + 0.0 AS volume, round((2 + 4*k)*s*s, 4) + 0.0 AS area FROM s, (VALUES ('points', 1::DOUBLE), ('two', 3::DOUBLE)) c(kind, k)
UNION ALL SELECT mesh_id, 'ball', CAST(n_tri AS BIGINT), CAST(n_vert AS BIGINT), CAST(0 AS BIGINT), round(volume*s*s*s, 4) + 0.0, round(area*s*s, 4) + 0.0 FROM s, b"""


def solid_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least distances of cubes: apart, over an edge, beyond the search, one inside the other."""
    step = [F.when(_key() % 4 == 3, 0.25).otherwise(1.0 + F.when(_key() % 4 == 2, 5.0).otherwise(2.0) / F.col("p_size")), F.when(_key() % 4 == 1, 1.0 + 2.0 / F.col("p_size")).when(_key() % 4 == 3, 0.25).otherwise(0.0), F.when(_key() % 4 == 3, 0.25).otherwise(0.0)]
    size = F.when(_key() % 4 == 3, 0.5).otherwise(1.0)
    return _rounded(booleans.min_gap(_cubes(spark, sf_dir), _cubes(spark, sf_dir, *step, size=size), 4.0), "gap")


GAP_SQL = "SELECT p_partkey AS mesh_id, round(CASE p_partkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 2 * sqrt(2) WHEN 2 THEN 4 ELSE 0 END, 4) + 0.0 AS gap FROM part"


def self_intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two cubes as one solid, through each other or apart."""
    both = solids.compose(_cubes(spark, sf_dir), _cubes(spark, sf_dir, F.when(_key() % 2 == 0, 0.3).otherwise(3.0), 0.2, 0.1))
    return booleans.is_self_intersecting(both)


SELF_SQL = "SELECT p_partkey AS mesh_id, p_partkey % 2 = 0 AS is_self_intersecting FROM part"


def simplifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refined cubes made simple again, and the flat faces of what is refined."""
    fine = solids.refine(_supplied(spark, sf_dir), 2)
    faces = booleans.coplanar_faces(topology.renumber(fine)).groupBy("mesh_id").agg(F.count_distinct("face").alias("n_face"))
    return _facts(booleans.simplify(fine)).hint("merge").join(faces, "mesh_id")


SIMPLE_SQL = f"WITH {_SUPPLIED} SELECT mesh_id, CAST(12 AS BIGINT) AS n_tri, CAST(8 AS BIGINT) AS n_vert, CAST(0 AS BIGINT) AS genus, round(s*s*s, 4) + 0.0 AS volume, round(6*s*s, 4) + 0.0 AS area, CAST(6 AS BIGINT) AS n_face FROM s"


def pinched_solids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two cubes that share one vertex's number, parted again."""
    b = _cubes(spark, sf_dir, 1.0, 1.0, 1.0)
    glued = b.withColumns({"tri": F.col("tri") + 12, **{f"v{k}": F.when(F.col(f"v{k}") == 0, 7).otherwise(F.col(f"v{k}") + 8) for k in range(3)}})
    both = _cubes(spark, sf_dir).unionByName(glued)
    before = measure.measures(both).select("mesh_id", F.col("n_vert").alias("n_glued"))
    return _facts(booleans.split_pinched(both)).hint("merge").join(before, "mesh_id")


PINCHED_SQL = f"WITH {_SIZES} SELECT mesh_id, CAST(24 AS BIGINT) AS n_tri, CAST(16 AS BIGINT) AS n_vert, CAST(-1 AS BIGINT) AS genus, round(2*s*s*s, 4) + 0.0 AS volume, round(12*s*s, 4) + 0.0 AS area, CAST(15 AS BIGINT) AS n_glued FROM s"


def level_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that a constant field fills, and boxes with a room, both closed."""
    part = _table(spark, sf_dir, "part").select(_key().alias("mesh_id"), *(F.lit(-2.0).alias(f"lo_{c}") for c in "xyz"), *(F.lit(2.0).alias(f"hi_{c}") for c in "xyz"))
    boxes, rooms = part.where("mesh_id % 8 <> 0"), part.where("mesh_id % 8 = 0")
    full = fields.level_set(boxes, lambda x, y, z: F.lit(1.0), 2.0)
    hollow = fields.level_set(rooms, lambda x, y, z: F.greatest(F.abs(x), F.abs(y), F.abs(z)) - 1.0, 1.0)
    return _facts(full.unionByName(hollow), "n_tri", "n_vert")


LEVEL_SQL = "SELECT p_partkey AS mesh_id, CAST(CASE WHEN p_partkey % 8 = 0 THEN -1 ELSE 0 END AS BIGINT) AS genus, CASE WHEN p_partkey % 8 = 0 THEN 56.0::DOUBLE ELSE 64 END AS volume, CASE WHEN p_partkey % 8 = 0 THEN 120.0::DOUBLE ELSE 96 END AS area FROM part"


def edge_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where edges of cubes pass through faces of the same cubes moved."""
    a, b = _cubes(spark, sf_dir), _cubes(spark, sf_dir, 0.31, 0.42, 0.53)
    return _rounded(spatial.edge_crossings(a, b), "x", "y", "z")


def _crossing_sql() -> str:
    rows = _tri_sql("cube")
    cube = rows.replace(INSTANCES, "\ni AS (SELECT p_partkey AS mesh_id, p_size::DOUBLE AS sx, p_size::DOUBLE AS sy, p_size::DOUBLE AS sz, 0.0::DOUBLE AS tx, 0.0::DOUBLE AS ty, 0.0::DOUBLE AS tz FROM part)\n")
    edges = " UNION ALL ".join(f'SELECT mesh_id, 3 * tri + {k} AS he, {", ".join(f""""{p}{c}" AS p{c}, "{q}{c}" AS q{c}""" for c in "xyz")} FROM t WHERE v{k} < v{(k + 1) % 3}' for k, (p, q) in enumerate(("ab", "bc", "ca")))
    step = {"x": 0.31, "y": 0.42, "z": 0.53}
    moved = ", ".join(f'"{p}{c}" + {step[c]}::DOUBLE * s AS "{p}{c}"' for p in "abc" for c in "xyz")
    q = lambda n: tuple(f'"{n}{c}"' for c in "xyz")
    sub = lambda u, v: tuple(f"({x} - {y})" for x, y in zip(u, v, strict=True))
    cross = lambda u, v: tuple(f"({u[(k + 1) % 3]}*{v[(k + 2) % 3]} - {u[(k + 2) % 3]}*{v[(k + 1) % 3]})" for k in range(3))
    dot = lambda u, v: "(" + " + ".join(f"{x}*{y}" for x, y in zip(u, v, strict=True)) + ")"
    a, b, c = q("a"), q("b"), q("c")
    n = ("nx", "ny", "nz")
    at = ("x", "y", "z")
    inside = " AND ".join(f"{dot(cross(sub(v, u), sub(at, u)), n)} >= 0" for u, v in ((a, b), (b, c), (c, a)))
    return f"""WITH {cube}, e AS ({edges}), m AS (SELECT mesh_id, tri, {moved} FROM t JOIN (SELECT p_partkey AS mesh_id, p_size AS s FROM part) USING (mesh_id)),
f AS (SELECT *, {", ".join(f"{x} AS n{k}" for x, k in zip(cross(sub(b, a), sub(c, a)), "xyz", strict=True))} FROM m),
j AS (SELECT *, {dot(sub(q("p"), a), n)} AS hp, {dot(sub(q("q"), a), n)} AS hq FROM e JOIN f USING (mesh_id)),
k AS (SELECT *, {", ".join(f'"p{c}" + hp / (hp - hq) * ("q{c}" - "p{c}") AS {c}' for c in "xyz")} FROM j WHERE (hp > 0) <> (hq > 0))
SELECT mesh_id, CAST(he AS BIGINT) AS he, CAST(tri AS BIGINT) AS tri, CAST(CASE WHEN hq > 0 THEN 1 ELSE -1 END AS INTEGER) AS sign, {", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in "xyz")} FROM k WHERE {inside}"""


# ---- fields, properties, lineage


def warps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cubes sheared by an expression and stretched by a function of arrays."""
    a = _cubes(spark, sf_dir)
    sheared = fields.warp(a, lambda x, y, z: (x + z / 2, y, z))
    stretched = fields.warp_batch(a, lambda p: p * [2.0, 1.0, 1.0])
    far = fields.warp(a, lambda x, y, z: (F.when(x > 40, float("inf")).otherwise(x), y, z))
    out = _facts(sheared, "area").withColumn("kind", F.lit("shear")).unionByName(_facts(stretched, "area").withColumn("kind", F.lit("stretch")))
    return out.hint("merge").join(fields.status_of(far), "mesh_id")


WARP_SQL = f"""WITH {_SIZES} SELECT mesh_id, kind, CAST(12 AS BIGINT) AS n_tri, CAST(8 AS BIGINT) AS n_vert, CAST(0 AS BIGINT) AS genus, round(k*s*s*s, 4) + 0.0 AS volume, CASE WHEN s > 40 THEN 'NonFiniteVertex' ELSE 'NoError' END AS status
FROM s, (VALUES ('shear', 1::DOUBLE), ('stretch', 2::DOUBLE)) c(kind, k)"""


def properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels of cubes' vertices, carried to the middle of each face's first triangle, and how many differ."""
    a = _cubes(spark, sf_dir)
    props = fields.set_properties(fields.vertices(a), 2, lambda p, old: [p[0] + 2 * p[1], p[2] * 3])
    middle = a.select((F.col("mesh_id") * 100 + F.col("tri")).alias("id"), "mesh_id", "tri", *(((F.col("a" + c) + F.col("b" + c) + F.col("c" + c)) / 3).alias(c) for c in "xyz"))
    found = fields.interpolate_properties(middle, a, props)
    return _rounded(found.select("id", F.col("props")[0].alias("p0"), F.col("props")[1].alias("p1")), "p0", "p1")


PROPS_SQL = f"""WITH {_tri_sql("cube").replace(INSTANCES, chr(10) + "i AS (SELECT p_partkey AS mesh_id, p_size::DOUBLE AS sx, p_size::DOUBLE AS sy, p_size::DOUBLE AS sz, 0.0::DOUBLE AS tx, 0.0::DOUBLE AS ty, 0.0::DOUBLE AS tz FROM part)" + chr(10))}
SELECT CAST(mesh_id * 100 + tri AS BIGINT) AS id, round((ax + bx + cx + 2 * (ay + "by" + cy)) / 3, 4) + 0.0 AS p0, round(az + bz + cz, 4) + 0.0 AS p1 FROM t"""


def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which side each triangle of a difference comes from, and runs of instances, empty ones too."""
    both = booleans.difference(_cubes(spark, sf_dir), _cubes(spark, sf_dir, 0.5, 0.5, 0.5))
    found = both.withColumn("original_id", F.col("side").cast("long"))
    listed = _table(spark, sf_dir, "part").select(_key().alias("mesh_id"), F.explode(F.array(*(F.lit(k).cast("long") for k in range(3)))).alias("original_id"))
    return fields.runs(found, listed)


LINEAGE_SQL = "SELECT p_partkey AS mesh_id, CAST(k AS BIGINT) AS original_id, CAST(n AS BIGINT) AS n_tri, CAST(s AS BIGINT) AS \"start\" FROM part, (VALUES (0, 18, 0), (1, 6, 54), (2, 0, 72)) v(k, n, s)"


# ---- exchange records

_POINTS = [-1, -1, 1, 0, 0, -1, 1, -1, 1, -1, 1, -1, -1, 2, -2, 1, 1, 1, 3, -3, -1, 1, -1, 4, -4, 1, -1, -1, 5, -5, 1, 1, 1, 6, -6]
_TRIS = [2, 0, 1, 0, 3, 1, 2, 3, 0, 6, 5, 4]


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tetrahedron with seams as a record for each part, spoilt in one of fourteen ways or not at all."""
    kind = _key() % 15
    scale = F.col("p_size").cast("double")
    points = F.array(*(F.lit(float(x)) * scale for x in _POINTS))
    tris = F.array(*(F.lit(x).cast("long") for x in _TRIS))
    changed = lambda a, at, value: F.transform(a, lambda x, i: F.when(i == at, value).otherwise(x))
    longs = lambda *v: F.array(*(F.lit(x).cast("long") for x in v)) if v else F.array().cast("array<bigint>")
    doubles = lambda n, x: F.array_repeat(F.lit(x), n)
    return _table(spark, sf_dir, "part").select(
        _key().alias("mesh_id"),
        F.when(kind == 9, 2).otherwise(5).alias("num_prop"),
        F.when(kind == 1, changed(points, 7, F.lit(float("nan")))).when(kind == 14, F.array().cast("array<double>")).otherwise(points).alias("vert_properties"),
        F.when(kind == 2, changed(changed(tris, 7, F.lit(0)), 8, F.lit(3))).when(kind == 3, changed(tris, 0, F.lit(-2))).when(kind == 4, F.transform(tris, lambda x: F.when(x == 2, 4).otherwise(x)))
        .when(kind == 6, changed(tris, 11, F.lit(7))).when(kind == 13, F.slice(tris, 1, 9)).when(kind == 14, longs()).otherwise(tris).alias("tri_verts"),
        F.when(kind == 5, longs(4, 5, 7)).when(kind == 8, longs(4, 5)).when(kind == 14, longs()).otherwise(longs(4, 5, 6)).alias("merge_from"),
        F.when(kind == 14, longs()).otherwise(longs(1, 2, 3)).alias("merge_to"),
        F.when(kind == 7, longs(0, 1, 12)).otherwise(longs()).alias("run_index"),
        F.when(kind == 7, F.array(F.lit(1))).when(kind == 10, F.array(F.lit(1))).when(kind == 12, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("run_original_id"),
        F.when(kind == 10, doubles(11, 0.0)).when(kind == 12, doubles(12, float("inf"))).otherwise(F.array().cast("array<double>")).alias("run_transform"),
        F.when(kind == 11, longs(1, 2)).otherwise(longs()).alias("face_id"),
    )


def record_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of every record, its words, sizes, and how many triangles were read."""
    status, tris = exchange.load(_records(spark, sf_dir))
    n = tris.groupBy("mesh_id").agg(F.count("*").alias("n_read"))
    out = status.hint("merge").join(n, "mesh_id", "left").select("mesh_id", "status", exchange.text_of(F.col("status")).alias("words"), "n_vert", "n_tri", F.coalesce("n_read", F.lit(0)).cast("long").alias("n_read"), F.col("tolerance"))
    return _rounded(out, "tolerance", places=12)


_STATUS_CASES = {1: "NonFiniteVertex", 2: "NotManifold", 3: "VertexOutOfBounds", 4: "NotManifold", 5: "MergeIndexOutOfBounds", 6: "VertexOutOfBounds", 7: "RunIndexWrongLength", 8: "MergeVectorsDifferentLengths", 9: "MissingPositionProperties", 10: "TransformWrongLength", 11: "FaceIDWrongLength", 12: "InvalidConstruction", 13: "NotManifold"}
STATUS_SQL = f"""WITH k AS (SELECT p_partkey AS mesh_id, p_size, p_partkey % 15 AS k FROM part), s AS (SELECT *, CASE k {" ".join(f"WHEN {k} THEN '{v}'" for k, v in _STATUS_CASES.items())} ELSE 'NoError' END AS status FROM k)
SELECT mesh_id, status, CASE status {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in exchange.STATUS.items())} END AS words, CAST(CASE WHEN k = 0 THEN 7 ELSE 0 END AS BIGINT) AS n_vert, CAST(CASE WHEN k = 0 THEN 4 ELSE 0 END AS BIGINT) AS n_tri,
CAST(CASE WHEN k = 0 THEN 4 ELSE 0 END AS BIGINT) AS n_read, round(CASE WHEN k = 0 THEN 1e-12 * p_size ELSE 0 END, 12) + 0.0 AS tolerance FROM s"""


def _soup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cubes as records in which no two triangles share a vertex."""
    rows = F.array_sort(F.collect_list(F.struct("tri", F.array(*(p + c for p in "abc" for c in "xyz")).alias("at"))))
    packed = _supplied(spark, sf_dir).groupBy("mesh_id").agg(rows.alias("rows"))
    return packed.select("mesh_id", F.lit(3).alias("num_prop"), F.flatten("rows.at").alias("vert_properties"), F.sequence(F.lit(0).cast("long"), F.lit(35).cast("long")).alias("tri_verts"))


def merged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open soup before and after its vertices are merged, and measured."""
    soup = _soup(spark, sf_dir)
    before, _ = exchange.load(soup)
    merged = exchange.merge(soup)
    after, tris = exchange.load(merged)
    out = before.select("mesh_id", F.col("status").alias("before")).hint("merge").join(after.select("mesh_id", F.col("status").alias("after")), "mesh_id")
    return out.hint("merge").join(merged.select("mesh_id", F.size("merge_from").alias("n_merged")), "mesh_id").hint("merge").join(_facts(tris, "n_tri"), "mesh_id")


MERGED_SQL = f"WITH {_SUPPLIED} SELECT mesh_id, 'NotManifold' AS \"before\", 'NoError' AS \"after\", CAST(28 AS INTEGER) AS n_merged, CAST(8 AS BIGINT) AS n_vert, CAST(0 AS BIGINT) AS genus, round(s*s*s, 4) + 0.0 AS volume, round(6*s*s, 4) + 0.0 AS area FROM s"


def exported_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solids written as records with runs, read back and measured; a vertex, a triangle looked up."""
    a = _cubes(spark, sf_dir).withColumn("original_id", (F.col("tri") % 2).cast("int"))
    records = exchange.export(a)
    status, tris = exchange.load_single(records)
    at, corners, _ = exchange.point_lookup(records.withColumn("i", F.lit(1)))
    looked = records.withColumns({"i": F.lit(7), "halfedge_tangent": F.array().cast("array<double>")}).select("mesh_id", at.alias("at"), "run_index", "tri_verts", "num_prop")
    looked = looked.select("mesh_id", F.col("at")[0].alias("x7"), F.col("run_index")[1].alias("second_run"), F.size("tri_verts").alias("n_index"), "num_prop")
    return _facts(tris).hint("merge").join(looked, "mesh_id").hint("merge").join(status.select("mesh_id", "status"), "mesh_id")


EXPORT_SQL = f"""WITH {_SIZES} SELECT mesh_id, CAST(12 AS BIGINT) AS n_tri, CAST(8 AS BIGINT) AS n_vert, CAST(0 AS BIGINT) AS genus, round(s*s*s, 4) + 0.0 AS volume, round(6*s*s, 4) + 0.0 AS area, s AS x7, CAST(18 AS BIGINT) AS second_run, CAST(36 AS INTEGER) AS n_index, CAST(3 AS INTEGER) AS num_prop, 'NoError' AS status FROM s"""


# ---- topology


def opposed_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cubes with some triangles twice, the second turned over: both go."""
    a = _cubes(spark, sf_dir)
    turned = a.where("tri < mesh_id % 5").select("mesh_id", (F.col("tri") + 12).alias("tri"), F.col("v1").alias("v0"), F.col("v0").alias("v1"), "v2", *(F.col({"a": "b", "b": "a", "c": "c"}[p] + c).alias(p + c) for p in "abc" for c in "xyz"))
    left = topology.without_opposed(a.unionByName(turned))
    return left.groupBy("mesh_id").agg(F.count("*").alias("n_tri"), F.min("tri").alias("first"))


OPPOSED_SQL = "SELECT p_partkey AS mesh_id, CAST(12 - p_partkey % 5 AS BIGINT) AS n_tri, CAST(p_partkey % 5 AS INTEGER) AS first FROM part"


def vertex_orbits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-edges round each vertex, and flags of each half-edge."""
    a = _cubes(spark, sf_dir)
    flags = topology.edge_predicates(a, 6.0)
    return topology.orbits(a).hint("merge").join(flags, ["mesh_id", "he"])


_CUBES_SQL = _tri_sql("cube").replace(INSTANCES, "\ni AS (SELECT p_partkey AS mesh_id, p_size::DOUBLE AS sx, p_size::DOUBLE AS sy, p_size::DOUBLE AS sz, 0.0::DOUBLE AS tx, 0.0::DOUBLE AS ty, 0.0::DOUBLE AS tz FROM part)\n")
_LONG = " ".join(f'WHEN {k} THEN sqrt({" + ".join(f"""pow("{p}{c}" - "{q}{c}", 2)""" for c in "xyz")})' for k, (p, q) in enumerate(("ab", "bc", "ca")))
ORBIT_SQL = f"""WITH {_CUBES_SQL}, {_EDGES} SELECT e.mesh_id, CAST(e.start_v AS INTEGER) AS vert, CAST(e.he AS INTEGER) AS he, CAST(o.he // 3 * 3 + (o.he + 1) % 3 AS INTEGER) AS next, e.start_v < e.end_v AS is_forward, CASE e.he % 3 {_LONG} END < 6 AS is_short, true AS is_paired
FROM e JOIN e o ON e.mesh_id = o.mesh_id AND e.start_v = o.end_v AND e.end_v = o.start_v JOIN t ON t.mesh_id = e.mesh_id AND t.tri = e.he // 3"""


def face_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles in the order of their Morton codes, turned so that the least vertex comes first, and edges each once."""
    a = _cubes(spark, sf_dir)
    order = columns.face_order(a, ((0.0,) * 3, (50.0,) * 3)).hint("merge").join(columns.least_first(a), ["mesh_id", "tri"])
    edges = topology.undirected(topology.halfedges(a)).groupBy("mesh_id").agg(F.count("*").alias("n_edge"), F.sum("he").alias("he_sum"))
    return order.hint("merge").join(edges, "mesh_id")


def _face_sql() -> str:
    mid = {c: f'("a{c}" + "b{c}" + "c{c}") / 3' for c in "xyz"}
    step = {c: f"CAST(least(greatest(floor(1024 * {m} / 50), 0), 1023) AS BIGINT)" for c, m in mid.items()}
    code = " + ".join(f"{w} * (" + " + ".join(f"(({step[c]} >> {b}) & 1) * {1 << 3 * b}" for b in range(10)) + ")" for c, w in zip("xyz", (4, 2, 1), strict=True))
    low = "least(v0, v1, v2)"
    turned = ", ".join(f"CAST(CASE WHEN v0 = {low} THEN v{k} WHEN v1 = {low} THEN v{(k + 1) % 3} ELSE v{(k + 2) % 3} END AS INTEGER) AS v{k}" for k in range(3))
    return f"""WITH {_CUBES_SQL}, {_EDGES}, m AS (SELECT mesh_id, CAST(count(*) AS BIGINT) AS n_edge, CAST(sum(he) AS BIGINT) AS he_sum FROM e WHERE start_v < end_v GROUP BY mesh_id),
c AS (SELECT mesh_id, tri, CAST({code} AS BIGINT) AS code, {turned} FROM t)
SELECT mesh_id, CAST(tri AS INTEGER) AS tri, code, CAST(row_number() OVER (PARTITION BY mesh_id ORDER BY code, tri) - 1 AS BIGINT) AS rank, v0, v1, v2, n_edge, he_sum FROM c JOIN m USING (mesh_id)"""


def dense_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refined cubes whose hashed vertex numbers are made dense."""
    tris = topology.renumber(solids.refine(_cubes(spark, sf_dir), 2))
    return measure.checks(tris).select("mesh_id", "is_dense", "n_used", "n_degenerate").hint("merge").join(topology.manifold_check(tris).select("mesh_id", "is_2_manifold"), "mesh_id")


DENSE_SQL = "SELECT p_partkey AS mesh_id, true AS is_dense, CAST(26 AS BIGINT) AS n_used, CAST(0 AS BIGINT) AS n_degenerate, true AS is_2_manifold FROM part"


def plane_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cubes turned in degrees, mirrored by a normal and scaled; bounds and volume."""
    a = shapes.triangles(instances(spark, sf_dir))
    out = None
    for kind, tris in (("turn", shapes.rotate(a, 90.0, 0.0, 90.0)), ("mirror", shapes.mirror(a, 1.0, 1.0, 0.0)), ("scale", shapes.scale(a, 2.0, -1.0, 0.5)), ("move", shapes.translate(a, 1.0, 2.0, 3.0))):
        df = measure.measures(tris).select("mesh_id", "volume", "min_x", "max_x", "min_y", "max_z").withColumn("kind", F.lit(kind))
        out = df if out is None else out.unionByName(df)
    return _rounded(out, "volume", "min_x", "max_x", "min_y", "max_z")


TRANSFORM_SQL = f"""WITH {INSTANCES}, b AS (SELECT mesh_id, abs(sx*sy*sz) AS v, least(tx, tx+sx) AS x0, greatest(tx, tx+sx) AS x1, least(ty, ty+sy) AS y0, greatest(ty, ty+sy) AS y1, least(tz, tz+sz) AS z0, greatest(tz, tz+sz) AS z1 FROM i)
SELECT mesh_id, kind, round(CASE kind WHEN 'scale' THEN v ELSE v END, 4) + 0.0 AS volume, round(CASE kind WHEN 'turn' THEN z0 WHEN 'mirror' THEN -y1 WHEN 'scale' THEN 2*x0 ELSE x0 + 1 END, 4) + 0.0 AS min_x,
round(CASE kind WHEN 'turn' THEN z1 WHEN 'mirror' THEN -y0 WHEN 'scale' THEN 2*x1 ELSE x1 + 1 END, 4) + 0.0 AS max_x, round(CASE kind WHEN 'turn' THEN x0 WHEN 'mirror' THEN -x1 WHEN 'scale' THEN -y1 ELSE y0 + 2 END, 4) + 0.0 AS min_y,
round(CASE kind WHEN 'turn' THEN y1 WHEN 'mirror' THEN z1 WHEN 'scale' THEN z1 / 2 ELSE z1 + 3 END, 4) + 0.0 AS max_z FROM b, (VALUES ('turn'), ('mirror'), ('scale'), ('move')) k(kind)"""

QUERIES = {
    f.__name__: f
    for f in (
        solid_booleans, hollow_cubes, plane_splits, batch_booleans, csg_expressions, hull_solids, solid_gaps, self_intersections, simplifications, pinched_solids, level_sets, edge_crossings, warps, properties, lineage,
        record_status, merged_records, exported_records, opposed_faces, vertex_orbits, face_orders, dense_numbers, plane_transforms,
    )
}
ORACLE_SQL = {
    "solid_booleans": BOOLEAN_SQL,
    "hollow_cubes": HOLLOW_SQL,
    "plane_splits": SPLIT_SQL,
    "batch_booleans": BATCH_SQL,
    "csg_expressions": CSG_SQL,
    "hull_solids": HULL_SQL,
    "solid_gaps": GAP_SQL,
    "self_intersections": SELF_SQL,
    "simplifications": SIMPLE_SQL,
    "pinched_solids": PINCHED_SQL,
    "level_sets": LEVEL_SQL,
    "edge_crossings": _crossing_sql(),
    "warps": WARP_SQL,
    "properties": PROPS_SQL,
    "lineage": LINEAGE_SQL,
    "record_status": STATUS_SQL,
    "merged_records": MERGED_SQL,
    "exported_records": EXPORT_SQL,
    "opposed_faces": OPPOSED_SQL,
    "vertex_orbits": ORBIT_SQL,
    "face_orders": _face_sql(),
    "dense_numbers": DENSE_SQL,
    "plane_transforms": TRANSFORM_SQL,
}

"""Queries of the solid-geometry operators over the driver's tables, and the same in SQL.

Each part places one solid (scaled by its size, moved by its price); suppliers' embeddings give points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import measure, shapes, spatial, topology


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame, *columns: str, places: int = 4) -> DataFrame:
    """Rounded, with -0.0 made 0.0, so that engines that add in another order agree."""
    return df.withColumns({c: F.round(c, places) + 0.0 for c in columns})


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    mirrored = F.when(F.col("p_partkey") % 3 == 0, -1.0).otherwise(1.0)
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("mesh_id"), size.alias("sx"), (size / 2).alias("sy"), (mirrored * (1 + F.col("p_partkey") % 7)).alias("sz"), F.floor("p_retailprice").cast("double").alias("tx"), F.lit(2.0).alias("ty"), F.lit(-1.0).alias("tz"))


INSTANCES = """
i AS (SELECT p_partkey AS mesh_id, CAST(p_size AS DOUBLE) AS sx, CAST(p_size AS DOUBLE) / 2 AS sy,
  (CASE WHEN p_partkey % 3 = 0 THEN -1.0 ELSE 1.0 END)::DOUBLE * (1 + p_partkey % 7) AS sz, floor(p_retailprice)::DOUBLE AS tx, 2.0::DOUBLE AS ty, (-1.0)::DOUBLE AS tz FROM part)
"""


def _shape_sql(shape: str) -> str:
    verts, faces = shapes.SHAPES[shape]
    values = ", ".join(f"({k}, {a}, {b}, {c}, {', '.join(f'{float(x)}::DOUBLE' for v in (a, b, c) for x in verts[v])})" for k, (a, b, c) in enumerate(faces))
    raw = ", ".join(f"{n}{c} * s{c} + t{c} AS {n}{c}" for n in "abc" for c in "xyz")
    turn = ", ".join(f"CASE WHEN flip THEN {o}{c} ELSE {n}{c} END AS {n}{c}" for n, o in zip("abc", "acb", strict=True) for c in "xyz")
    return f"""{INSTANCES},
s(tri, w0, w1, w2, {", ".join(n + c for n in "abc" for c in "xyz")}) AS (VALUES {values}),
r AS (SELECT mesh_id, tri, w0, w1, w2, sx * sy * sz < 0 AS flip, {raw} FROM i, s),
t AS (SELECT mesh_id, tri, w0 AS v0, CASE WHEN flip THEN w2 ELSE w1 END AS v1, CASE WHEN flip THEN w1 ELSE w2 END AS v2, {turn} FROM r)"""


_N = "(by_-ay)*(cz-az)-(bz-az)*(cy-ay)", "(bz-az)*(cx-ax)-(bx-ax)*(cz-az)", "(bx-ax)*(cy-ay)-(by_-ay)*(cx-ax)"
_N = tuple(x.replace("by_", '"by"') for x in _N)
_SQRT = f"sqrt(({_N[0]})*({_N[0]})+({_N[1]})*({_N[1]})+({_N[2]})*({_N[2]}))"


def solid_measures(spark: SparkSession, sf_dir: str, shape: str = "cube") -> DataFrame:
    df = measure.measures(shapes.triangles(instances(spark, sf_dir), shape))
    return _rounded(df, "volume", "area", *measure.MIN_COLUMNS, *measure.MAX_COLUMNS)


def _measures_sql(shape: str) -> str:
    q = lambda c: f'"{c}"'
    bounds = ", ".join(f"round({f}({g}({', '.join(q(v + k) for v in 'abc')})), 4) + 0.0 AS {f}_{k}" for f, g in (("min", "least"), ("max", "greatest")) for k in "xyz")
    return f"""WITH {_shape_sql(shape).replace(" by,", ' "by",').replace(" by ", ' "by" ')},
m AS (SELECT mesh_id, count(*) AS n_tri, round(sum((({_N[0]})*ax+({_N[1]})*ay+({_N[2]})*az)/6), 4) + 0.0 AS volume, round(sum({_SQRT}/2), 4) + 0.0 AS area, {bounds},
  CAST(max(greatest(v0, v1, v2)) + 1 AS BIGINT) AS n_vert, CAST(3 * count(*) // 2 AS BIGINT) AS n_edge FROM t GROUP BY mesh_id)
SELECT *, 1 - (n_vert - n_edge + n_tri) // 2 AS genus FROM m"""


def _tri_sql(shape: str) -> str:
    return _shape_sql(shape).replace(" by,", ' "by",').replace(" by ", ' "by" ').replace("ELSE by END", 'ELSE "by" END').replace("THEN by ELSE", 'THEN "by" ELSE').replace(" by *", ' "by" *')


_EDGES = """e AS (SELECT mesh_id, 3 * tri AS he, v0 AS start_v, v1 AS end_v FROM t UNION ALL SELECT mesh_id, 3 * tri + 1, v1, v2 FROM t UNION ALL SELECT mesh_id, 3 * tri + 2, v2, v0 FROM t)"""


def halfedge_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.paired(topology.halfedges(shapes.triangles(instances(spark, sf_dir))))


def manifold_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    tris = shapes.triangles(instances(spark, sf_dir)).where("mesh_id % 5 <> 0 or tri <> 3")
    return topology.manifold_check(tris)


def open_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.open_edges(shapes.triangles(instances(spark, sf_dir)).where("mesh_id % 5 <> 0 or tri <> 3"))


def vertex_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = measure.vertex_normals(shapes.triangles(instances(spark, sf_dir)))
    return _rounded(df, "nx", "ny", "nz", "angles")


def curvature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gauss and mean curvature of scaled cubes and tetrahedra."""
    both = [measure.curvature(shapes.triangles(instances(spark, sf_dir), k)).withColumn("shape", F.lit(k)) for k in ("cube", "tetrahedron")]
    return _rounded(both[0].unionByName(both[1]), "gauss", "mean")


def _edge_length(p: str, q: str) -> str:
    return "sqrt(" + " + ".join(f'pow("{q}{c}" - "{p}{c}", 2)' for c in "xyz") + ")"


def _corner_angle(p: str, q: str, r: str) -> str:
    top = " + ".join(f'("{q}{c}" - "{p}{c}") * ("{r}{c}" - "{p}{c}")' for c in "xyz")
    return f"acos(least(greatest(({top}) / ({_edge_length(p, q)} * {_edge_length(p, r)}), -1), 1))"


def _curvature_sql(shape: str) -> str:
    """Angles, areas and dihedral angles of each vertex; the two faces of an edge meet by a join of half-edges."""
    tri = _tri_sql(shape)
    corner = " UNION ALL ".join(f"SELECT mesh_id, {v} AS vert, {_corner_angle(p, q, r)} AS angle, size FROM f" for v, p, q, r in (("v0", "a", "b", "c"), ("v1", "b", "c", "a"), ("v2", "c", "a", "b")))
    edge = " UNION ALL ".join(f'SELECT mesh_id, {s} AS s, {e} AS e, ux, uy, uz, {", ".join(f""" "{q}{c}" - "{p}{c}" AS d{c}""" for c in "xyz")} FROM f' for s, e, p, q in (("v0", "v1", "a", "b"), ("v1", "v2", "b", "c"), ("v2", "v0", "c", "a")))
    sine = "((h.uy*o.uz - h.uz*o.uy)*h.dx + (h.uz*o.ux - h.ux*o.uz)*h.dy + (h.ux*o.uy - h.uy*o.ux)*h.dz) / h.len"
    return f"""WITH {tri}, f0 AS (SELECT *, {_N[0]} AS nx, {_N[1]} AS ny, {_N[2]} AS nz, {_SQRT} AS size FROM t), f AS (SELECT *, nx / size AS ux, ny / size AS uy, nz / size AS uz FROM f0),
c AS ({corner}), h0 AS ({edge}), h AS (SELECT *, sqrt(dx*dx + dy*dy + dz*dz) AS len FROM h0),
d AS (SELECT h.mesh_id, h.s, h.e, h.len / 4 * asin(least(greatest({sine}, -1), 1)) AS bend FROM h JOIN h o ON h.mesh_id = o.mesh_id AND h.s = o.e AND h.e = o.s),
m AS (SELECT mesh_id, vert, sum(bend) AS bend FROM (SELECT mesh_id, s AS vert, bend FROM d UNION ALL SELECT mesh_id, e, bend FROM d) GROUP BY ALL),
v AS (SELECT mesh_id, vert, 2 * pi() - sum(angle) AS rest, count(*) / sum(size) AS factor FROM c GROUP BY ALL)
SELECT mesh_id, vert, '{shape}' AS shape, round(rest * factor, 4) + 0.0 AS gauss, round(bend * factor, 4) + 0.0 AS mean FROM v JOIN m USING (mesh_id, vert)"""


def _normals_sql() -> str:
    corner = " UNION ALL ".join(f"SELECT mesh_id, {v} AS vert, {_corner_angle(p, q, r)} AS w, ux, uy, uz FROM f" for v, p, q, r in (("v0", "a", "b", "c"), ("v1", "b", "c", "a"), ("v2", "c", "a", "b")))
    return f"""WITH {_tri_sql("cube")}, f0 AS (SELECT *, {_N[0]} AS nx, {_N[1]} AS ny, {_N[2]} AS nz, {_SQRT} AS size FROM t), f AS (SELECT *, nx / size AS ux, ny / size AS uy, nz / size AS uz FROM f0), c AS ({corner}),
n AS (SELECT mesh_id, vert, sum(w*ux) AS x, sum(w*uy) AS y, sum(w*uz) AS z, sum(w) AS angles FROM c GROUP BY ALL)
SELECT mesh_id, vert, {", ".join(f"round({c} / sqrt(x*x + y*y + z*z), 4) + 0.0 AS n{c}" for c in "xyz")}, round(angles, 4) + 0.0 AS angles FROM n"""


MATRIX = [0.0, -1.0, 0.0, 3.0, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0, -1.0, 1.0]


def affine_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = measure.measures(shapes.affine(shapes.triangles(instances(spark, sf_dir)), MATRIX))
    return _rounded(df.select("mesh_id", "volume", "min_x", "max_x", "min_y", "max_y", "min_z", "max_z"), "volume", *measure.MIN_COLUMNS, *measure.MAX_COLUMNS)


AFFINE_SQL = f"""WITH {INSTANCES}, b AS (SELECT mesh_id, least(tx, tx+sx) AS x0, greatest(tx, tx+sx) AS x1, least(ty, ty+sy) AS y0, greatest(ty, ty+sy) AS y1, least(tz, tz+sz) AS z0, greatest(tz, tz+sz) AS z1, abs(sx*sy*sz) AS v FROM i)
SELECT mesh_id, round(2*v, 4) + 0.0 AS volume, 3-y1 + 0.0 AS min_x, 3-y0 + 0.0 AS max_x, 2*x0 + 0.0 AS min_y, 2*x1 + 0.0 AS max_y, 1-z1 + 0.0 AS min_z, 1-z0 + 0.0 AS max_z FROM b"""


def sind_cosd(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = (F.col("p_size") * 15 - 180).cast("double")
    df = _table(spark, sf_dir, "part").select("p_partkey", V.sind(x).alias("s"), V.cosd(x).alias("c"), V.smoothstep(0.0, 30.0, F.col("p_size")).alias("step"))
    return _rounded(df, "s", "c", "step", places=9)


SIND_SQL = """SELECT p_partkey, round(sin(radians(p_size*15-180)), 9) + 0.0 AS s, round(cos(radians(p_size*15-180)), 9) + 0.0 AS c,
round(pow(least(greatest(p_size/30.0::DOUBLE, 0), 1), 2) * (3 - 2*least(greatest(p_size/30.0::DOUBLE, 0), 1)), 9) + 0.0 AS step FROM part"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    half = 0.02
    point = {k: e[n].cast("double") for n, k in enumerate("xyz")}
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *((point[k] - half).alias(f"lo_{k}") for k in "xyz"), *((point[k] + half).alias(f"hi_{k}") for k in "xyz"))


_BOXES = "b AS (SELECT vec_id AS id, " + ", ".join(f"embedding[{n}]::DOUBLE {s} 0.02::DOUBLE AS {e}_{k}" for e, s in (("lo", "-"), ("hi", "+")) for n, k in enumerate("xyz", 1)) + " FROM embeddings)"
_TOUCH = " AND ".join(f"a.lo_{k} <= b.hi_{k} AND b.lo_{k} <= a.hi_{k}" for k in "xyz")


def aabb_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir)
    return spatial.overlap_join(boxes, boxes, self_join=True).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def aabb_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir)
    moved = boxes.select("id", *((F.col(f"{e}_{k}") + 0.03).alias(f"{e}_{k}") for e in ("lo", "hi") for k in "xyz"))
    return spatial.overlap_join(boxes, moved).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


_MOVED = "m AS (SELECT id, " + ", ".join(f"{e}_{k} + 0.03::DOUBLE AS {e}_{k}" for e in ("lo", "hi") for k in "xyz") + " FROM b)"


def box_booleans(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir)
    return _rounded(spatial.box_boolean_volume(spatial.overlap_join(boxes, boxes, self_join=True)), "intersection", "union_volume", "difference", places=9)


_SIZE = lambda n: " * ".join(f"({n}.hi_{k} - {n}.lo_{k})" for k in "xyz")
_COMMON = " * ".join(f"(least(a.hi_{k}, b.hi_{k}) - greatest(a.lo_{k}, b.lo_{k}))" for k in "xyz")
BOX_SQL = f"""WITH {_BOXES}, p AS (SELECT a.id AS a, b.id AS b, {_COMMON} AS c, {_SIZE("a")} AS va, {_SIZE("b")} AS vb FROM b a JOIN b ON a.id < b.id AND {_TOUCH})
SELECT a, b, round(c, 9) + 0.0 AS intersection, round(va + vb - c, 9) + 0.0 AS union_volume, round(va - c, 9) + 0.0 AS difference FROM p"""


def morton_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    p = tuple(e[n].cast("double") for n in range(3))
    lo, hi = (F.lit(-1.0),) * 3, (F.lit(1.0),) * 3
    return _table(spark, sf_dir, "embeddings").select("vec_id", V.morton(p, lo, hi).alias("code"))


def _spread_sql(n: int) -> str:
    x = f"CAST(least(greatest(floor(1024 * (embedding[{n}]::DOUBLE + 1) / 2), 0), 1023) AS BIGINT)"
    return " + ".join(f"(({x} >> {b}) & 1) * {1 << 3 * b}" for b in range(10))


MORTON_SQL = f"SELECT vec_id, CAST(4 * ({_spread_sql(1)}) + 2 * ({_spread_sql(2)}) + ({_spread_sql(3)}) AS BIGINT) AS code FROM embeddings"


def _part_supplier_components(line: DataFrame) -> DataFrame:
    return topology.connected_components(line.select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1_000_000_000).alias("b")))


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All part-supplier edges. No SQL form, the recursive one is too slow; tested against union-find."""
    return _part_supplier_components(_table(spark, sf_dir, "lineitem"))


def nation_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers tied to their nation, and nations to their region: few steps, which SQL can follow."""
    nation, customer = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "customer")
    key = lambda c, k: F.col(c).cast("long") + k * 1_000_000_000
    links = nation.select(key("n_nationkey", 1).alias("a"), key("n_regionkey", 0).alias("b")).union(customer.select(key("c_custkey", 2), key("c_nationkey", 1)))
    return topology.connected_components(links)


COMPONENTS_SQL = """WITH RECURSIVE l AS (SELECT n_nationkey::BIGINT + 1000000000 AS a, n_regionkey::BIGINT AS b FROM nation UNION ALL SELECT c_custkey + 2000000000, c_nationkey::BIGINT + 1000000000 FROM customer),
w AS (SELECT a AS node, b AS up FROM l UNION SELECT w.node, l.b FROM w JOIN l ON w.up = l.a)
SELECT node, min(up) AS component FROM w GROUP BY node UNION SELECT b, min(b) FROM (SELECT n_regionkey::BIGINT AS b FROM nation) GROUP BY b"""


def prefix_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"), F.col("l_extendedprice").alias("price"), "l_partkey")
    return spatial.prefix_sums(line, "l_orderkey", ["l_linenumber", "l_partkey", "price"], "q").select("l_orderkey", "l_linenumber", "l_partkey", "inclusive", "exclusive")


PREFIX_SQL = """WITH l AS (SELECT *, CAST(l_quantity AS BIGINT) AS q FROM lineitem), s AS (SELECT l_orderkey, l_linenumber, l_partkey, q,
CAST(sum(q) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS BIGINT) AS inclusive FROM l)
SELECT l_orderkey, l_linenumber, l_partkey, inclusive, inclusive - q AS exclusive FROM s"""


def plane_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spatial.slice_segments(shapes.triangles(instances(spark, sf_dir)).withColumn("height", F.when(F.col("mesh_id") % 3 == 0, -1.5).otherwise(-0.5)))
    return _rounded(df, "x0", "y0", "x1", "y1")


def _cross_sql(up: bool, c: str) -> str:
    q = lambda n, k: f'"{n}{k}"'
    parts = []
    for a, b in (("a", "b"), ("b", "c"), ("c", "a")):
        rises = f"{q(a, 'z')} <= h AND {q(b, 'z')} > h" if up else f"{q(a, 'z')} > h AND {q(b, 'z')} <= h"
        parts.append(f"WHEN {rises} THEN {q(a, c)} + ({q(b, c)} - {q(a, c)}) * (h - {q(a, 'z')}) / ({q(b, 'z')} - {q(a, 'z')})")
    return f"round(CASE {' '.join(parts)} END, 4) + 0.0"


def polygon_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("mesh_id"), F.col("p_size").cast("double").alias("radius"), (3 + F.col("p_partkey") % 10).cast("int").alias("segments"))
    return _rounded(measure.polygon_measures(shapes.circle(part)), "area", "min_x", "max_x", "min_y", "max_y")


POLYGON_SQL = """WITH i AS (SELECT p_partkey AS mesh_id, p_size::DOUBLE AS radius, 3 + p_partkey % 10 AS n FROM part),
p AS (SELECT mesh_id, n, k, radius * cos(radians(360.0::DOUBLE * k / n)) AS x, radius * sin(radians(360.0::DOUBLE * k / n)) AS y FROM (SELECT *, unnest(range(n)) AS k FROM i)),
q AS (SELECT *, coalesce(lead(x) OVER w, first(x) OVER w) AS qx, coalesce(lead(y) OVER w, first(y) OVER w) AS qy FROM p WINDOW w AS (PARTITION BY mesh_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT mesh_id, count(*) AS n, round(sum(x*qy-y*qx)/2, 4) + 0.0 AS area, round(min(x), 4) + 0.0 AS min_x, round(max(x), 4) + 0.0 AS max_x, round(min(y), 4) + 0.0 AS min_y, round(max(y), 4) + 0.0 AS max_y FROM q GROUP BY mesh_id"""


def _part_spheres(part: DataFrame) -> DataFrame:
    part = part.select(F.col("p_partkey").alias("mesh_id"), F.lit(2.0).alias("radius"), F.col("p_size").cast("int").alias("n"))
    return shapes.sphere_vertices(part).groupBy("mesh_id").agg(F.count("*").alias("n_vert"), (F.round(F.sum(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")), 4) + 0.0).alias("squares"))


def sphere_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_spheres(_table(spark, sf_dir, "part"))


SPHERE_SQL = "SELECT p_partkey AS mesh_id, CAST(4 * p_size * p_size + 2 AS BIGINT) AS n_vert, (4 * (4 * p_size * p_size + 2))::DOUBLE AS squares FROM part"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    at = lambda k: (e[k].cast("double"), e[k + 1].cast("double"))
    return _table(spark, sf_dir, "embeddings").select("vec_id", V.ccw(at(0), at(2), at(4), 0.01).alias("turn"))


_U = "(embedding[3]::DOUBLE - embedding[1]::DOUBLE)", "(embedding[4]::DOUBLE - embedding[2]::DOUBLE)", "(embedding[5]::DOUBLE - embedding[1]::DOUBLE)", "(embedding[6]::DOUBLE - embedding[2]::DOUBLE)"
TURNS_SQL = f"""WITH p AS (SELECT vec_id, {_U[0]}*{_U[3]}-{_U[1]}*{_U[2]} AS area, greatest({_U[0]}*{_U[0]}+{_U[1]}*{_U[1]}, {_U[2]}*{_U[2]}+{_U[3]}*{_U[3]}) AS base FROM embeddings)
SELECT vec_id, CAST(CASE WHEN 4*area*area <= base*0.01::DOUBLE*0.01::DOUBLE THEN 0 WHEN area > 0 THEN 1 ELSE -1 END AS INTEGER) AS turn FROM p"""


def hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the first two elements of the vectors of each label."""
    e = F.col("embedding")
    return spatial.hull_2d(_table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("mesh_id"), e[0].cast("double").alias("x"), e[1].cast("double").alias("y")))


#: A pair of points is a side if no other lies to its right; corners are the starts of sides, in order round their middle.
HULL_SQL = """WITH p AS (SELECT DISTINCT label::BIGINT AS mesh_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
h AS (SELECT DISTINCT a.mesh_id, a.x, a.y FROM p a JOIN p b ON a.mesh_id = b.mesh_id AND (a.x <> b.x OR a.y <> b.y)
  WHERE NOT EXISTS (SELECT 1 FROM p c WHERE c.mesh_id = a.mesh_id AND (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0)),
m AS (SELECT *, avg(x) OVER w AS mx, avg(y) OVER w AS my, count(*) OVER w AS n FROM h WINDOW w AS (PARTITION BY mesh_id)),
g AS (SELECT *, atan2(y - my, x - mx) AS turn FROM m WHERE n >= 3), f AS (SELECT *, first(turn) OVER (PARTITION BY mesh_id ORDER BY x, y) AS start FROM g)
SELECT mesh_id, CAST(row_number() OVER (PARTITION BY mesh_id ORDER BY CASE WHEN turn >= start THEN turn ELSE turn + 2 * pi() END) - 1 AS INTEGER) AS pos, x, y FROM f"""


def convex_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("mesh_id"), F.lit(1.0).alias("radius"), (3 + F.col("p_partkey") % 10).cast("int").alias("segments"))
    return spatial.triangulate_convex(shapes.circle(part))


CONVEX_SQL = """WITH i AS (SELECT p_partkey AS mesh_id, CAST(3 + p_partkey % 10 AS INTEGER) AS n FROM part), t AS (SELECT mesh_id, n, CAST(unnest(range(n - 2)) AS INTEGER) AS tri FROM i)
SELECT mesh_id, tri, CAST((tri + 1) // 2 AS INTEGER) AS v0, CAST(CASE WHEN tri % 2 = 0 THEN tri // 2 + 1 ELSE n - 2 - tri // 2 END AS INTEGER) AS v1, CAST(n - 1 - tri // 2 AS INTEGER) AS v2 FROM t"""


def tetra_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solid_measures(spark, sf_dir, "tetrahedron")


QUERIES = {
    f.__name__: f
    for f in (
        solid_measures, tetra_measures, halfedge_pairing, manifold_check, open_edges, vertex_normals, curvature, affine_transform, sind_cosd, aabb_self_join,
        aabb_overlap_join, box_booleans, morton_codes, components, nation_components, prefix_sums, plane_slices, polygon_areas, sphere_vertices, turns, hulls, convex_triangles,
    )
}

_OPEN = "mesh_id % 5 <> 0 OR tri <> 3"
ORACLE_SQL = {
    "solid_measures": _measures_sql("cube"),
    "tetra_measures": _measures_sql("tetrahedron"),
    "halfedge_pairing": f"WITH {_tri_sql('cube')}, {_EDGES} SELECT e.mesh_id, e.he, e.start_v, e.end_v, o.he AS paired FROM e LEFT JOIN e o ON e.mesh_id = o.mesh_id AND e.start_v = o.end_v AND e.end_v = o.start_v",
    "manifold_check": f"""WITH {_tri_sql("cube").replace("FROM r)", f"FROM r WHERE {_OPEN})")}, {_EDGES}, k AS (SELECT mesh_id, start_v, end_v, count(*) AS n FROM e GROUP BY ALL)
SELECT mesh_id, CAST(sum(n) AS BIGINT) AS n_halfedge, CAST(sum(greatest(n - coalesce(m, 0), 0)) AS BIGINT) AS n_open, CAST(sum(n - 1) AS BIGINT) AS n_duplicate,
  sum(greatest(n - coalesce(m, 0), 0)) = 0 AS is_manifold, sum(greatest(n - coalesce(m, 0), 0)) = 0 AND sum(n - 1) = 0 AS is_2_manifold
FROM k LEFT JOIN (SELECT mesh_id AS i, start_v AS s, end_v AS e, n AS m FROM k) o ON mesh_id = i AND start_v = e AND end_v = s GROUP BY mesh_id""",
    "open_edges": f"""WITH {_tri_sql("cube").replace("FROM r)", f"FROM r WHERE {_OPEN})")}, {_EDGES}
SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM e o WHERE e.mesh_id = o.mesh_id AND e.start_v = o.end_v AND e.end_v = o.start_v)""",
    "vertex_normals": _normals_sql(),
    "curvature": f"SELECT * FROM ({_curvature_sql('cube')}) UNION ALL SELECT * FROM ({_curvature_sql('tetrahedron')})",
    "hulls": HULL_SQL,
    "convex_triangles": CONVEX_SQL,
    "affine_transform": AFFINE_SQL,
    "sind_cosd": SIND_SQL,
    "aabb_self_join": f"WITH {_BOXES} SELECT a.id AS a, b.id AS b FROM b a JOIN b ON a.id < b.id AND {_TOUCH}",
    "aabb_overlap_join": f"WITH {_BOXES}, {_MOVED} SELECT a.id AS a, b.id AS b FROM b a JOIN m b ON {_TOUCH}",
    "box_booleans": BOX_SQL,
    "morton_codes": MORTON_SQL,
    "nation_components": COMPONENTS_SQL,
    "prefix_sums": PREFIX_SQL,
    "plane_slices": f"""WITH {_tri_sql("cube")}, h AS (SELECT *, (CASE WHEN mesh_id % 3 = 0 THEN -1.5 ELSE -0.5 END)::DOUBLE AS h FROM t)
SELECT mesh_id, tri, {", ".join(f"{_cross_sql(up, c)} AS {c}{e}" for e, up in ((0, False), (1, True)) for c in "xy")} FROM h WHERE least(az, bz, cz) <= h AND greatest(az, bz, cz) > h""",
    "polygon_areas": POLYGON_SQL,
    "sphere_vertices": SPHERE_SQL,
    "turns": TURNS_SQL,
}

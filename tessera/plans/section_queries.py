"""Queries of regions of the plane and of solids made from them, and closed forms in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import quality
from tessera.operators import columns, construct, fields, measure, sections, shapes, spatial
from tessera.plans.queries import INSTANCES, _rounded, _table, instances

def _key() -> Column:
    return F.col("p_partkey")
_MEASURES = ["cs_id", "n_vert", "n_contour", "area"]


def _side() -> Column:
    return (4 + F.col("p_size") % 7).cast("double")


def _squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.squares(_table(spark, sf_dir, "part").select(_key().alias("cs_id"), _side().alias("width"), _side().alias("height")))


def _ringed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares with a square hole of a quarter of their side in the middle, contour 1, clockwise."""
    hole = sections.translate(sections.scale(_squares(spark, sf_dir), 0.25, 0.25), 1.0, 1.0)
    return _squares(spark, sf_dir).unionByName(hole.withColumns({"contour": F.lit(1), "pos": 3 - F.col("pos")}))


def _facts(points: DataFrame) -> DataFrame:
    return _rounded(sections.measures(points).select(*_MEASURES), "area")


_PARTS = "s AS (SELECT p_partkey AS cs_id, (4 + p_size % 7)::DOUBLE AS s FROM part)"


def section_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles, moved, turned, mirrored; areas, counts, bounds, convexity."""
    df = sections.mirror(sections.rotate(sections.translate(_ringed(spark, sf_dir), 1.0, 2.0), 90.0), 0.0, 1.0)
    out = sections.measures(df).hint("merge").join(sections.is_convex(_squares(spark, sf_dir)), "cs_id").hint("merge").join(sections.is_convex(df).withColumnRenamed("is_convex", "ring_convex"), "cs_id")
    return _rounded(out, "area", "min_x", "max_x", "min_y", "max_y")


MEASURES_SQL = f"""WITH {_PARTS} SELECT cs_id, round(s*s*15/16, 4) + 0.0 AS area, CAST(8 AS BIGINT) AS n_vert, CAST(2 AS BIGINT) AS n_contour, round(-2-s, 4) + 0.0 AS min_x, (-2.0)::DOUBLE AS max_x,
round(-1-s, 4) + 0.0 AS min_y, (-1.0)::DOUBLE AS max_y, false AS is_empty, true AS is_convex, false AS ring_convex FROM s"""


def section_booleans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares and the same moved: united, taken off or met, one after another along the parts."""
    a = _squares(spark, sf_dir)
    b = sections.translate(a, 2.0, 3.0)
    out = None
    for k, op in enumerate(("add", "subtract", "intersect")):
        mine = F.col("cs_id") % 3 == k
        part = _facts(sections.boolean(a.where(mine), b.where(mine), op)).withColumn("op", F.lit(op))
        out = part if out is None else out.unionByName(part)
    return out


SECTION_SQL = f"""WITH {_PARTS}, c AS (SELECT cs_id, s, (s-2)*(s-3) AS c FROM s) SELECT cs_id, op, CAST(n AS BIGINT) AS n_vert, CAST(1 AS BIGINT) AS n_contour,
round(CASE op WHEN 'add' THEN 2*s*s - c WHEN 'subtract' THEN s*s - c ELSE c END, 4) + 0.0 AS area FROM c JOIN (VALUES (0, 'add', 8), (1, 'subtract', 6), (2, 'intersect', 4)) v(k, op, n) ON cs_id % 3 = k"""


def section_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars of a plus sign as one, the first less the other, or what they share, one after another along the parts."""
    flat = sections.squares(_table(spark, sf_dir, "part").select(_key().alias("cs_id"), (3 * _side()).alias("width"), _side().alias("height")))
    tall = sections.translate(sections.rotate(flat, 90.0), 0.0, 0.0).hint("merge").join(_table(spark, sf_dir, "part").select(_key().alias("cs_id"), _side().alias("s")), "cs_id")
    tall = tall.select("cs_id", "contour", "pos", (F.col("x") + 2 * F.col("s")).alias("x"), (F.col("y") - F.col("s")).alias("y"))
    parts = flat.withColumn("part", F.lit(0)).unionByName(tall.withColumn("part", F.lit(1))).unionByName(flat.withColumn("part", F.lit(2)))
    out = _facts(sections.compose(parts.where("cs_id % 3 = 0"))).withColumn("op", F.lit("add"))
    for k, op in ((1, "subtract"), (2, "intersect")):
        out = out.unionByName(_facts(sections.batch(parts.where(f"part < 2 and cs_id % 3 = {k}"), op)).withColumn("op", F.lit(op)))
    return out


BATCH_SQL = f"""WITH {_PARTS} SELECT cs_id, op, CAST(n AS BIGINT) AS n_vert, CAST(m AS BIGINT) AS n_contour, round(k*s*s, 4) + 0.0 AS area FROM s JOIN (VALUES (0, 'add', 12, 1, 5), (1, 'subtract', 8, 2, 2), (2, 'intersect', 4, 1, 1)) v(i, op, n, m, k) ON cs_id % 3 = i"""


def fill_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square, half of it wound twice and a clockwise one beside it, under one rule after another along the parts."""
    a = _squares(spark, sf_dir)
    half = sections.scale(a, 0.5, 1.0).withColumn("contour", F.lit(1))
    beside = sections.translate(a, -20.0, 0.0).withColumns({"contour": F.lit(2), "pos": 3 - F.col("pos")})
    out = None
    for k, rule in enumerate(("even_odd", "non_zero", "positive", "negative")):
        part = _facts(sections.filled(a.unionByName(half).unionByName(beside).where(F.col("cs_id") % 4 == k), rule)).withColumn("rule", F.lit(rule))
        out = part if out is None else out.unionByName(part)
    return out


FILL_SQL = f"""WITH {_PARTS} SELECT cs_id, rule, CAST(4 * m AS BIGINT) AS n_vert, CAST(m AS BIGINT) AS n_contour, round(k*s*s, 4) + 0.0 AS area FROM s JOIN (VALUES (0, 'even_odd', 2, 1.5::DOUBLE), (1, 'non_zero', 2, 2), (2, 'positive', 1, 1), (3, 'negative', 1, 1)) v(i, rule, m, k) ON cs_id % 4 = i"""


def section_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares grown with one kind of corner after another along the parts, or shrunk."""
    out = None
    for k, (join, delta) in enumerate((("round", 1.0), ("miter", 1.0), ("bevel", 1.0), ("square", 1.0), ("miter", -1.0))):
        part = _facts(sections.offset(_squares(spark, sf_dir).where(F.col("cs_id") % 5 == k), delta, join, segments=16)).withColumns({"join": F.lit(join), "delta": F.lit(delta)})
        out = part if out is None else out.unionByName(part)
    return out


OFFSET_SQL = f"""WITH {_PARTS} SELECT cs_id, j AS "join", d::DOUBLE AS delta, CAST(n AS BIGINT) AS n_vert, CAST(1 AS BIGINT) AS n_contour,
round(s*s + 4*s*d + CASE j WHEN 'round' THEN 8*sin(pi()/8) WHEN 'bevel' THEN 2 WHEN 'square' THEN 8*(sqrt(2)-1) ELSE 4 END, 4) + 0.0 AS area
FROM s JOIN (VALUES (0, 'round', 1.0::DOUBLE, 20), (1, 'miter', 1.0, 4), (2, 'bevel', 1.0, 8), (3, 'square', 1.0, 8), (4, 'miter', -1.0, 4)) v(i, j, d, n) ON cs_id % 5 = i"""


def section_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rings apart, taken apart; each piece is an outer contour with its hole."""
    ring = _ringed(spark, sf_dir)
    both = ring.unionByName(sections.translate(ring, 20.0, 0.0).withColumn("contour", F.col("contour") + 2))
    pieces = sections.decompose(both)
    out = sections.measures(pieces.withColumn("cs_id", F.col("cs_id") * 2 + F.col("piece"))).select("cs_id", "n_vert", "n_contour", "area")
    return _rounded(out, "area")


PIECES_SQL = f"WITH {_PARTS} SELECT cs_id * 2 + k AS cs_id, CAST(8 AS BIGINT) AS n_vert, CAST(2 AS BIGINT) AS n_contour, round(s*s*15/16, 4) + 0.0 AS area FROM s, (VALUES (0), (1)) v(k)"


def section_hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hulls of two squares, squares with a point on a side made simple, moved by an expression or by a function of arrays,
    one after another along the parts."""
    every = _squares(spark, sf_dir)
    a = every.where("cs_id % 4 = 0")
    both = a.unionByName(sections.translate(a, 3.0, 3.0).withColumn("contour", F.lit(1)))
    many = every.where("cs_id % 4 = 1")
    middles = many.unionByName(many.where("pos = 0").withColumns({"pos": F.lit(4), "y": F.lit(1.0)}))
    simple = sections.simplify(middles)
    warped = sections.warp(every.where("cs_id % 4 = 2"), lambda x, y: (x + y / 2, y))
    batch = sections.warp_batch(every.where("cs_id % 4 = 3"), lambda p: p * 2.0)
    out = _facts(sections.hull(both)).withColumn("kind", F.lit("hull"))
    for kind, df in (("simple", simple), ("warp", warped), ("batch", batch)):
        out = out.unionByName(_facts(df).withColumn("kind", F.lit(kind)))
    return out


HULLS_SQL = f"""WITH {_PARTS} SELECT cs_id, kind, CAST(n AS BIGINT) AS n_vert, CAST(1 AS BIGINT) AS n_contour, round(CASE kind WHEN 'hull' THEN s*s + 6*s WHEN 'batch' THEN 4*s*s ELSE s*s END, 4) + 0.0 AS area
FROM s JOIN (VALUES (0, 'hull', 6), (1, 'simple', 4), (2, 'warp', 4), (3, 'batch', 4)) v(i, kind, n) ON cs_id % 4 = i"""


def triangulations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares with a hole, cut into triangles: how many, their area, and whether sides and turns are right."""
    ring = _ringed(spark, sf_dir)
    tris = sections.triangulate(ring)
    check = sections.check_triangulation(ring, tris)
    return check.hint("merge").join(tris.groupBy("cs_id").agg(F.count("*").alias("n_tri")), "cs_id")


TRIANGULATE_SQL = "SELECT p_partkey AS cs_id, true AS edges_match, true AS all_left, CAST(8 AS BIGINT) AS n_tri FROM part"


def contour_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sides of contours, and how many contours a region's nested form has."""
    ring = _ringed(spark, sf_dir)
    return sections.edges(ring).hint("merge").join(sections.polygons(ring).select("cs_id", F.size("polygons").alias("n_polygons")), "cs_id")


EDGES_SQL = """SELECT p_partkey AS cs_id, CAST(c AS INTEGER) AS contour, CAST(k AS INTEGER) AS pos, CAST(4*c + CASE WHEN c = 0 THEN k ELSE k END AS BIGINT) AS start_v, CAST(4*c + (k + 1) % 4 AS BIGINT) AS end_v, CAST(2 AS INTEGER) AS n_polygons
FROM part, (VALUES (0), (1)) a(c), (VALUES (0), (1), (2), (3)) b(k)"""


# ---- solids of contours


def _solid_facts(tris: DataFrame) -> DataFrame:
    return _rounded(measure.measures(tris).select("mesh_id", "n_tri", "n_vert", "genus", "volume", "area"), "volume", "area")


def ring_extrusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares with a hole as prisms of several layers, and as cones with two tips."""
    key = F.col("cs_id")
    knobs = {"height": (1.0 + key % 5), "divisions": F.when(key % 2 == 0, (key % 3).cast("int")).otherwise(0), "twist": F.lit(0.0), "scale_x": F.when(key % 2 == 0, 1.0).otherwise(0.0), "scale_y": F.when(key % 2 == 0, 1.0).otherwise(0.0)}
    return _solid_facts(construct.extrude(_ringed(spark, sf_dir).withColumns(knobs))).drop("area")


RING_SQL = f"""WITH {_PARTS}, d AS (SELECT *, cs_id % 2 = 0 AS prism, 1 + cs_id % 5 AS h, CASE WHEN cs_id % 2 = 0 THEN 1 + cs_id % 3 ELSE 1 END AS k FROM s)
SELECT cs_id AS mesh_id, CAST(CASE WHEN prism THEN 16*k + 16 ELSE 16 END AS BIGINT) AS n_tri, CAST(CASE WHEN prism THEN 8*(k+1) ELSE 10 END AS BIGINT) AS n_vert, CAST(CASE WHEN prism THEN 1 ELSE 0 END AS BIGINT) AS genus,
round(s*s*15/16*h / CASE WHEN prism THEN 1 ELSE 3 END, 4) + 0.0 AS volume FROM d"""


def axis_revolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares of which half lies left of the axis, turned fully or in part: cylinders and wedges of them."""
    key = F.col("cs_id")
    df = _squares(spark, sf_dir).hint("merge").join(_table(spark, sf_dir, "part").select(_key().alias("cs_id"), _side().alias("s")), "cs_id")
    df = df.select("cs_id", "contour", "pos", (F.col("x") - F.col("s") / 2).alias("x"), "y", (4 + key % 5).cast("int").alias("segments"), F.when(key % 2 == 0, 360.0).otherwise(90.0).alias("degrees"))
    return _solid_facts(construct.revolve(df))


AXIS_SQL = f"""WITH {_PARTS}, d AS (SELECT *, s/2 AS r, 4 + cs_id % 5 AS n, cs_id % 2 = 0 AS whole, radians(CASE WHEN cs_id % 2 = 0 THEN 360 ELSE 90 END) AS a FROM s)
SELECT cs_id AS mesh_id, CAST(CASE WHEN whole THEN 4*n ELSE 4*n + 4 END AS BIGINT) AS n_tri, CAST(CASE WHEN whole THEN 2*n + 2 ELSE 2*n + 4 END AS BIGINT) AS n_vert, CAST(0 AS BIGINT) AS genus,
round(s * n/2.0::DOUBLE * r*r*sin(a/n), 4) + 0.0 AS volume, round(n*r*r*sin(a/n) + n*s*2*r*sin(a/n/2) + CASE WHEN whole THEN 0 ELSE 2*s*r END, 4) + 0.0 AS area FROM d"""


def cylinders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cylinders, frusta and cones, segments given or by the quality settings."""
    part = _table(spark, sf_dir, "part")
    r = F.col("p_size").cast("double") / 3
    df = part.select(_key().alias("mesh_id"), (1.0 + _key() % 4).alias("height"), r.alias("radius_low"), F.when(_key() % 3 == 0, -1.0).when(_key() % 3 == 1, 0.0).otherwise(r / 2).alias("radius_high"), F.when(_key() % 2 == 0, 5).otherwise(0).alias("segments"))
    facts = measure.measures(construct.cylinders(df, center=True))
    return _rounded(facts.select("mesh_id", "n_tri", "n_vert", "genus", "volume", F.round("min_z", 4).alias("low")), "volume")


CYLINDER_SQL = """WITH p AS (SELECT p_partkey AS mesh_id, p_partkey AS k, p_size / 3.0::DOUBLE AS r, 1 + p_partkey % 4 AS h FROM part), q AS (SELECT *, CAST(least(36, floor(2 * pi() * r)) AS INTEGER) + 3 AS m, CASE k % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0 ELSE 0.5 END AS t FROM p),
n AS (SELECT *, CASE WHEN k % 2 = 0 THEN 5 ELSE greatest(m - m % 4, 4) END AS n FROM q)
SELECT mesh_id, CAST(CASE WHEN t = 0 THEN 2*n - 2 ELSE 4*n - 4 END AS BIGINT) AS n_tri, CAST(CASE WHEN t = 0 THEN n + 1 ELSE 2*n END AS BIGINT) AS n_vert, CAST(0 AS BIGINT) AS genus,
round(n/2.0::DOUBLE*sin(2*pi()/n)*r*r*h*(1+t+t*t)/3, 4) + 0.0 AS volume, round(-h/2.0::DOUBLE, 4) AS low FROM n"""


def centred_cubes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes round the origin; some sides are below 0, which gives none."""
    part = _table(spark, sf_dir, "part").select(_key().alias("mesh_id"), F.when(_key() % 7 == 0, -1.0).otherwise(F.col("p_size").cast("double")).alias("sx"), F.lit(2.0).alias("sy"), F.lit(3.0).alias("sz"))
    df = measure.measures(construct.cubes(part, center=True))
    return _rounded(df.select("mesh_id", "n_tri", "n_vert", "volume", "min_x", "max_x", "min_z", "max_z"), "volume", "min_x", "max_x", "min_z", "max_z")


CENTRED_SQL = "SELECT p_partkey AS mesh_id, CAST(12 AS BIGINT) AS n_tri, CAST(8 AS BIGINT) AS n_vert, p_size * 6.0::DOUBLE AS volume, -p_size / 2.0::DOUBLE AS min_x, p_size / 2.0::DOUBLE AS max_x, (-1.5)::DOUBLE AS min_z, 1.5::DOUBLE AS max_z FROM part WHERE p_partkey % 7 <> 0"


def octahedra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _solid_facts(construct.octahedra(instances(spark, sf_dir))).drop("area")


OCTA_SQL = f"WITH {INSTANCES} SELECT mesh_id, CAST(8 AS BIGINT) AS n_tri, CAST(6 AS BIGINT) AS n_vert, CAST(0 AS BIGINT) AS genus, round(abs(sx*sy*sz)*4/3, 4) + 0.0 AS volume FROM i"


def slice_contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts of cubes by a level plane, and what cubes cover from above, as contours."""
    cubes = shapes.triangles(instances(spark, sf_dir))
    cut = construct.slices(cubes.withColumn("height", F.when(F.col("mesh_id") % 3 == 0, -1.5).otherwise(-0.5)))
    return _facts(cut).withColumn("kind", F.lit("slice")).unionByName(_facts(construct.project(cubes)).withColumn("kind", F.lit("project")))


SLICE_SQL = f"""WITH {INSTANCES} SELECT mesh_id AS cs_id, kind, CAST(4 AS BIGINT) AS n_vert, CAST(1 AS BIGINT) AS n_contour, round(abs(sx*sy), 4) + 0.0 AS area FROM i, (VALUES ('slice'), ('project')) v(kind)"""


def length_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges parted to a length: the same solid, closed, with so many vertices on the edges of the box."""
    part = _table(spark, sf_dir, "part").select(_key().alias("mesh_id"), F.lit(1.0).alias("sx"), (1.0 + _key() % 2).alias("sy"), F.lit(0.5).alias("sz"))
    tris = construct.refine_to_length(construct.cubes(part), 0.4)
    side = {"x": F.lit(1.0), "y": 1.0 + F.col("mesh_id") % 2, "z": F.lit(0.5)}
    outer = sum((((F.abs(F.col(c)) < 1e-9) | (F.abs(F.col(c) - s) < 1e-9)).cast("int") for c, s in side.items()), F.lit(0))
    on_edges = fields.vertices(tris).groupBy("mesh_id").agg(F.count_if(outer >= 2).alias("n_on_edges"))
    return _solid_facts(tris).drop("n_tri", "n_vert").hint("merge").join(on_edges, "mesh_id")


LENGTH_SQL = "SELECT p_partkey AS mesh_id, CAST(0 AS BIGINT) AS genus, (1 + p_partkey % 2) * 0.5::DOUBLE AS volume, round(2.0::DOUBLE * ((1 + p_partkey % 2) * 1.5 + 0.5), 4) AS area, CAST(20 + CASE WHEN p_partkey % 2 = 0 THEN 8 ELSE 20 END AS BIGINT) AS n_on_edges FROM part"


def quality_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circle segments under other settings, and after they are reset."""
    part = _table(spark, sf_dir, "part").select(_key())
    quality.set_min_circular_angle(6.0)
    quality.set_min_circular_edge_length(0.5)
    fine = quality.circular_segments(10.0)
    quality.set_circular_segments(7)
    fixed = quality.circular_segments(10.0)
    quality.set_min_circular_angle(-1.0)
    quality.reset_to_defaults()
    return part.select("p_partkey", F.lit(fine).alias("fine"), F.lit(fixed).alias("fixed"), F.lit(quality.circular_segments(10.0)).alias("usual"))


QUALITY_SQL = "SELECT p_partkey, CAST(60 AS INTEGER) AS fine, CAST(7 AS INTEGER) AS fixed, CAST(36 AS INTEGER) AS usual FROM part"


def points_in_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in rectangles round others, by their first two elements."""
    e = F.col("embedding")
    dots = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), e[0].cast("double").alias("x"), e[1].cast("double").alias("y"))
    rects = dots.select("id", *((F.col(k) + s * 0.01).alias(f"{n}_{k}") for n, s in (("lo", -1), ("hi", 1)) for k in "xy"))
    return spatial.points_in_rects(rects, dots)


RECTS_SQL = """WITH p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)
SELECT a.id, b.id AS point FROM p a JOIN p b ON b.x >= a.x + (-0.01::DOUBLE) AND b.x <= a.x + 0.01::DOUBLE AND b.y >= a.y + (-0.01::DOUBLE) AND b.y <= a.y + 0.01::DOUBLE"""


def morton_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of each label in the order of their Morton codes."""
    e = F.col("embedding")
    points = _table(spark, sf_dir, "embeddings").select(F.col("label").alias("mesh_id"), F.col("vec_id").alias("vert"), *(e[k].cast("double").alias(c) for k, c in enumerate("xyz")))
    return columns.morton_order(points, ((-1.0,) * 3, (1.0,) * 3)).select("mesh_id", "vert", "code", "rank")


def _morton_sql() -> str:
    from tessera.plans.queries import MORTON_SQL

    return f"WITH c AS ({MORTON_SQL}) SELECT label AS mesh_id, vec_id AS vert, code, CAST(row_number() OVER (PARTITION BY label ORDER BY code, vec_id) - 1 AS BIGINT) AS rank FROM c JOIN embeddings USING (vec_id)"


QUERIES = {
    f.__name__: f
    for f in (
        section_measures, section_booleans, section_batch, fill_rules, section_offsets, section_pieces, section_hulls, triangulations, contour_edges, ring_extrusions, axis_revolutions, cylinders, centred_cubes, octahedra,
        slice_contours, length_refinement, quality_segments, points_in_rects, morton_order,
    )
}
ORACLE_SQL = {
    "section_measures": MEASURES_SQL,
    "section_booleans": SECTION_SQL,
    "section_batch": BATCH_SQL,
    "fill_rules": FILL_SQL,
    "section_offsets": OFFSET_SQL,
    "section_pieces": PIECES_SQL,
    "section_hulls": HULLS_SQL,
    "triangulations": TRIANGULATE_SQL,
    "contour_edges": EDGES_SQL,
    "ring_extrusions": RING_SQL,
    "axis_revolutions": AXIS_SQL,
    "cylinders": CYLINDER_SQL,
    "centred_cubes": CENTRED_SQL,
    "octahedra": OCTA_SQL,
    "slice_contours": SLICE_SQL,
    "length_refinement": LENGTH_SQL,
    "quality_segments": QUALITY_SQL,
    "points_in_rects": RECTS_SQL,
    "morton_order": _morton_sql(),
}

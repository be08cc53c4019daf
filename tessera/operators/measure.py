"""Aggregates of solids given as triangles (mesh_id, tri, v0..v2, ax..cz): partial sums first, then one row a solid.

Rows with a null mesh_id are one solid of their own; an empty table gives no rows; a triangle row that comes twice
counts twice; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import Vec, cross, dot, length, sub, vec

MIN_COLUMNS, MAX_COLUMNS = [f"min_{c}" for c in "xyz"], [f"max_{c}" for c in "xyz"]
_CORNERS = (("v0", "a"), ("v1", "b"), ("v2", "c"))


def _normal() -> Vec:
    """Twice the area, along the face normal."""
    return cross(sub(vec("b"), vec("a")), sub(vec("c"), vec("a")))


def measures(tris: DataFrame) -> DataFrame:
    """Counts, signed volume, area, bounds and genus of each solid. Vertices are counted, whatever their numbers.

    Each corner is a row, the first one with the triangle's share, so one pass sums up the triangles and counts the
    vertices; coordinates that are not finite numbers are left out of the bounds.
    """
    n = _normal()
    df = tris.select("mesh_id", "v0", "v1", "v2", *(p + c for p in "abc" for c in "xyz"), (dot(n, vec("a")) / 6).alias("volume"), (length(n) / 2).alias("area"))
    zero = F.lit(0.0)
    corner = [
        F.struct(
            F.col(v).cast("long").alias("vert"), *(F.nanvl(F.col(p + c), F.lit(None).cast("double")).alias(c) for c in "xyz"),
            (zero if k else F.col("volume")).alias("volume"), (zero if k else F.col("area")).alias("area"), F.lit(0 if k else 1).cast("long").alias("tri"),
        )
        for k, (v, p) in enumerate(_CORNERS)
    ]
    rows = df.select("mesh_id", F.explode(F.array(*corner)).alias("p")).select("mesh_id", "p.*")
    sums = [F.sum(c).alias(c) for c in ("volume", "area", "tri")]
    per_vert = rows.groupBy("mesh_id", "vert").agg(*sums, *(f(c).alias(f"{k}_{c}") for k, f in (("min", F.min), ("max", F.max)) for c in "xyz"))
    bounds = [F.min(f"min_{c}").alias(f"min_{c}") for c in "xyz"] + [F.max(f"max_{c}").alias(f"max_{c}") for c in "xyz"]
    per_mesh = per_vert.groupBy("mesh_id").agg(F.sum("tri").alias("n_tri"), F.sum("volume").alias("volume"), F.sum("area").alias("area"), *bounds, F.count("*").alias("n_vert"))
    return per_mesh.withColumn("n_edge", F.expr("3 * n_tri div 2")).withColumn("genus", F.expr("1 - (n_vert - n_edge + n_tri) div 2"))


def vertex_normals(tris: DataFrame) -> DataFrame:
    """mesh_id, vert, nx, ny, nz: face normals weighted by the angle at the vertex; degenerate faces count as up."""
    corners = [("v0", "a", "b", "c"), ("v1", "b", "c", "a"), ("v2", "c", "a", "b")]
    n = cross(sub(vec("b"), vec("a")), sub(vec("c"), vec("a")))
    df = tris.withColumns({f"n{k}": v for k, v in zip("xyz", n, strict=True)}).withColumn("l", length(vec("n")))
    unit = [F.when(F.col("l") > 0, F.col(f"n{k}") / F.col("l")).otherwise(F.lit(1.0 if k == "z" else 0.0)) for k in "xyz"]

    def angle(p, q, r):
        u, v = sub(vec(q), vec(p)), sub(vec(r), vec(p))
        return F.acos(F.least(F.greatest(dot(u, v) / (length(u) * length(v)), F.lit(-1.0)), F.lit(1.0)))

    parts = F.array(*(F.struct(F.col(v).alias("vert"), angle(p, q, r).alias("w")) for v, p, q, r in corners))
    df = df.select("mesh_id", *(u.alias(f"u{k}") for u, k in zip(unit, "xyz", strict=True)), F.explode(parts).alias("p"))
    sums = df.groupBy("mesh_id", F.col("p.vert").alias("vert")).agg(*(F.sum(F.col("p.w") * F.col(f"u{k}")).alias(f"s{k}") for k in "xyz"), F.sum("p.w").alias("angles"))
    size = length(vec("s"))
    return sums.select("mesh_id", "vert", *(F.when(size > 0, F.col(f"s{k}") / size).otherwise(0.0).alias(f"n{k}") for k in "xyz"), "angles")


def curvature(tris: DataFrame) -> DataFrame:
    """mesh_id, vert, gauss, mean of closed solids in which two faces meet at every edge.

    Gauss: 2 pi less the angles around a vertex; mean: for each half-edge, a quarter of its length times the dihedral
    angle, at both its ends. Both are scaled by degree / (6 * a third of the area around the vertex).
    """
    n = _normal()
    df = tris.withColumns({f"n{k}": v for k, v in zip("xyz", n, strict=True)}).withColumn("l", length(vec("n")))
    df = df.withColumns({f"u{k}": F.try_divide(F.col(f"n{k}"), F.col("l")) for k in "xyz"})

    def angle(p: str, q: str, r: str) -> Column:
        u, v = sub(vec(q), vec(p)), sub(vec(r), vec(p))
        return F.acos(F.least(F.greatest(F.try_divide(dot(u, v), length(u) * length(v)), F.lit(-1.0)), F.lit(1.0)))

    corners = F.array(*(F.struct(F.col(v).alias("vert"), angle(p, q, r).alias("angle")) for v, p, q, r in (("v0", "a", "b", "c"), ("v1", "b", "c", "a"), ("v2", "c", "a", "b"))))
    faces = df.select("mesh_id", (F.col("l") / 6).alias("third"), F.explode(corners).alias("p"))
    faces = faces.select("mesh_id", "p.vert", "p.angle", "third", F.lit(1.0).alias("degree"), F.lit(0.0).alias("bend"))
    sides = F.array(*(F.struct(F.col(s).alias("s"), F.col(e).alias("e"), *(F.col(q + k) - F.col(p + k) for k in "xyz")) for s, e, p, q in (("v0", "v1", "a", "b"), ("v1", "v2", "b", "c"), ("v2", "v0", "c", "a"))))
    edge = df.select("mesh_id", "ux", "uy", "uz", F.explode(sides).alias("h")).select("mesh_id", "ux", "uy", "uz", F.col("h.s").alias("s"), F.col("h.e").alias("e"), *(F.col(f"h.col{k}").alias(f"d{c}") for k, c in enumerate("xyz", 3)))
    forward = F.col("s") < F.col("e")
    both = edge.groupBy("mesh_id", F.least("s", "e").alias("lo"), F.greatest("s", "e").alias("hi")).agg(
        *(F.max(F.when(forward, F.col(f"{g}{c}"))).alias(f"{g}{c}") for g in "ud" for c in "xyz"), *(F.max(F.when(~forward, F.col(f"u{c}"))).alias(f"w{c}") for c in "xyz")
    )
    size = length(vec("d"))
    sine = F.try_divide(dot(cross(vec("u"), vec("w")), vec("d")), size)
    bend = 0.5 * size * F.asin(F.least(F.greatest(sine, F.lit(-1.0)), F.lit(1.0)))  # both half-edges
    ends = both.select("mesh_id", F.explode(F.array("lo", "hi")).alias("vert"), bend.alias("bend")).select("mesh_id", "vert", *(F.lit(0.0).alias(c) for c in ("angle", "third", "degree")), "bend")
    total = faces.unionByName(ends).groupBy("mesh_id", "vert").agg(*(F.sum(c).alias(c) for c in ("angle", "third", "degree", "bend")))
    factor = F.try_divide(F.col("degree"), 6 * F.col("third"))
    return total.select("mesh_id", "vert", ((F.lit(2 * 3.141592653589793) - F.col("angle")) * factor).alias("gauss"), (F.col("bend") * factor).alias("mean"))


def polygon_measures(points: DataFrame) -> DataFrame:
    """mesh_id, signed area (shoelace), n and bounds of contours (mesh_id, pos, x, y)."""
    ring = Window.partitionBy("mesh_id").orderBy("pos")
    whole = Window.partitionBy("mesh_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = {c: F.coalesce(F.lead(c).over(ring), F.first(c).over(whole)) for c in "xy"}
    df = points.select("mesh_id", "x", "y", nxt["x"].alias("qx"), nxt["y"].alias("qy"))
    area = F.sum(F.col("x") * F.col("qy") - F.col("y") * F.col("qx")) / 2
    return df.groupBy("mesh_id").agg(F.count("*").alias("n"), area.alias("area"), *(f(c).alias(f"{k}_{c}") for k, f in (("min", F.min), ("max", F.max)) for c in "xy"))


def checks(tris: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """mesh_id, triangles at finite places whose corners lie within ``tolerance`` of a line (seen along the main axis of
    their normal), whether all corners are finite, whether all numbers are from 0 to the most there can be, and how many are used."""
    a, b, c = vec("a"), vec("b"), vec("c")
    u, v, n = sub(b, a), sub(c, a), _normal()
    size = [F.abs(x) for x in n]
    main = F.when((size[2] >= size[0]) & (size[2] >= size[1]), 2).when(size[1] >= size[0], 1).otherwise(0)
    flat = lambda w, k: dot(w, w) - w[k] * w[k]
    base = F.when(main == 2, F.greatest(flat(u, 2), flat(v, 2))).when(main == 1, F.greatest(flat(u, 1), flat(v, 1))).otherwise(F.greatest(flat(u, 0), flat(v, 0)))
    most = F.greatest(*size)
    colinear = 4 * most * most <= base * tolerance * tolerance
    finite = F.lit(True)
    for p in "abc":
        for k in "xyz":
            finite = finite & (F.abs(F.col(p + k)) < float("inf"))
    # each corner is a row, the first one with what holds of the triangle, so one pass finds both
    rows = tris.select("mesh_id", (colinear & finite).alias("flat"), F.coalesce(finite, F.lit(False)).alias("finite"), F.array("v0", "v1", "v2").alias("vs"))
    rows = rows.select("mesh_id", "flat", "finite", F.posexplode("vs").alias("k", "v"))
    per_vert = rows.groupBy("mesh_id", "v").agg(F.count_if(F.col("flat") & (F.col("k") == 0)).alias("flat"), F.min("finite").alias("finite"))
    sums = per_vert.groupBy("mesh_id").agg(F.sum("flat").alias("n_degenerate"), F.min("finite").alias("is_finite"), F.count("*").alias("n_used"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    return sums.select("mesh_id", "n_degenerate", "is_finite", ((F.col("lo") >= 0) & (F.col("hi") < F.col("n_used"))).alias("is_dense"), "n_used")


def matches_normals(tris: DataFrame, tolerance: float) -> DataFrame:
    """mesh_id, whether every triangle turns left, within ``tolerance``, about the normal (nx, ny, nz) that it carries."""
    from tessera.functions.linalg import projected
    from tessera.functions.vectors import ccw

    flat = [projected(vec("n"), vec(p)) for p in "abc"]
    return tris.groupBy("mesh_id").agg(F.min(ccw(*flat, tolerance) >= 0).alias("matches_normals"))


def longest_of_degenerate(tris: DataFrame, tolerance: float) -> DataFrame:
    """mesh_id, he: the longest side of every triangle whose corners lie within ``tolerance`` of a line, which a swap would
    take away."""
    from tessera.functions.linalg import argmax, projected
    from tessera.functions.vectors import ccw

    n = _normal()
    flat = [projected(n, vec(p)) for p in "abc"]
    sizes = [dot(sub(vec(q), vec(p)), sub(vec(q), vec(p))) for p, q in ("ab", "bc", "ca")]
    return tris.where(ccw(*flat, tolerance) == 0).select("mesh_id", (3 * F.col("tri") + argmax(sizes)).cast("long").alias("he"))


def transform_normals(normals: DataFrame, matrix: list[float]) -> DataFrame:
    """``normals`` (.., nx, ny, nz) of a solid under a 3x4 row-major matrix: by the inverse transpose, of unit length; null
    where the matrix has no inverse."""
    from tessera.functions.linalg import apply, inverse, transpose, unit

    m = tuple(tuple(F.lit(float(matrix[4 * r + c])) for c in range(3)) for r in range(3))
    moved = unit(apply(transpose(inverse(m)), vec("n")))
    return normals.withColumns({f"n{c}": v for c, v in zip("xyz", moved, strict=True)})

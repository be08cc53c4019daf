"""Regions of the plane as rows: contour_point (cs_id, contour, pos, x, y); counter-clockwise contours are outer ones.

Fill rules, booleans, offsets and triangulations take one group a cs_id (``kernels.plane``); measures and moves are plain
expressions. Points with a null or infinite coordinate are left out, contours of fewer than three points have no area and
go; repeated points on a contour change nothing; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import cosd, sind
from tessera.kernels import plane
from tessera.operators.groups import NULL, each_group

POINTS = "cs_id long, contour int, pos int, x double, y double"


def _rows(cs_id, contours) -> pd.DataFrame:
    rows = [(c, k, *p) for c, ring in enumerate(contours) for k, p in enumerate(ring)]
    out = pd.DataFrame(rows, columns=["contour", "pos", "x", "y"]).astype({"contour": "int32", "pos": "int32", "x": float, "y": float})
    out.insert(0, "cs_id", pd.array([cs_id] * len(rows), "Int64"))
    return out


def _contours(frame: pd.DataFrame) -> list[list[tuple[float, float]]]:
    frame = frame[np.isfinite(frame["x"]) & np.isfinite(frame["y"])].sort_values(["contour", "pos"])
    return [list(zip(g["x"].tolist(), g["y"].tolist(), strict=True)) for _, g in frame.groupby("contour", sort=True)]


def _rings(contour: np.ndarray, at: np.ndarray) -> list[list[tuple[float, float]]]:
    """The same of sorted rows, given as arrays."""
    good = np.isfinite(at).all(axis=1) & (contour != NULL)
    contour, at = contour[good], at[good]
    parts = np.split(at, np.flatnonzero(contour[1:] != contour[:-1]) + 1) if len(at) else []
    return [list(map(tuple, p.tolist())) for p in parts]


def _plain(points: DataFrame, *more: str) -> DataFrame:
    return points.select(F.col("cs_id").cast("long"), F.col("contour").cast("int"), F.col("pos").cast("int"), F.col("x").cast("double"), F.col("y").cast("double"), *more)


def _each(points: DataFrame, f: Callable[[list], list]) -> DataFrame:
    return _plain(points).groupBy("cs_id").applyInPandas(lambda key, frame: _rows(key[0], f(_contours(frame))), POINTS)


# ---- generators


def squares(instances: DataFrame, center: bool = False) -> DataFrame:
    """Rectangles per row (cs_id, width, height); a side below 0, or both 0, gives none."""
    shift = 0.5 if center else 0.0
    corners = F.array(*(F.struct(F.lit(k).alias("pos"), ((x - shift) * F.col("width")).alias("x"), ((y - shift) * F.col("height")).alias("y")) for k, (x, y) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))))
    good = (F.col("width") >= 0) & (F.col("height") >= 0) & (F.col("width") + F.col("height") > 0)
    return instances.where(good).select("cs_id", F.lit(0).alias("contour"), F.explode(corners).alias("p")).select("cs_id", "contour", "p.*")


def rectangles(rects: DataFrame) -> DataFrame:
    """Of rows (cs_id, lo_x, lo_y, hi_x, hi_y)."""
    ends = (("lo", "lo"), ("hi", "lo"), ("hi", "hi"), ("lo", "hi"))
    corners = F.array(*(F.struct(F.lit(k).alias("pos"), F.col(f"{i}_x").alias("x"), F.col(f"{j}_y").alias("y")) for k, (i, j) in enumerate(ends)))
    return rects.select("cs_id", F.lit(0).alias("contour"), F.explode(corners).alias("p")).select("cs_id", "contour", "p.*")


def filled(points: DataFrame, rule: str = "positive") -> DataFrame:
    """Contours of what a fill rule (even_odd, non_zero, positive, negative) takes as inside."""
    return _each(points, lambda c: plane.filled(c, rule))


# ---- moves


def transform(points: DataFrame, matrix: list[Column | float]) -> DataFrame:
    """Under a 2x3 row-major matrix; contours are turned over where its determinant is negative."""
    m = [F.lit(x) if not isinstance(x, Column) else x for x in matrix]
    det = m[0] * m[4] - m[1] * m[3]
    last = F.max("pos").over(Window.partitionBy("cs_id", "contour"))
    moved = points.withColumns({"_x": m[0] * F.col("x") + m[1] * F.col("y") + m[2], "_y": m[3] * F.col("x") + m[4] * F.col("y") + m[5], "_pos": F.when(det < 0, last - F.col("pos")).otherwise(F.col("pos"))})
    return moved.select("cs_id", "contour", F.col("_pos").cast("int").alias("pos"), F.col("_x").alias("x"), F.col("_y").alias("y"))


def translate(points: DataFrame, x, y) -> DataFrame:
    return transform(points, [1.0, 0.0, x, 0.0, 1.0, y])


def scale(points: DataFrame, x, y) -> DataFrame:
    return transform(points, [x, 0.0, 0.0, 0.0, y, 0.0])


def rotate(points: DataFrame, degrees) -> DataFrame:
    """Counter-clockwise; exact at multiples of 90."""
    d = degrees if isinstance(degrees, Column) else F.lit(float(degrees))
    return transform(points, [cosd(d), -sind(d), 0.0, sind(d), cosd(d), 0.0])


def mirror(points: DataFrame, x: float, y: float) -> DataFrame:
    """In the line through the origin with normal (x, y); no rows if that has no length."""
    size = x * x + y * y
    if size == 0:
        return points.where("false")
    return transform(points, [1 - 2 * x * x / size, -2 * x * y / size, 0.0, -2 * x * y / size, 1 - 2 * y * y / size, 0.0])


def warp(points: DataFrame, f: Callable[[Column, Column], tuple[Column, Column]]) -> DataFrame:
    """Every point moved by ``f``, then what the positive rule takes as inside."""
    x, y = f(F.col("x"), F.col("y"))
    return filled(points.withColumns({"x": x, "y": y}))


def warp_batch(points: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The same with a function of arrays (n, 2)."""

    def moved(frames):
        for frame in frames:
            at = f(frame[["x", "y"]].to_numpy(float))
            yield frame.assign(x=at[:, 0], y=at[:, 1])

    return filled(_plain(points).mapInPandas(moved, POINTS))


# ---- set operations


def boolean(left: DataFrame, right: DataFrame, op: str) -> DataFrame:
    """Union ("add"), difference ("subtract") or intersection ("intersect") of the regions of each cs_id."""

    def run(key, a, b):
        return _rows(key[0], plane.boolean(_contours(a), _contours(b), op))

    return _plain(left).groupBy("cs_id").cogroup(_plain(right).groupBy("cs_id")).applyInPandas(run, POINTS)


def batch(parts: DataFrame, op: str) -> DataFrame:
    """One boolean of all regions of each cs_id, in the order of their column ``part``."""

    def run(key, frame):
        return _rows(key[0], plane.batch([_contours(g) for _, g in frame.groupby("part", sort=True)], op))

    return _plain(parts, F.col("part").cast("long")).groupBy("cs_id").applyInPandas(run, POINTS)


def compose(parts: DataFrame) -> DataFrame:
    """The union of all regions of each cs_id."""
    return batch(parts, "add")


def decompose(points: DataFrame) -> DataFrame:
    """``points`` by outer contour: ``piece`` numbers each with its holes; islands in holes are pieces of their own."""

    def run(whole, real):
        rows = [(c, k, *p, piece) for piece, group in enumerate(plane.pieces(_rings(whole[:, 0], real))) for c, ring in enumerate(group) for k, p in enumerate(ring)]
        return tuple(zip(*rows, strict=True)) if rows else ((),) * 5

    return each_group(_plain(points), "cs_id", ["contour", "pos"], ["contour"], ["x", "y"], run, POINTS + ", piece int", ("pieces",))


def hull(points: DataFrame) -> DataFrame:
    """Convex hull of all points of each cs_id, of one region or several."""
    return _each(points, lambda c: [h] if (h := plane.hull([p for ring in c for p in ring])) else [])


def offset(points: DataFrame, delta: float, join: str = "round", miter: float = 2.0, segments: int = 0) -> DataFrame:
    """Regions grown by ``delta`` (shrunk if negative); corners are joined round, square, miter or bevel. Without
    ``segments`` a circle of that radius has as many as the quality settings say."""
    from tessera.functions import quality

    n = segments if segments > 2 else quality.circular_segments(abs(delta))
    return _each(points, lambda c: plane.offset(c, delta, join, miter, n))


def simplify(points: DataFrame, epsilon: float = 1e-6) -> DataFrame:
    return _each(points, lambda c: plane.simplify(plane.filled(c), epsilon))


# ---- measures


def measures(points: DataFrame) -> DataFrame:
    """cs_id, area (holes taken off), n_vert, n_contour, is_empty and bounds."""
    ring = Window.partitionBy("cs_id", "contour").orderBy("pos")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = {c: F.coalesce(F.lead(c).over(ring), F.first(c).over(whole)) for c in "xy"}
    df = points.select("cs_id", "contour", "x", "y", nxt["x"].alias("qx"), nxt["y"].alias("qy"))
    per = df.groupBy("cs_id", "contour").agg(F.sum(F.col("x") * F.col("qy") - F.col("y") * F.col("qx")).alias("twice"), F.count("*").alias("n"), *(f(c).alias(f"{k}_{c}") for k, f in (("min", F.min), ("max", F.max)) for c in "xy"))
    out = per.groupBy("cs_id").agg((F.sum("twice") / 2).alias("area"), F.sum("n").alias("n_vert"), F.count("*").alias("n_contour"), *(f(f"{k}_{c}").alias(f"{k}_{c}") for k, f in (("min", F.min), ("max", F.max)) for c in "xy"))
    return out.withColumn("is_empty", (F.col("max_x") <= F.col("min_x")) | (F.col("max_y") <= F.col("min_y")))


def is_convex(points: DataFrame) -> DataFrame:
    """cs_id, is_convex: one contour, every corner a left turn; points on a line do not count as convex."""
    ring = Window.partitionBy("cs_id", "contour").orderBy("pos")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = {}
    for c in "xy":
        near[f"q{c}"] = F.coalesce(F.lead(c).over(ring), F.first(c).over(whole))
        near[f"p{c}"] = F.coalesce(F.lag(c).over(ring), F.last(c).over(whole))
    df = points.select("cs_id", "contour", "x", "y", *(v.alias(k) for k, v in near.items()))
    turn = (F.col("x") - F.col("px")) * (F.col("qy") - F.col("py")) - (F.col("y") - F.col("py")) * (F.col("qx") - F.col("px"))
    df = df.select("cs_id", "contour", turn.alias("turn"), (F.col("x") * F.col("qy") - F.col("y") * F.col("qx")).alias("twice"))
    out = df.groupBy("cs_id").agg(F.min("turn").alias("least"), F.sum("twice").alias("twice"), F.count_distinct("contour").alias("n"), F.count("*").alias("points"))
    return out.select("cs_id", ((F.col("least") > 0) & (F.col("twice") > 0) & (F.col("n") == 1) & (F.col("points") >= 3)).alias("is_convex"))


def polygons(points: DataFrame) -> DataFrame:
    """cs_id, polygons: contours as nested arrays of (x, y), in order."""
    rings = points.groupBy("cs_id", "contour").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("ring"))
    rings = rings.select("cs_id", "contour", F.transform("ring", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("ring"))
    return rings.groupBy("cs_id").agg(F.array_sort(F.collect_list(F.struct("contour", "ring"))).alias("rings")).select("cs_id", F.col("rings.ring").alias("polygons"))


def triangulate(points: DataFrame, allow_convex: bool = True) -> DataFrame:
    """cs_id, tri, v0, v1, v2: triangles that cover each region, holes left out; corners are numbered contour after
    contour. Every contour edge is a side of one triangle and every other side of two, whatever the input."""

    def run(whole, real):
        found = np.array(plane.triangulate(_rings(whole[:, 0], real), allow_convex), int).reshape(-1, 3)
        return np.arange(len(found)), *found.T

    return each_group(_plain(points), "cs_id", ["contour", "pos"], ["contour"], ["x", "y"], run, "cs_id long, tri long, v0 long, v1 long, v2 long", ("triangulate", allow_convex))


def edges(points: DataFrame) -> DataFrame:
    """cs_id, contour, pos, start_v, end_v: the sides of contours, corners numbered contour after contour."""
    order = Window.partitionBy("cs_id").orderBy("contour", "pos")
    ring = Window.partitionBy("cs_id", "contour").orderBy("pos")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = points.withColumn("v", F.row_number().over(order) - 1)
    return df.select("cs_id", "contour", "pos", F.col("v").cast("long").alias("start_v"), F.coalesce(F.lead("v").over(ring), F.first("v").over(whole)).cast("long").alias("end_v"))


def check_triangulation(points: DataFrame, tris: DataFrame, epsilon: float = 0.0) -> DataFrame:
    """cs_id, edges_match, all_left: whether the triangles' open sides are just the contours' sides, and whether all
    triangles turn left (by more than -``epsilon``)."""
    sides = F.array(*(F.struct(F.col(f"v{k}").alias("s"), F.col(f"v{(k + 1) % 3}").alias("e")) for k in range(3)))
    own = tris.select("cs_id", F.explode(sides).alias("h")).select("cs_id", F.col("h.s").alias("s"), F.col("h.e").alias("e"))
    rim = edges(points).select("cs_id", F.col("end_v").alias("s"), F.col("start_v").alias("e"))  # against the region
    both = own.unionByName(rim).groupBy("cs_id", F.least("s", "e").alias("lo"), F.greatest("s", "e").alias("hi")).agg(F.sum(F.when(F.col("s") < F.col("e"), 1).otherwise(-1)).alias("left"))
    match = both.groupBy("cs_id").agg((F.max(F.abs("left")) == 0).alias("edges_match"))
    at = points.withColumn("v", (F.row_number().over(Window.partitionBy("cs_id").orderBy("contour", "pos")) - 1).cast("long")).select("cs_id", "v", "x", "y")
    df = tris
    for k in range(3):
        df = df.hint("merge").join(at.select("cs_id", F.col("v").alias(f"v{k}"), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}")), ["cs_id", f"v{k}"])
    turn = (F.col("x1") - F.col("x0")) * (F.col("y2") - F.col("y0")) - (F.col("y1") - F.col("y0")) * (F.col("x2") - F.col("x0"))
    left = df.groupBy("cs_id").agg((F.min(turn) >= -epsilon).alias("all_left"))
    return match.hint("merge").join(left, "cs_id", "left")

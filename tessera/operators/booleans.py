"""Booleans and cuts of solids, and what is known by comparing their triangles.

Solids are triangles (mesh_id, tri, v0..v2, ax..cz). A boolean is one group a mesh_id: each solid, or pair of solids, is
computed by one task with ``kernels.solid``, so many are computed side by side and a single one must fit a task. Gaps and
self-intersections are joins of boxes instead, whose pairs are compared in batches, so one solid spreads over tasks.

Triangles with a null or infinite corner are left out of booleans; a mesh_id of one side only meets an empty solid; an
empty table gives no rows; results are numbered from 0, vertices closed edge to edge.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.kernels import solid
from tessera.operators.groups import NULL, each_group
from tessera.operators.solids import winding_numbers
from tessera.operators.spatial import overlap_join, triangle_boxes

CORNERS = [p + c for p in "abc" for c in "xyz"]
TRIANGLES = "mesh_id long, tri long, v0 long, v1 long, v2 long, " + ", ".join(f"{c} double" for c in CORNERS)
_NAMES = ["mesh_id", "tri", "v0", "v1", "v2", *CORNERS]


def _plain(tris: DataFrame, *more: str) -> DataFrame:
    return tris.select(F.col("mesh_id").cast("long"), F.col("tri").cast("long"), *(F.col(c).cast("double") for c in CORNERS), *more)


def _finite(real: np.ndarray) -> np.ndarray:
    """Triangles of rows of corners, in their order."""
    at = real.reshape(-1, 3, 3)
    return at[np.isfinite(at).all(axis=(1, 2))]


def _solid(points: np.ndarray, tris: np.ndarray, *more) -> tuple:
    """The columns of ``TRIANGLES`` after the key, and ``more``."""
    at = points[tris].reshape(-1, 9) if len(tris) else np.empty((0, 9))
    tris = np.asarray(tris).reshape(-1, 3)
    return np.arange(len(tris)), *tris.T, *at.T, *more


def _each(tris: DataFrame, f, *label, whole: tuple = (), real: tuple = (), order: tuple = ("tri",), more: str = "") -> DataFrame:
    """``f`` of the numbers ``whole``, and of the corners and ``real``, of each solid."""
    return each_group(tris, "mesh_id", list(order), list(whole), [*CORNERS, *real], f, TRIANGLES + more, label)


def _near(points: np.ndarray, tolerance: float = 0.0) -> float:
    return max(tolerance, 1e-9 * (float(np.abs(points).max()) if len(points) else 1.0))


def combine(left: np.ndarray, right: np.ndarray, op: str, simplify: bool = True):
    """Points, triangles and origins of a boolean of two triangle arrays; flat regions of one solid are made anew."""
    points, tris, origin = solid.boolean(left, right, op)
    if simplify and len(tris):
        points, tris, back = solid.simplified(points, tris, _near(points), (origin >= len(left)).astype(int))
        origin = origin[back]
    return points, tris, origin


def boolean(left: DataFrame, right: DataFrame, op: str, simplify: bool = True) -> DataFrame:
    """Union ("add"), difference ("subtract") or intersection ("intersect") of the two solids of each mesh_id, with the
    lineage of each triangle: ``side`` (0 left, 1 right) and ``source``, the number it has among that side's triangles in
    order."""

    def run(whole, real):
        x, y = (_finite(real[whole[:, 0] == k]) for k in range(2))
        points, tris, origin = combine(x, y, op, simplify)
        side = origin >= len(x)
        return _solid(points, tris, side, np.where(side, origin - len(x), origin))

    both = _plain(left, F.lit(0).alias("side")).unionByName(_plain(right, F.lit(1).alias("side")))
    return _each(both, run, "boolean", op, simplify, whole=("side",), order=("side", "tri"), more=", side int, source long")


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    return boolean(left, right, "add")


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return boolean(left, right, "subtract")


def intersection(left: DataFrame, right: DataFrame) -> DataFrame:
    return boolean(left, right, "intersect")


def split(left: DataFrame, cutter: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What of each solid lies inside the cutter, and the rest."""
    return intersection(left, cutter), difference(left, cutter)


def batch(parts: DataFrame, op: str) -> DataFrame:
    """One boolean of all solids of each mesh_id (``parts`` has a column ``part``, in whose order they are taken).

    Unions take the two with the fewest triangles each time; a difference takes the union of the others off the first.
    No part gives nothing, one part itself.
    """

    def all_together(solids: list[np.ndarray]) -> np.ndarray:
        held = sorted(solids, key=len)
        while len(held) > 1:
            points, tris, _ = combine(held[0], held[1], "add")
            held = sorted([*held[2:], points[tris] if len(tris) else np.empty((0, 3, 3))], key=len)
        return held[0] if held else np.empty((0, 3, 3))

    def run(whole, real):
        part = whole[:, 0]
        solids = [_finite(real[part == k]) for k in np.unique(part[part != NULL])]
        if not solids:
            return _solid(np.empty((0, 3)), np.empty((0, 3), int))
        if op == "add":
            out = all_together(solids)
        elif op == "subtract":
            points, tris, _ = combine(solids[0], all_together(solids[1:]), op)
            out = points[tris] if len(tris) else np.empty((0, 3, 3))
        else:
            out = solids[0]
            for other in solids[1:]:
                points, tris, _ = combine(out, other, op)
                out = points[tris] if len(tris) else np.empty((0, 3, 3))
        # welded once more, so that a single part is numbered too
        points, tris, origin = solid.closed(solid.faces_of(out), _near(out.reshape(-1, 3)))
        if len(tris):
            points, tris, _ = solid.simplified(points, tris, _near(points), np.zeros(len(tris), int)) if len(solids) == 1 else (points, tris, origin)
        return _solid(points, tris)

    return _each(_plain(parts, F.col("part").cast("long")), run, "batch", op, whole=("part",), order=("part", "tri"))


def split_by_plane(tris: DataFrame, normal: tuple[str, str, str] = ("nx", "ny", "nz"), offset: str = "offset") -> DataFrame:
    """``side`` 1 is what lies on the normal's side of a plane (columns of ``tris``, one plane a mesh_id), 0 the rest,
    each a closed solid numbered from 0. A normal without length gives no rows."""
    plane = [*normal, offset]

    def run(whole, real):
        at, way = _finite(real[:, :9]), real[0, 9:]
        out = []
        for side in (1, 0):
            size = float(np.linalg.norm(way[:3]))
            points, found, origin = solid.half_space(at, way[:3], way[3], bool(side)) if np.isfinite(way).all() and size > 0 else (np.empty((0, 3)), np.empty((0, 3), int), np.empty(0, int))
            if len(found):
                points, found, _ = solid.simplified(points, found, _near(points), (origin >= len(at)).astype(int))
            out.append(_solid(points, found, np.full(len(found), side)))
        return tuple(map(np.concatenate, zip(*out, strict=True)))

    return _each(_plain(tris, *(F.col(c).cast("double") for c in plane)), run, "split_by_plane", real=plane, more=", side int")


def trim_by_plane(tris: DataFrame, normal: tuple[str, str, str] = ("nx", "ny", "nz"), offset: str = "offset") -> DataFrame:
    """What lies on the normal's side."""
    return split_by_plane(tris, normal, offset).where("side = 1").drop("side")


def simplify(tris: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Corners welded, corners on edges put into them, faces that lie within ``tolerance`` of a plane made anew from as
    few triangles as they need, and vertices that several fans share doubled. Closed solids stay closed."""

    def run(whole, real):
        at = _finite(real)
        points, found, _ = solid.closed(solid.faces_of(at), _near(at.reshape(-1, 3)) / 10)
        if len(found):
            points, found, _ = solid.simplified(points, found, _near(points, tolerance))
        return _solid(points, found)

    return _each(_plain(tris), run, "simplify", tolerance)


def coplanar_faces(tris: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """mesh_id, tri, face: triangles of one flat region share the number of the largest of them."""

    def run(whole, real):
        points, numbers = real.reshape(-1, 3), whole[:, 1:]
        place = np.zeros((int(numbers.max()) + 1, 3))
        place[numbers.reshape(-1)] = points
        label = solid.coplanar(place, numbers, _near(points, tolerance))
        return whole[:, 0], whole[label, 0]

    return each_group(tris, "mesh_id", ["tri"], ["tri", "v0", "v1", "v2"], CORNERS, run, "mesh_id long, tri long, face long", ("coplanar", tolerance))


def split_pinched(tris: DataFrame) -> DataFrame:
    """``tris`` with vertices that several fans of faces share doubled, numbered from 0."""

    def run(numbers, real):
        place = np.zeros((int(numbers.max()) + 1, 3))
        place[numbers.reshape(-1)] = real.reshape(-1, 3)
        return _solid(*solid.split_pinched(place, numbers))

    return _each(tris, run, "split_pinched", whole=("v0", "v1", "v2"))


def hull(points: DataFrame) -> DataFrame:
    """Convex hull of the points (mesh_id, x, y, z) of each mesh_id; fewer than four points or flat ones give no rows.

    Each batch keeps only the corners of its own hulls, so few points of a large group move.
    """

    def reduce(whole, at):
        corners, _ = solid.hull(at)
        # flat ones may still span a solid with others
        return tuple((corners if len(corners) else np.unique(at, axis=0)).T)

    def finish(whole, at):
        return _solid(*solid.hull(at))

    finite = " and ".join(f"abs({c}) < double('infinity')" for c in "xyz")
    rows = points.select("mesh_id", *(F.col(c).cast("double") for c in "xyz")).where(finite)
    few = each_group(rows, "mesh_id", None, [], list("xyz"), reduce, "mesh_id long, x double, y double, z double", ("hull corners",))
    return each_group(few, "mesh_id", list("xyz"), [], list("xyz"), finish, TRIANGLES, ("hull",))


def hull_of_solids(tris: DataFrame) -> DataFrame:
    """Convex hull of all vertices of each mesh_id, of one solid or of several composed."""
    return hull(tris.select("mesh_id", F.explode(F.array(*(F.struct(*(F.col(p + c).alias(c) for c in "xyz")) for p in "abc"))).alias("p")).select("mesh_id", "p.*"))


# ---- comparisons by joins of boxes


def _pairs(left: DataFrame, right: DataFrame, grow: float, self_join: bool = False) -> DataFrame:
    keep = ["mesh_id", "tri", "v0", "v1", "v2", *CORNERS]
    pairs = overlap_join(triangle_boxes(left.select(*keep)), triangle_boxes(right.select(*keep), grow), self_join=self_join, keys=("mesh_id",))
    return pairs.select("mesh_id", *(f"{n}_{c}" for n in "ab" for c in ["tri", "v0", "v1", "v2", *CORNERS]))


def _arrays(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return tuple(frame[[f"{n}_{c}" for c in CORNERS]].to_numpy(float).reshape(-1, 3, 3) for n in "ab")


def min_gap(left: DataFrame, right: DataFrame, search: float) -> DataFrame:
    """mesh_id, gap: least distance of the two solids of each mesh_id, 0 if they overlap, at most ``search``.

    Triangles nearer than ``search`` meet by a join of boxes; a solid inside the other is found by the winding
    numbers of its vertices. A mesh_id of one side only has no row.
    """

    def gaps(frames):
        for frame in frames:
            a, b = _arrays(frame)
            found = solid.triangle_gaps(a, b)
            yield pd.DataFrame({"mesh_id": frame["mesh_id"], "gap": found}).groupby("mesh_id", as_index=False)["gap"].min()

    near = _pairs(left, right, search).mapInPandas(gaps, "mesh_id long, gap double")
    inside = []
    for a, b in ((left, right), (right, left)):
        points = a.select("mesh_id", F.xxhash64("ax", "ay", "az").alias("id"), *(F.col("a" + c).alias(c) for c in "xyz")).distinct()
        held = winding_numbers(points, b, same_mesh=True)
        inside.append(held.select("mesh_id", F.lit(0.0).alias("gap")))
    both = left.select("mesh_id").distinct().hint("merge").join(right.select("mesh_id").distinct(), "mesh_id", "left_semi")
    every = near.unionByName(inside[0]).unionByName(inside[1]).unionByName(both.select("mesh_id", F.lit(float(search)).alias("gap")))
    return every.groupBy("mesh_id").agg(F.least(F.min("gap"), F.lit(float(search))).alias("gap"))


def self_intersections(tris: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """mesh_id, a, b: triangles of one solid that pass through each other by more than ``tolerance``; neighbours that
    merely share corners do not."""

    def crossing(frames):
        for frame in frames:
            a, b = _arrays(frame)
            hit = solid.triangles_cross(a, b, tolerance)
            yield frame.loc[hit, ["mesh_id", "a_tri", "b_tri"]].rename(columns={"a_tri": "a", "b_tri": "b"})

    return _pairs(tris, tris, 0.0, self_join=True).mapInPandas(crossing, "mesh_id long, a long, b long")


def is_self_intersecting(tris: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """mesh_id, is_self_intersecting."""
    found = self_intersections(tris, tolerance).groupBy("mesh_id").agg(F.count("*").alias("n"))
    return tris.select("mesh_id").distinct().hint("merge").join(found, "mesh_id", "left").select("mesh_id", F.col("n").isNotNull().alias("is_self_intersecting"))

"""Constructors of solids, each triangle numbered, counter-clockwise from outside, vertices numbered from 0.

Cubes, octahedra and cylinders are expressions over their instance row. Extrusions and turns of any contours, holes
included, take one group a cs_id, since a contour must be triangulated as a whole. Invalid knobs (a size below 0, a height
or radius not above 0, nothing inside the contours) give no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import quality
from tessera.functions.vectors import Vec, circular_segments, cosd, length, sind, sub
from tessera.kernels import plane
from tessera.operators import shapes, solids
from tessera.operators.booleans import CORNERS, TRIANGLES, _solid
from tessera.operators.groups import NULL, each_group
from tessera.operators.sections import POINTS, _plain, _rings, _rows
from tessera.operators.spatial import slice_segments
from tessera.storage import shuffle_width


def cubes(instances: DataFrame, center: bool = False) -> DataFrame:
    """Boxes per row (mesh_id, sx, sy, sz), in the first octant or around the origin. A side below 0, or no side above
    0, gives none; one side of 0 makes a flat box."""
    good = (F.least("sx", "sy", "sz") >= 0) & (F.greatest("sx", "sy", "sz") > 0)
    shift = {f"t{c}": (-F.col(f"s{c}") / 2 if center else F.lit(0.0)) for c in "xyz"}
    return shapes.triangles(instances.where(good).select("mesh_id", *(F.col(f"s{c}").cast("double") for c in "xyz")).withColumns(shift))


def octahedra(instances: DataFrame) -> DataFrame:
    """Corners on the axes, scaled and moved as ``shapes.triangles``."""
    return shapes.triangles(instances, "octahedron")


def _segments(radius: Column, given: str | None, columns: list[str]) -> Column:
    s = quality.settings()
    auto = F.lit(s["segments"]) if s["segments"] > 0 else circular_segments(radius, s["angle"], s["edge"])
    return F.when(F.col("segments") > 2, F.col("segments")).otherwise(auto) if "segments" in columns else auto


def cylinders(instances: DataFrame, center: bool = False) -> DataFrame:
    """Per row (mesh_id, height, radius_low, radius_high (below 0: as the low one), segments (below 3: as the quality
    settings say)): 4 n - 4 triangles, or 2 n - 2 for a cone."""
    df = instances.where("height > 0 and radius_low > 0")
    high = F.when(F.col("radius_high") < 0, F.col("radius_low")).otherwise(F.col("radius_high"))
    df = df.select("mesh_id", F.col("height").cast("double"), F.col("radius_low").cast("double").alias("radius"), high.cast("double").alias("high"), _segments(F.greatest("radius_low", high), None, instances.columns).cast("int").alias("n"))
    # each row makes up to hundreds of triangles, so rows are dealt evenly before; a regular contour knows its neighbours
    df = df.where("n >= 3").repartition(shuffle_width(df.sparkSession)).withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    df = df.withColumn("q", (F.col("pos") + 1) % F.col("n"))
    ends = {"x": F.col("pos"), "qx": F.col("q"), "ox": F.lit(0)}
    at = [v.alias(p[:-1] + c) for p, pos in ends.items() for c, v in zip("xy", (F.col("radius") * cosd(360.0 * pos / F.col("n")), F.col("radius") * sind(360.0 * pos / F.col("n"))), strict=True)]
    ring = solids.once(df.select("mesh_id", "pos", "q", F.col("n").cast("long"), "height", F.lit(0).alias("divisions"), F.lit(0.0).alias("twist"), (F.col("high") / F.col("radius")).alias("scale_top"), *at))
    return solids.extrude_ring(ring, -(F.col("height") / 2) if center else None)


def _extruded(contours, height: float, divisions: int, twist: float, scale: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Points and triangles; a scale of 0 makes one apex a contour."""
    contours = [c for c in contours if len(c) >= 3]
    none = np.empty((0, 3)), np.empty((0, 3), int)
    if not contours or not height > 0:
        return none
    flat = np.array([p for c in contours for p in c])
    cap = np.array(plane.triangulate(contours)).reshape(-1, 3)
    if not len(cap):
        return none
    n, layers = len(flat), max(int(divisions), 0) + 1
    nxt = np.concatenate([np.roll(np.arange(len(c)), -1) + at for c, at in zip(contours, np.cumsum([0, *map(len, contours)]), strict=False)])
    cone = scale == (0.0, 0.0)
    points, tris = [], [cap[:, ::-1]]
    for layer in range(layers + 1):
        part = layer / layers
        if layer == layers and cone:
            break
        turn = np.deg2rad(twist * part)
        way = np.array([[np.cos(turn), -np.sin(turn)], [np.sin(turn), np.cos(turn)]])
        at = (flat * (1 + (np.array(scale) - 1) * part)) @ way.T
        points.append(np.column_stack([at, np.full(n, height * part)]))
        if layer:
            low, high = np.arange(n) + (layer - 1) * n, np.arange(n) + layer * n
            tris += [np.column_stack([low, nxt + (layer - 1) * n, nxt + layer * n]), np.column_stack([low, nxt + layer * n, high])]
    if cone:
        apex = np.concatenate([np.full(len(c), layers * n + k) for k, c in enumerate(contours)])
        points.append(np.tile([0.0, 0.0, height], (len(contours), 1)))
        low = np.arange(n) + (layers - 1) * n
        tris.append(np.column_stack([low, nxt + (layers - 1) * n, apex]))
    else:
        tris.append(cap + layers * n)
    return np.vstack(points), np.vstack(tris)


def extrude(points: DataFrame) -> DataFrame:
    """Solids of contours of any kind (contour points with, per cs_id, height, divisions, twist in degrees, scale_x,
    scale_y): mesh_id is the cs_id."""

    knobs = ["height", "twist", "scale_x", "scale_y"]

    def run(whole, real):
        height, twist, *scale = real[0, 2:].tolist()
        good = np.isfinite(real[0, 2:]).all() and whole[0, 1] != NULL
        found = _extruded(plane.filled(_rings(whole[:, 0], real[:, :2])), height, int(whole[0, 1]), twist, tuple(scale)) if good else (np.empty((0, 3)), np.empty((0, 3), int))
        return _solid(*found)

    rows = _plain(points, *(F.col(c).cast("double") for c in knobs), F.col("divisions").cast("int"))
    return each_group(rows, "cs_id", ["contour", "pos"], ["contour", "divisions"], ["x", "y", *knobs], run, TRIANGLES, ("extrude",))


def _revolved(contours, n: int, degrees: float) -> tuple[np.ndarray, np.ndarray]:
    """Points and triangles of contours turned about the y axis, which becomes z."""
    none = np.empty((0, 3)), np.empty((0, 3), int)
    far = max((abs(v) for c in contours for p in c for v in p), default=0.0) + 1
    contours = plane.boolean(contours, [[(0.0, -far), (far, -far), (far, far), (0.0, far)]], "intersect")
    degrees = min(degrees, 360.0)
    if not contours or not degrees > 0:
        return none
    whole = degrees == 360.0
    steps = n if whole else n + 1
    angle = np.deg2rad(degrees * np.arange(steps) / n)
    points, tris, number, count = [], [], {}, 0
    for c, ring in enumerate(contours):
        for k, (x, y) in enumerate(ring):
            if x == 0:
                number[c, k] = np.full(n + 1, count)
                points.append(np.array([[0.0, 0.0, y]]))
                count += 1
            else:
                at = np.arange(count, count + steps)
                number[c, k] = np.append(at, at[0]) if whole else at
                points.append(np.column_stack([x * np.cos(angle), x * np.sin(angle), np.full(steps, y)]))
                count += steps
        for k in range(len(ring)):
            p, q = number[c, k], number[c, (k + 1) % len(ring)]
            for s in range(n):
                a, b, g, h = p[s], q[s], p[s + 1], q[s + 1]
                if b != h:
                    tris.append((a, h, b))
                if a != g:
                    tris.append((a, g, h))
    if not whole:
        flat = [(c, k) for c, ring in enumerate(contours) for k in range(len(ring))]
        for t in plane.triangulate(contours):
            i, j, k = (number[flat[v]] for v in t)
            tris += [(i[0], j[0], k[0]), (i[n], k[n], j[n])]
    return np.vstack(points), np.array(tris).reshape(-1, 3)


def revolve(points: DataFrame) -> DataFrame:
    """Solids of contours (contour points with, per cs_id, segments and degrees) turned about the y axis, which becomes
    z: what lies left of the axis is cut off, points on it are used once, a part of a turn gets two caps."""

    def run(whole, real):
        contours, degrees, n = plane.filled(_rings(whole[:, 0], real[:, :2])), float(real[0, 2]), int(whole[0, 1])
        reach = max((x for c in contours for x, _ in c), default=0.0)
        n = n if n > 2 else max(int(quality.circular_segments(reach) * min(degrees, 360.0) / 360), 1)
        return _solid(*_revolved(contours, n, degrees))

    rows = _plain(points, F.col("degrees").cast("double"), F.col("segments").cast("int"))
    return each_group(rows, "cs_id", ["contour", "pos"], ["contour", "segments"], ["x", "y", "degrees"], run, TRIANGLES, ("revolve",))


def project(tris: DataFrame) -> DataFrame:
    """Contour points (cs_id is the mesh_id) of what each solid covers seen from above."""

    def run(key, frame):
        at = frame[CORNERS].to_numpy(float).reshape(-1, 3, 3)[:, :, :2]
        u, v = at[:, 1] - at[:, 0], at[:, 2] - at[:, 0]
        up = u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0] > 0
        return _rows(key[0], plane.filled([[tuple(p) for p in t] for t in at[up].tolist()]))

    return tris.select("mesh_id", *CORNERS).groupBy("mesh_id").applyInPandas(run, POINTS)


def slices(tris: DataFrame, height: str = "height") -> DataFrame:
    """Contour points (cs_id is the mesh_id) of the cut of each solid by the plane z = ``height`` (a column)."""
    def run(key, frame):
        # segments run with the solid to their left; each is a leg of a fan about the first point, so the fans' sum
        # winds once round what is inside
        legs = frame[["x0", "y0", "x1", "y1"]].to_numpy(float).tolist()
        o = legs[0][:2]
        return _rows(key[0], plane.filled([[tuple(o), (a, b), (c, d)] for a, b, c, d in legs]))

    rows = slice_segments(tris, height).select("mesh_id", "x0", "y0", "x1", "y1")
    return rows.groupBy("mesh_id").applyInPandas(run, POINTS)


@lru_cache(maxsize=4096)
def _partition(counts: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Barycentric points and triangles of a triangle whose sides 01, 12, 20 are parted in ``counts``, and for the side
    points (they come first, in order round the triangle) the side and the place on it.

    Inside lies the lattice of the most parted side, without its rim; the ring between is closed by taking the nearer
    next point of either chain.
    """
    corners = np.eye(3)
    points, sides = [], []
    for k, n in enumerate(counts):
        points += [corners[k] + (corners[(k + 1) % 3] - corners[k]) * s / n for s in range(n)]
        sides += [(k, s) for s in range(n)]
    outer, tris, most = list(range(len(points))), [], max(counts)
    inner = {}
    for i in range(1, most):
        for j in range(1, most - i):
            inner[i, j] = len(points)
            points.append(np.array([i, j, most - i - j]) / most)
    if not inner:
        flat = [(float(p[1]), float(p[2])) for p in points]
        tris = plane._clip_ears(flat, outer)
    elif len(inner) == 1:
        hub = next(iter(inner.values()))
        tris = [(outer[k], outer[(k + 1) % len(outer)], hub) for k in range(len(outer))]
    else:
        for (i, j), v in inner.items():
            right, up, across = inner.get((i + 1, j)), inner.get((i, j + 1)), inner.get((i + 1, j + 1))
            if right is not None and up is not None:
                tris.append((right, up, v))
                if across is not None:
                    tris.append((right, across, up))
        m = most - 3  # sides of the inner lattice: from next to corner 0 to next to corner 1, and so on
        ends = [(most - 2, 1), (1, most - 2), (1, 1)]
        start = 0
        for k in range(3):
            (i, j), (i2, j2) = ends[k], ends[(k + 1) % 3]
            b = [inner[i + (i2 - i) * s // m, j + (j2 - j) * s // m] for s in range(m + 1)]
            a = [outer[(start + s) % len(outer)] for s in range(counts[k] + 1)]
            start += counts[k]
            x = y = 0
            while x < len(a) - 1 or y < len(b) - 1:
                if y == len(b) - 1 or (x < len(a) - 1 and (x + 1) / (len(a) - 1) <= (y + 1) / (len(b) - 1)):
                    tris.append((a[x], a[x + 1], b[y]))
                    x += 1
                else:
                    tris.append((a[x], b[y + 1], b[y]))
                    y += 1
    return np.array(points), np.array(tris), sides


def _mixed(*parts: np.ndarray) -> np.ndarray:
    """One 64-bit number (not below 0) for each row of the parts."""
    h = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        h = (h ^ p.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return (h >> np.uint64(1)).view(np.int64)


def refine_by(tris: DataFrame, parts: Callable[[Vec, Vec], Column]) -> DataFrame:
    """Every edge parted as ``parts`` says, an expression of its two ends (the one with the lesser number first); less
    than 1 counts as 1.

    An edge's parts depend on the edge alone, so neighbours agree without meeting; each triangle is filled by itself
    from the points on its sides. A new vertex on an edge is numbered by a hash of the edge's ends and its place, so it
    is the same on both sides; ``topology.renumber`` makes numbers dense.
    """
    names = ("a", "b", "c")
    for k in range(3):
        p, q = names[k], names[(k + 1) % 3]
        swap = F.col(f"v{k}") > F.col(f"v{(k + 1) % 3}")
        lo = tuple(F.when(swap, F.col(q + c)).otherwise(F.col(p + c)) for c in "xyz")
        hi = tuple(F.when(swap, F.col(p + c)).otherwise(F.col(q + c)) for c in "xyz")
        tris = tris.withColumn(f"n{k}", F.greatest(parts(lo, hi).cast("int"), F.lit(1)))

    def run(frames):
        for frame in frames:
            out = []
            for counts, g in frame.groupby(["n0", "n1", "n2"], sort=True):
                weights, found, sides = _partition(tuple(int(c) for c in counts))
                at = g[CORNERS].to_numpy(float).reshape(-1, 3, 3)
                v = g[["v0", "v1", "v2"]].to_numpy(np.int64)
                tri = g["tri"].to_numpy(np.int64)
                points = np.empty((len(g), len(weights), 3))
                number = np.empty((len(g), len(weights)), np.int64)
                for m, w in enumerate(weights):
                    if m < len(sides):
                        k, s = sides[m]
                        n, e = counts[k], (k + 1) % 3
                        swap = v[:, k] > v[:, e]
                        lo, hi = np.where(swap[:, None], at[:, e], at[:, k]), np.where(swap[:, None], at[:, k], at[:, e])
                        step = np.where(swap, n - s, s)
                        points[:, m] = at[:, k] if s == 0 else lo + (hi - lo) * (step / n)[:, None]
                        number[:, m] = v[:, k] if s == 0 else _mixed(np.minimum(v[:, k], v[:, e]), np.maximum(v[:, k], v[:, e]), step)
                    else:
                        points[:, m] = np.einsum("k,nkc->nc", w, at)
                        number[:, m] = _mixed(tri, v[:, 0], v[:, 1], v[:, 2], np.full(len(g), m))
                rows = len(found)
                part = {"mesh_id": np.repeat(g["mesh_id"].to_numpy(), rows), "tri": _mixed(np.repeat(tri, rows), np.tile(np.arange(rows), len(g)))}
                part |= {f"v{k}": number[:, found[:, k]].reshape(-1) for k in range(3)}
                part |= {p + c: points[:, found[:, k], x].reshape(-1) for k, p in enumerate("abc") for x, c in enumerate("xyz")}
                out.append(pd.DataFrame(part))
            if out:
                yield pd.concat(out)

    return tris.select("mesh_id", "tri", *(F.col(f"v{k}").cast("long") for k in range(3)), *CORNERS, "n0", "n1", "n2").mapInPandas(run, TRIANGLES)


def refine_to_length(tris: DataFrame, size: float) -> DataFrame:
    """Every edge in int(its length / ``size``) + 1 parts."""
    return refine_by(tris, lambda p, q: F.floor(length(sub(p, q)) / size) + 1)

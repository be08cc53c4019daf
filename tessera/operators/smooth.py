"""Smoothing: normals split at sharp edges, curved edges by weighted tangents, refinement along them.

A tangent (x, y, z, w) at an edge's end gives the next control point of a rational cubic curve, relative to that end, and
its weight. It depends on the edge, the two faces beside it and the vertex normal alone, so it is made once an edge and
reaches the triangles by joins on (mesh_id, lesser end, greater end). Refinement is by triangle: points on an edge lie on
its curve, points inside on the rational Bézier triangle over the three curves, so neighbours agree without meeting.

Solids must be closed, two faces an edge; a mesh_id that is null, and edges with one face, are left out by the joins;
degenerate triangles have no normal and count as flat; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import linalg
from tessera.functions.vectors import Vec, cross, dot, length, sub, vec
from tessera.operators.booleans import CORNERS, TRIANGLES
from tessera.operators.construct import _mixed, _partition
from tessera.operators.groups import NULL, whole_groups
from tessera.operators.measure import vertex_normals
from tessera.operators.topology import least_linked

_ENDS = [(k, e) for k in range(3) for e in ("s", "e")]
#: Tangents of a triangle's sides: of side k at its start (s) and its end (e).
TANGENTS = [f"t{k}{e}{c}" for k, e in _ENDS for c in "xyzw"]


def _with_normals(tris: DataFrame) -> DataFrame:
    n = cross(sub(vec("b"), vec("a")), sub(vec("c"), vec("a")))
    df = tris.withColumns({f"_n{k}": v for k, v in zip("xyz", n, strict=True)}).withColumn("_l", length(vec("_n")))
    return df.withColumns({f"u{k}": F.coalesce(F.try_divide(F.col(f"_n{k}"), F.col("_l")), F.lit(0.0)) for k in "xyz"}).drop("_nx", "_ny", "_nz", "_l")


def _sides(df: DataFrame) -> DataFrame:
    """mesh_id, tri, k, s, e, both ends' places (px..qz) and the face normal of every half-edge."""
    rows = F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"v{k}").alias("s"), F.col(f"v{(k + 1) % 3}").alias("e"), *(F.col(p + c).alias("p" + c) for c in "xyz"), *(F.col(q + c).alias("q" + c) for c in "xyz")) for k, (p, q) in enumerate(("ab", "bc", "ca"))))
    return df.select("mesh_id", "tri", "ux", "uy", "uz", F.explode(rows).alias("h")).select("mesh_id", "tri", "ux", "uy", "uz", "h.*")


def edge_bends(tris: DataFrame) -> DataFrame:
    """mesh_id, lo, hi, angle (degrees between the normals of both faces), the places of both ends (px..qz) and the sum of
    both normals (wx, wy, wz) of every edge with two faces."""
    forward = F.col("s") < F.col("e")
    both = _sides(_with_normals(tris)).groupBy("mesh_id", F.least("s", "e").alias("lo"), F.greatest("s", "e").alias("hi")).agg(
        *(F.max(F.when(forward, F.col(f"{p}{c}"))).alias(f"{p}{c}") for p in "pqu" for c in "xyz"), *(F.max(F.when(~forward, F.col(f"u{c}"))).alias(f"o{c}") for c in "xyz")
    )
    both = both.where("ux is not null and ox is not null")
    u, o = vec("u"), vec("o")
    return both.select("mesh_id", "lo", "hi", F.degrees(linalg.acos(dot(u, o))).alias("angle"), *(f"{p}{c}" for p in "pq" for c in "xyz"), *((u[k] + o[k]).alias(f"w{c}") for k, c in enumerate("xyz")))


def sharp_edges(tris: DataFrame, min_angle: float = 60.0) -> DataFrame:
    """mesh_id, lo, hi, angle of edges whose faces part by more than ``min_angle`` degrees."""
    return edge_bends(tris).where(F.col("angle") > min_angle).select("mesh_id", "lo", "hi", "angle")


def corner_normals(tris: DataFrame, min_sharp_angle: float = 60.0) -> DataFrame:
    """mesh_id, tri, k, vert, nx, ny, nz of every corner: the mean of the normals of the faces that reach it without
    crossing a sharp edge, each weighted by its angle there.

    Corners are dealt by their vertex: all that decides on its fans is known there, so nothing is joined. The faces round
    one vertex must fit a task.
    """
    df = _with_normals(tris).where("mesh_id is not null")

    def angle(p: str, q: str, r: str) -> Column:
        x, y = sub(vec(q), vec(p)), sub(vec(r), vec(p))
        return linalg.acos(F.coalesce(F.try_divide(dot(x, y), length(x) * length(y)), F.lit(1.0)))

    corners = F.array(*(F.struct(F.lit(k).alias("k"), *(F.col(f"v{(k + i) % 3}").cast("long").alias(n) for i, n in enumerate(("vert", "after", "before"))), angle(p, q, r).alias("w")) for k, (p, q, r) in enumerate(("abc", "bca", "cab"))))
    whole = [F.col(c).cast("long").alias(c.removeprefix("p.")) for c in ("mesh_id", "p.vert", "p.after", "p.before", "tri", "p.k")]
    rows = df.select("mesh_id", "tri", "ux", "uy", "uz", F.explode(corners).alias("p")).select(F.xxhash64("mesh_id", "p.vert").alias("at"), *whole, "ux", "uy", "uz", "p.w")

    def run(batches):
        for part in whole_groups(batches):
            sums = _fan_sums(part[:, 1:5], np.ascontiguousarray(part[:, 7:]).view(float), min_sharp_angle)
            vert = part[:, 2]
            yield pa.RecordBatch.from_arrays([pa.array(part[:, 1]), pa.array(part[:, 5]), pa.array(part[:, 6]), pa.array(vert, mask=vert == NULL), *map(pa.array, sums.T)], names=["mesh_id", "tri", "k", "vert", "sx", "sy", "sz"])

    sums = rows.repartition("at").sortWithinPartitions("at").mapInArrow(run, "mesh_id long, tri long, k long, vert long, sx double, sy double, sz double")
    unit = linalg.safe_normalize(vec("s"))
    kinds = dict(tris.dtypes)
    names = [F.col(c).cast(kind).alias(c) for c, kind in (("mesh_id", kinds["mesh_id"]), ("tri", kinds["tri"]), ("k", "int"), ("vert", kinds["v0"]))]
    return sums.select(*names, *(u.alias(f"n{c}") for u, c in zip(unit, "xyz", strict=True)))


def _fan_sums(whole: np.ndarray, real: np.ndarray, min_sharp_angle: float) -> np.ndarray:
    """For each corner (mesh_id, vert, the vertices after and before it; its face's normal and its angle) the sum of the
    weighted normals of its fan. All corners at a vertex are given together; those of many vertices may be."""
    n, u = len(whole), real[:, :3]
    # each corner has two edges at its vertex: one that its face runs along, one that it comes back by
    corner, way = np.tile(np.arange(n), 2), np.repeat([0, 1], n)
    far = np.concatenate([whole[:, 2], whole[:, 3]])
    known = (far != NULL) & (whole[corner, 1] != NULL) & (far != whole[corner, 1])
    corner, way, far = corner[known], way[known], far[known]
    order = np.lexsort((way, far, whole[corner, 1], whole[corner, 0]))
    corner, way, far = corner[order], way[order], far[order]
    fresh = np.ones(len(corner), bool)
    fresh[1:] = (whole[corner[1:], :2] != whole[corner[:-1], :2]).any(axis=1) | (far[1:] != far[:-1])
    edge = np.cumsum(fresh) - 1
    normal = np.full((int(fresh.sum()), 2, 3), -np.inf)
    np.maximum.at(normal, (edge, way), u[corner])
    met = np.zeros((len(normal), 2), bool)
    met[edge, way] = True
    soft = np.zeros(len(normal), bool)
    both = met.all(axis=1)
    cosine = (normal[both, 0] * normal[both, 1]).sum(axis=1)
    # as edge_bends has it: what is no number counts as flat
    soft[both] = np.degrees(np.arccos(np.clip(np.where(np.isnan(cosine), 1.0, cosine), -1.0, 1.0))) <= min_sharp_angle
    linked = ~fresh[1:] & soft[edge[1:]]
    fan = np.arange(n)
    nodes, root = least_linked(corner[1:][linked], corner[:-1][linked])
    fan[nodes] = root
    return np.column_stack([np.bincount(fan, real[:, 3] * u[:, k], n) for k in range(3)])[fan]


def tangents(tris: DataFrame, min_sharp_angle: float = 180.0, smoothness: float = 0.0, normals: DataFrame | None = None) -> DataFrame:
    """``tris`` with the tangents of its sides (``TANGENTS``). ``normals`` (mesh_id, vert, nx, ny, nz) are the vertex
    normals if not given. Edges that part by more than ``min_sharp_angle`` are straight, their tangents shortened towards
    none as ``smoothness`` (0 to 1) falls to 0. Edges within a flat face
    bend like others, so flat faces beside sharp edges bulge."""
    normals = vertex_normals(tris).select("mesh_id", "vert", "nx", "ny", "nz") if normals is None else normals
    edge = edge_bends(tris)
    for end in ("lo", "hi"):
        edge = edge.hint("merge").join(normals.select("mesh_id", F.col("vert").alias(end), *(F.col(f"n{c}").alias(f"{end}_{c}") for c in "xyz")), ["mesh_id", end])
    along = sub(vec("q"), vec("p"))

    def tangent(way: Vec, normal: Vec) -> tuple[Column, ...]:
        curved = linalg.circular_tangent(cross(cross(vec("w"), way), normal), way)
        straight = (*(x * smoothness / 3 for x in way), F.lit(1.0))
        return tuple(F.when(F.col("angle") > min_sharp_angle, s).otherwise(c) for c, s in zip(curved, straight, strict=True))

    ends = {"l": tangent(along, vec("lo_")), "h": tangent(tuple(-x for x in along), vec("hi_"))}
    edge = edge.select("mesh_id", "lo", "hi", *(v.alias(f"{e}{c}") for e, t in ends.items() for v, c in zip(t, "xyzw", strict=True)))
    out = tris
    for k in range(3):
        s, e = F.col(f"v{k}"), F.col(f"v{(k + 1) % 3}")
        part = edge.select(F.col("mesh_id").alias("_m"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), *(F.col(f"{n}{c}").alias(f"_{n}{c}") for n in "lh" for c in "xyzw"))
        out = out.hint("merge").join(part, (out["mesh_id"] == part["_m"]) & (F.least(s, e) == part["_lo"]) & (F.greatest(s, e) == part["_hi"]))
        pick = {f"t{k}{end}{c}": F.when((s < e) == F.lit(end == "s"), F.col(f"_l{c}")).otherwise(F.col(f"_h{c}")) for end in ("s", "e") for c in "xyzw"}
        out = out.withColumns(pick).drop("_m", "_lo", "_hi", *(f"_{n}{c}" for n in "lh" for c in "xyzw"))
    return out


def _control(corners: np.ndarray, tangent: np.ndarray) -> np.ndarray:
    """Homogeneous control points (n, 10, 4) of a rational cubic Bézier triangle: the corners, then two for each side, then
    the middle, from corners (n, 3, 3) and tangents (n, 3, 2, 4)."""
    n = len(corners)
    out = np.empty((n, 10, 4))
    out[:, :3, :3], out[:, :3, 3] = corners, 1
    for k in range(3):
        for end in range(2):
            w = tangent[:, k, end, 3]
            at = corners[:, (k + end) % 3] + tangent[:, k, end, :3]
            out[:, 3 + 2 * k + end, :3], out[:, 3 + 2 * k + end, 3] = at * w[:, None], w
    sides, ends = out[:, 3:9].mean(axis=1), out[:, :3].mean(axis=1)
    out[:, 9] = 1.5 * sides - 0.5 * ends
    return out


def _curve(control: np.ndarray, k: int, t: np.ndarray) -> np.ndarray:
    """Points of side ``k`` at ``t``, a row each."""
    p, a, b, q = control[:, k], control[:, 3 + 2 * k], control[:, 4 + 2 * k], control[:, (k + 1) % 3]
    s = 1 - t
    at = (s**3)[:, None] * p + (3 * s * s * t)[:, None] * a + (3 * s * t * t)[:, None] * b + (t**3)[:, None] * q
    return at[:, :3] / at[:, 3:]


def _patch(control: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Points at the barycentric weights ``w`` of every triangle."""
    u, v, x = w
    basis = [u**3, v**3, x**3, 3 * u * u * v, 3 * u * v * v, 3 * v * v * x, 3 * v * x * x, 3 * x * x * u, 3 * x * u * u, 6 * u * v * x]
    at = np.einsum("k,nkc->nc", np.array(basis), control)
    return at[:, :3] / at[:, 3:]


def refine(tris: DataFrame, parts: int | Column) -> DataFrame:
    """``tris`` (with tangents) with every side in ``parts`` (a number, or an expression that is the same for every edge
    of a solid), new vertices on the curved surface, numbered by hashes as in ``construct.refine_by``."""
    n = F.lit(parts) if isinstance(parts, int) else parts
    rows = tris.select("mesh_id", "tri", *(F.col(f"v{k}").cast("long") for k in range(3)), *CORNERS, *TANGENTS, F.greatest(n, F.lit(1)).cast("int").alias("n"))

    def run(frames):
        for frame in frames:
            out = []
            for count, g in frame.groupby("n", sort=True):
                n = int(count)
                weights, found, sides = _partition((n, n, n))
                at, v, tri = g[CORNERS].to_numpy(float).reshape(-1, 3, 3), g[["v0", "v1", "v2"]].to_numpy(np.int64), g["tri"].to_numpy(np.int64)
                control = _control(at, g[TANGENTS].to_numpy(float).reshape(-1, 3, 2, 4))
                points, number = np.empty((len(g), len(weights), 3)), np.empty((len(g), len(weights)), np.int64)
                for m, w in enumerate(weights):
                    if m >= len(sides):
                        points[:, m] = _patch(control, w)
                        number[:, m] = _mixed(tri, v[:, 0], v[:, 1], v[:, 2], np.full(len(g), m))
                        continue
                    k, s = sides[m]
                    e = (k + 1) % 3
                    if s == 0:
                        points[:, m], number[:, m] = at[:, k], v[:, k]
                        continue
                    swap = v[:, k] > v[:, e]
                    step = np.where(swap, n - s, s)
                    # from the lesser end, so that both faces of an edge get the same point
                    ahead, back = _curve(control, k, step / n), _curve(control[:, [*_turned(k)]], 0, step / n)
                    points[:, m] = np.where(swap[:, None], back, ahead)
                    number[:, m] = _mixed(np.minimum(v[:, k], v[:, e]), np.maximum(v[:, k], v[:, e]), step)
                size = len(found)
                part = {"mesh_id": np.repeat(g["mesh_id"].to_numpy(), size), "tri": _mixed(np.repeat(tri, size), np.tile(np.arange(size), len(g)))}
                part |= {f"v{k}": number[:, found[:, k]].reshape(-1) for k in range(3)}
                part |= {p + c: points[:, found[:, k], x].reshape(-1) for k, p in enumerate("abc") for x, c in enumerate("xyz")}
                out.append(pd.DataFrame(part))
            if out:
                yield pd.concat(out)

    return rows.mapInPandas(run, TRIANGLES)


def _turned(k: int) -> list[int]:
    """Control points in an order in which side ``k`` is side 0, run the other way."""
    order = list(range(10))
    order[0], order[1], order[3], order[4] = (k + 1) % 3, k, 4 + 2 * k, 3 + 2 * k
    return order


def smooth_out(tris: DataFrame, parts: int, min_sharp_angle: float = 60.0, smoothness: float = 0.0) -> DataFrame:
    """Tangents from the solid itself, sharp edges kept, then every edge in ``parts``."""
    return refine(tangents(tris, min_sharp_angle, smoothness), parts)


def smooth_by_normals(tris: DataFrame, normals: DataFrame, parts: int) -> DataFrame:
    """Tangents from given vertex normals, then every edge in ``parts``."""
    return refine(tangents(tris, normals=normals), parts)


def parts_to_tolerance(tris: DataFrame, tolerance: float) -> DataFrame:
    """``tris`` (with tangents) with ``parts``, the same for a whole solid: so many that a straight piece is at most about
    ``tolerance`` off its curve, int(sqrt(3 d / (4 tolerance))) + 1 for the greatest distance d of a control point from its
    edge. Solids without bends have 1."""
    d = []
    for k, (p, q) in enumerate(("ab", "bc", "ca")):
        way = linalg.safe_normalize(sub(vec(q), vec(p)))
        d += [length(linalg.orthogonal_to(tuple(F.col(f"t{k}{end}{c}") for c in "xyz"), way)) for end in "se"]
    most = tris.groupBy("mesh_id").agg(F.max(F.greatest(*d)).alias("_d"))
    out = tris.hint("merge").join(most, "mesh_id")
    return out.withColumn("parts", (F.floor(F.sqrt(3 * F.col("_d") / (4 * tolerance))) + 1).cast("int")).drop("_d")


def refine_to_tolerance(tris: DataFrame, tolerance: float) -> DataFrame:
    """Curved refinement to a tolerance of ``tris`` with tangents."""
    return refine(parts_to_tolerance(tris, tolerance), F.col("parts"))

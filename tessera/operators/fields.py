"""Functions over solids: warps, property channels, lineage ids and level sets.

A warp moves corners by a column expression (in the plan) or by a function of arrays (in batches). Property channels are
rows (mesh_id, vert, props). A level set is made without joins: cells and their samples are rows, every cell is cut by
itself, and vertices are numbered by the grid edge they lie on, so neighbours agree without meeting.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import Vec
from tessera.storage import shuffle_width

CORNERS = [p + c for p in "abc" for c in "xyz"]
TRIANGLES = "mesh_id long, tri long, v0 long, v1 long, v2 long, " + ", ".join(f"{c} double" for c in CORNERS)


def warp(tris: DataFrame, f: Callable[[Column, Column, Column], Vec]) -> DataFrame:
    """Every corner moved by an expression of its place. ``status`` of a solid is found by ``measure.checks``."""
    moved = {p: f(*(F.col(p + c) for c in "xyz")) for p in "abc"}
    return tris.withColumns({p + c: moved[p][k].cast("double") for p in "abc" for k, c in enumerate("xyz")})


def warp_batch(tris: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The same by a function of arrays (n, 3), in Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at = np.asarray(f(frame[CORNERS].to_numpy(float).reshape(-1, 3)), float).reshape(-1, 9)
            yield frame.assign(**{c: at[:, k] for k, c in enumerate(CORNERS)})

    return tris.mapInPandas(run, tris.schema)


def status_of(tris: DataFrame) -> DataFrame:
    """mesh_id, status: NonFiniteVertex if a corner is no finite number, else NoError."""
    bad = F.lit(False)
    for c in CORNERS:
        bad = bad | ~F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False))
    return tris.groupBy("mesh_id").agg(F.when(F.max(bad), "NonFiniteVertex").otherwise("NoError").alias("status"))


def vertices(tris: DataFrame) -> DataFrame:
    """mesh_id, vert, x, y, z of the vertices that triangles use, each once."""
    corners = F.explode(F.array(*(F.struct(F.col(f"v{k}").cast("long").alias("vert"), *(F.col(p + c).alias(c) for c in "xyz")) for k, p in enumerate("abc")))).alias("p")
    return tris.select("mesh_id", corners).select("mesh_id", "p.*").groupBy("mesh_id", "vert").agg(*(F.min(c).alias(c) for c in "xyz"))


def set_properties(verts: DataFrame, n: int, f: Callable[[Vec, Column], list[Column]] | None = None) -> DataFrame:
    """mesh_id, vert, props: ``n`` channels from each place and the old channels; none without ``n``, zeros without ``f``."""
    if n == 0:
        return verts.select("mesh_id", "vert", F.array().cast("array<double>").alias("props"))
    old = F.col("props") if "props" in verts.columns else F.array().cast("array<double>")
    new = f(tuple(F.col(c) for c in "xyz"), old) if f else [F.lit(0.0)] * n
    return verts.select("mesh_id", "vert", F.array(*(x.cast("double") for x in new[:n])).alias("props"))


def dedupe_properties(props: DataFrame) -> DataFrame:
    """mesh_id, vert, prop_vert, props: places whose channels are equal share one row, numbered from 0 in order."""
    df = props.withColumn("first", F.min("vert").over(Window.partitionBy("mesh_id", "place", "props")))
    return df.withColumn("prop_vert", (F.dense_rank().over(Window.partitionBy("mesh_id").orderBy("first")) - 1).cast("long")).select("mesh_id", "vert", "prop_vert", "props")


def interpolate_properties(points: DataFrame, tris: DataFrame, props: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """id, props of points (id, mesh_id, tri, x, y, z) that lie on triangles: the corners' channels by barycentric
    weights; channels that a mesh lacks are 0."""
    from tessera.functions.linalg import barycentric

    df = points.hint("merge").join(tris.select("mesh_id", "tri", "v0", "v1", "v2", *CORNERS), ["mesh_id", "tri"])
    for k in range(3):
        df = df.hint("merge").join(props.select("mesh_id", F.col("vert").alias(f"v{k}"), F.col("props").alias(f"q{k}")), ["mesh_id", f"v{k}"], "left")
    w = barycentric(tuple(F.col(c) for c in "xyz"), tuple(tuple(F.col(p + c) for c in "xyz") for p in "abc"), tolerance)
    df = df.withColumns({f"w{k}": x for k, x in enumerate(w)})
    held = F.zip_with(F.zip_with("q0", "q1", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), F.col("q2"), lambda s, c: s["a"] * F.col("w0") + s["b"] * F.col("w1") + c * F.col("w2"))
    return df.select("id", F.coalesce(held, F.array().cast("array<double>")).alias("props"))


# ---- lineage


def as_original(tris: DataFrame, first_id: int = 0) -> DataFrame:
    """``tris`` with original_id, one for each solid: its mesh_id past the ids reserved so far."""
    return tris.withColumn("original_id", F.col("mesh_id") + first_id)


def runs(tris: DataFrame, instances: DataFrame) -> DataFrame:
    """mesh_id, original_id, n_tri, start: how many triangles of each instance a solid holds, in the order of ids;
    instances (mesh_id, original_id) without triangles keep an empty run."""
    n = tris.groupBy("mesh_id", "original_id").agg(F.count("*").alias("n_tri"))
    df = instances.select("mesh_id", "original_id").hint("merge").join(n, ["mesh_id", "original_id"], "full").withColumn("n_tri", F.coalesce("n_tri", F.lit(0)).cast("long"))
    before = Window.partitionBy("mesh_id").orderBy("original_id").rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("start", F.coalesce(3 * F.sum("n_tri").over(before), F.lit(0)).cast("long"))


# ---- level sets

#: Tetrahedra have the corners 0 and 1 (centres of neighbouring cells) and 2 and 3 (ends of an edge between them).
_EDGES = list(combinations(range(4), 2))


def _cut_cases() -> list[list[tuple[int, int, int]]]:
    """For each set of inside corners (a bit each) the triangles, as numbers of tetrahedron edges, seen from outside.

    Found by geometry on one tetrahedron: the middles of the cut edges, ordered round their centre.
    """
    at = np.array([[0.0, 0, 0], [1, 0, 0], [0.5, -0.5, -0.5], [0.5, 0.5, -0.5]])
    out = []
    for mask in range(16):
        inside = [k for k in range(4) if mask >> k & 1]
        cut = [e for e, (a, b) in enumerate(_EDGES) if (a in inside) != (b in inside)]
        if not cut:
            out.append([])
            continue
        middle = np.array([(at[a] + at[b]) / 2 for a, b in (_EDGES[e] for e in cut)])
        away = at[[k for k in range(4) if k not in inside]].mean(axis=0) - at[inside].mean(axis=0)
        centre = middle.mean(axis=0)
        u = middle[0] - centre
        n = np.cross(middle[1] - middle[0], middle[2] - middle[0])
        n = n if n @ away > 0 else -n
        turn = [np.arctan2(np.cross(u, m - centre) @ n / np.linalg.norm(n), u @ (m - centre)) % (2 * np.pi) for m in middle]
        ring = [cut[k] for k in np.argsort(turn)]
        out.append([(ring[0], ring[k], ring[k + 1]) for k in range(1, len(ring) - 1)])
    return out


_CASES = _cut_cases()
_STEP = 5  # grid places of an edge's ends differ by -2 to 2 half cells an axis
_AXES = {0: (1, 2), 1: (2, 0), 2: (0, 1)}
_NAMES = ["mesh_id", "axis", "i", "j", "k", "ni", "nj", "nk", *(f"{e}_{c}" for e in ("lo", "hi") for c in "xyz")]


def _faces(boxes: DataFrame, edge: float) -> DataFrame:
    """One row a face between two cells of each box's grid (also those at its border, next to a flat outer cell)."""
    df = boxes.select("mesh_id", *(F.col(f"{e}_{c}").cast("double") for e in ("lo", "hi") for c in "xyz"))
    df = df.withColumns({f"n{m}": F.greatest(F.lit(1), F.ceil((F.col(f"hi_{c}") - F.col(f"lo_{c}")) / edge)).cast("int") for m, c in zip("ijk", "xyz", strict=True)})
    # a row becomes tens of faces or far more, so the few rows are dealt evenly before
    df = df.where(" and ".join(f"hi_{c} > lo_{c}" for c in "xyz")).repartition(shuffle_width(boxes.sparkSession))
    df = df.withColumn("axis", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    for k, m in enumerate("ijk"):
        df = df.withColumn(m, F.explode(F.sequence(F.when(F.col("axis") == k, -1).otherwise(0), F.col(f"n{m}") - 1)))
    return df.select(*_NAMES)


def _samples(axis: int) -> list[tuple[int, int, int]]:
    """Half-cell steps from the lower cell's centre to the six points of a face: two centres, four corners round it."""
    b, c = _AXES[axis]
    far = [0, 0, 0]
    far[axis] = 2
    out = [(0, 0, 0), tuple(far)]
    for sb, sc in ((-1, -1), (1, -1), (1, 1), (-1, 1)):
        at = [0, 0, 0]
        at[axis], at[b], at[c] = 1, sb, sc
        out.append(tuple(at))
    return out


def _points(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in half cells (n, 6, 3), positions, and whether each lies on the border."""
    steps = np.array([_samples(a) for a in range(3)])
    half = 2 * frame[["i", "j", "k"]].to_numpy(np.int64)[:, None, :] + 1 + steps[frame["axis"].to_numpy()]
    n = frame[["ni", "nj", "nk"]].to_numpy(np.int64)[:, None, :]
    lo, hi = (frame[[f"{e}_{c}" for c in "xyz"]].to_numpy(float)[:, None, :] for e in ("lo", "hi"))
    border = ((half <= 0) | (half >= 2 * n)).any(axis=2)
    held = np.clip(half, 0, 2 * n)
    part = held / (2 * n)
    return half, np.where(held == 2 * n, hi, lo + (hi - lo) * part), border


def find_surface(f: Callable[[np.ndarray], np.ndarray], p, q, fp, fq, tolerance: float, most: int = 60) -> np.ndarray:
    """Points between ``p`` (inside, fp > 0) and ``q`` where ``f`` is 0, row by row: interpolate, truncate towards the
    middle, project into the bracket that halving would leave (ITP), then one last interpolation."""
    size = np.linalg.norm(q - p, axis=1)
    a, b, fa, fb = np.zeros(len(p)), np.ones(len(p)), fp.astype(float).copy(), fq.astype(float).copy()
    at = lambda t: p + t[:, None] * (q - p)
    slack = np.divide(2 * tolerance, size, out=np.ones_like(size), where=size > 0)
    halvings = np.ceil(np.log2(np.maximum(1 / slack, 1))) + 1
    for step in range(most):
        live = (b - a > slack) & (fa > 0)
        if not live.any():
            break
        middle, reach = (a + b) / 2, slack / 2 * 2.0 ** (halvings - step) - (b - a) / 2
        guess = np.where(fa != fb, (fb * a - fa * b) / np.where(fa != fb, fb - fa, 1), middle)
        way = np.sign(middle - guess)
        shift = np.minimum(0.1 * (b - a) ** 2, np.abs(middle - guess))
        guess = guess + way * shift
        t = np.where(np.abs(guess - middle) <= np.maximum(reach, 0), guess, middle - way * np.maximum(reach, 0))
        t = np.clip(t, a, b)
        ft = np.where(live, f(at(t)), 0.0)
        inside = live & (ft > 0)
        a, fa = np.where(inside, t, a), np.where(inside, ft, fa)
        b, fb = np.where(live & ~inside, t, b), np.where(live & ~inside, ft, fb)
    return at(np.where(fa != fb, (fb * a - fa * b) / np.where(fa != fb, fb - fa, 1), a))


def _cut(frame: pd.DataFrame, half, at, value, border, root) -> pd.DataFrame:
    """Triangles of the tetrahedra round each face. A sample of just 0 is inside, but for those on the border."""
    value = np.where(border, np.minimum(value, 0), value)
    within = (value > 0) | ((value == 0) & ~border)
    n = frame[["ni", "nj", "nk"]].to_numpy(np.int64)
    side = 2 * n + 3
    key = ((half[:, :, 0] + 1) * side[:, None, 1] + half[:, :, 1] + 1) * side[:, None, 2] + half[:, :, 2] + 1
    number = key[:, 0]  # the lower centre's place numbers the face
    out = []
    for t in range(4):
        pick = [0, 1, 2 + t, 2 + (t + 1) % 4]
        mask = (within[:, pick] * np.array([1, 2, 4, 8])).sum(axis=1)
        for case in range(1, 15):
            rows = np.flatnonzero(mask == case)
            if not len(rows):
                continue
            place, where = {}, {}
            for e in sorted({x for tri in _CASES[case] for x in tri}):
                a, b = (pick[x] for x in _EDGES[e])
                swap = key[rows, a] > key[rows, b]
                p, q = np.where(swap, b, a), np.where(swap, a, b)
                hp, hq = half[rows, p], half[rows, q]
                code = ((hq - hp + 2) * np.array([_STEP * _STEP, _STEP, 1])).sum(axis=1)
                place[e] = key[rows, p] * _STEP**3 + code
                where[e] = root(at[rows, p], at[rows, q], value[rows, p], value[rows, q])
            for m, tri in enumerate(_CASES[case]):
                part = {"mesh_id": frame["mesh_id"].to_numpy()[rows], "tri": ((number[rows] * 3 + frame["axis"].to_numpy()[rows]) * 4 + t) * 2 + m}
                part |= {f"v{k}": place[e] for k, e in enumerate(tri)}
                part |= {p + c: where[e][:, x] for p, e in zip("abc", tri, strict=True) for x, c in enumerate("xyz")}
                out.append(pd.DataFrame(part))
    return pd.concat(out) if out else pd.DataFrame({c: [] for c in ["mesh_id", "tri", "v0", "v1", "v2", *CORNERS]})


def _straight(p, q, fp, fq):
    gap = fp - fq
    t = np.divide(fp, gap, out=np.full(len(gap), 0.5), where=gap != 0)
    return p + np.clip(t, 0, 1)[:, None] * (q - p)


def level_set(boxes: DataFrame, sdf: Callable[[Column, Column, Column], Column], edge: float, level: float = 0.0) -> DataFrame:
    """The solid in each box (mesh_id, lo_x..hi_z) where an expression of the place is above ``level``.

    Space is parted into tetrahedra on a body-centred cubic grid of about ``edge``; samples on the border count as at
    most 0, and as outside, so solids close there. Vertices lie where a straight line between two samples meets the level; their
    numbers are exact for the grid edge, not dense. Boxes without extent or with a null give no rows; a sample that is
    null or NaN is outside.
    """
    df = _faces(boxes, edge)
    for s in range(6):
        step = [F.when(F.col("axis") == 0, _samples(0)[s][c]).when(F.col("axis") == 1, _samples(1)[s][c]).otherwise(_samples(2)[s][c]) for c in range(3)]
        place = [F.least(F.greatest(2 * F.col(m) + 1 + step[c], F.lit(0)), 2 * F.col(f"n{m}")) for c, m in enumerate("ijk")]
        at = [F.when(place[c] == 2 * F.col(f"n{m}"), F.col(f"hi_{x}")).otherwise(F.col(f"lo_{x}") + (F.col(f"hi_{x}") - F.col(f"lo_{x}")) * (place[c] / (2 * F.col(f"n{m}")))) for c, (m, x) in enumerate(zip("ijk", "xyz", strict=True))]
        df = df.withColumns({f"_{c}": v for c, v in zip("xyz", at, strict=True)}).withColumn(f"d{s}", (sdf(F.col("_x"), F.col("_y"), F.col("_z")) - level).cast("double")).drop("_x", "_y", "_z")
    # faces whose six samples lie on one side make nothing
    values = [F.coalesce(F.nanvl(F.col(f"d{s}"), F.lit(-1.0)), F.lit(-1.0)) for s in range(6)]
    df = df.withColumns({f"d{s}": v for s, v in enumerate(values)}).where(F.greatest(*(F.col(f"d{s}") for s in range(6))) >= 0)

    def run(frames):
        for frame in frames:
            half, at, border = _points(frame)
            value = frame[[f"d{s}" for s in range(6)]].to_numpy(float)
            yield _cut(frame, half, at, value, border, _straight)

    return df.mapInPandas(run, TRIANGLES)


def level_set_batch(boxes: DataFrame, sdf: Callable[[np.ndarray], np.ndarray], edge: float, level: float = 0.0, tolerance: float = 0.0) -> DataFrame:
    """The same with a function of arrays (n, 3); with a ``tolerance``, vertices are searched for to within it."""

    def run(frames):
        f = lambda p: np.nan_to_num(np.asarray(sdf(p), float) - level, nan=-1.0)
        root = (lambda p, q, fp, fq: _searched(f, p, q, fp, fq, tolerance)) if tolerance > 0 else _straight
        for frame in frames:
            half, at, border = _points(frame)
            value = f(at.reshape(-1, 3)).reshape(-1, 6)
            yield _cut(frame, half, at, value, border, root)

    return _faces(boxes, edge).mapInPandas(run, TRIANGLES)


def _searched(f, p, q, fp, fq, tolerance):
    turned = fp <= 0
    a, b = np.where(turned[:, None], q, p), np.where(turned[:, None], p, q)
    return find_surface(f, a, b, np.where(turned, fq, fp), np.where(turned, fp, fq), tolerance)

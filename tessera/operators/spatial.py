"""Spatial joins and cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import cross, dot, overlap, sub, vec


#: Boxes smaller than 2^LEAST are dealt as if they had that size; those without finite bounds meet all others.
LEAST, ENDLESS = -30, 2000


def _level(df: DataFrame) -> DataFrame:
    """Adds ``level``: the box is at most 2^level wide on every axis; null if its bounds cross or one is null."""
    finite, whole = F.lit(True), F.lit(True)
    for k in "xyz":
        whole = whole & (F.col(f"lo_{k}") <= F.col(f"hi_{k}"))
        for e in ("lo", "hi"):
            finite = finite & (F.abs(F.col(f"{e}_{k}")) < float("inf"))
    wide = F.greatest(*(F.col(f"hi_{k}") - F.col(f"lo_{k}") for k in "xyz"), F.lit(2.0**LEAST))
    return df.withColumn("level", F.when(whole, F.when(finite, F.ceil(F.log2(wide) - 1e-12).cast("int")).otherwise(ENDLESS)))


def _cell(x, level):
    return F.when(level == ENDLESS, 0).otherwise(F.floor(x / F.pow(F.lit(2.0), level))).cast("long")


def _cells(boxes: DataFrame, levels: Column, keys: list[str], name: str) -> DataFrame:
    """One row a grid cell that a box touches on its own level and each coarser one of ``levels``: at most eight a
    level, however large the box is. Columns but ``keys`` get the prefix ``name``."""
    at = F.explode(F.filter(levels, lambda x: x >= F.col("level"))).alias("on")
    df = boxes.select(*keys, *(F.col(c).alias(name + c) for c in boxes.columns if c not in keys and c != "_levels"), at)
    for k in "xyz":
        df = df.withColumn(f"c{k}", F.explode(F.sequence(_cell(F.col(f"{name}lo_{k}"), F.col("on")), _cell(F.col(f"{name}hi_{k}"), F.col("on")))))
    return df


def overlap_join(left: DataFrame, right: DataFrame, self_join: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of boxes (id, lo_x..hi_z, any other columns) that overlap, touching included; for a self join a_id < b_id.
    Columns come with the prefixes a_ and b_; with ``keys``, boxes meet only those with equal ones.

    A box belongs to the level of its width, in powers of two; two boxes meet on the coarser level of both, in the cell
    that holds the lower corner of their common part, so no pair comes twice and nothing is made distinct. The levels
    that occur are listed first: a few dozen numbers, with ``keys`` those of each key alone.

    Boxes with a null bound or a null key meet none; a box whose bounds cross (an empty one) meets none; infinite ones
    meet all they overlap; repeated ids are boxes of their own.
    """
    left, right = _level(left), _level(right)
    every = left.select(*keys, "level").union(right.select(*keys, "level"))
    if keys:
        held = every.groupBy(*keys).agg(F.collect_set("level").alias("_levels"))
        left, right = (df.hint("merge").join(held, list(keys)) for df in (left, right))
        levels = F.col("_levels")
    else:
        levels = F.array(*map(F.lit, sorted({r[0] for r in every.distinct().collect()} - {None}) or [0]))
    a, b = _cells(left, levels, list(keys), "a_"), _cells(right, levels, list(keys), "b_")
    side = lambda n, e: tuple(F.col(f"{n}{e}_{k}") for k in "xyz")
    pairs = a.hint("merge").join(b, [*keys, "on", "cx", "cy", "cz"]).where(F.col("on") == F.greatest("a_level", "b_level"))
    pairs = pairs.where(overlap(side("a_", "lo"), side("a_", "hi"), side("b_", "lo"), side("b_", "hi")))
    for k in "xyz":
        pairs = pairs.where(F.col(f"c{k}") == _cell(F.greatest(f"a_lo_{k}", f"b_lo_{k}"), F.col("on")))
    if self_join:
        pairs = pairs.where("a_id < b_id")
    return pairs.drop("on", "cx", "cy", "cz", "a_level", "b_level")


def triangle_boxes(tris: DataFrame, grow: float = 0.0) -> DataFrame:
    """``tris`` with id (the triangle's number) and its bounds, larger by ``grow`` on every side."""
    bound = lambda f, k: f(*(F.col(p + k) for p in "abc"))
    return tris.withColumn("id", F.col("tri")).withColumns({**{f"lo_{k}": bound(F.least, k) - grow for k in "xyz"}, **{f"hi_{k}": bound(F.greatest, k) + grow for k in "xyz"}})


def edge_boxes(tris: DataFrame) -> DataFrame:
    """mesh_id, id (half-edge), start_v, end_v, both ends (px..qz) and bounds of the forward half-edges, those that run
    to the greater number: one for each edge of a closed solid."""
    sides = F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"v{k}").alias("s"), F.col(f"v{(k + 1) % 3}").alias("e"), *(F.col(p + c).alias("p" + c) for c in "xyz"), *(F.col(q + c).alias("q" + c) for c in "xyz")) for k, (p, q) in enumerate(("ab", "bc", "ca"))))
    df = tris.select("mesh_id", "tri", F.explode(sides).alias("h")).where("h.s < h.e")
    df = df.select("mesh_id", (3 * F.col("tri") + F.col("h.k")).alias("id"), F.col("h.s").alias("start_v"), F.col("h.e").alias("end_v"), *(F.col(f"h.{n}{c}").alias(n + c) for n in "pq" for c in "xyz"))
    return df.withColumns({**{f"lo_{c}": F.least("p" + c, "q" + c) for c in "xyz"}, **{f"hi_{c}": F.greatest("p" + c, "q" + c) for c in "xyz"}})


def edge_crossings(left: DataFrame, right: DataFrame) -> DataFrame:
    """mesh_id, he, tri, sign, x, y, z: where forward edges of one solid pass through triangles of the other, by ids.

    The sign is 1 where the edge leaves through the outside of the triangle and -1 where it enters; ends in the
    triangle's plane count as behind it, so an edge that only touches from outside does not cross.
    """
    pairs = overlap_join(edge_boxes(left).select("mesh_id", "id", *(n + c for n in "pq" for c in "xyz"), *(f"{e}_{c}" for e in ("lo", "hi") for c in "xyz")), triangle_boxes(right), keys=("mesh_id",))
    p, q = vec("a_p"), vec("a_q")
    a, b, c = vec("b_a"), vec("b_b"), vec("b_c")
    n = cross(sub(b, a), sub(c, a))
    hp, hq = dot(sub(p, a), n), dot(sub(q, a), n)
    pairs = pairs.withColumns({"hp": hp, "hq": hq}).where((F.col("hp") > 0) != (F.col("hq") > 0))
    t = F.col("hp") / (F.col("hp") - F.col("hq"))
    pairs = pairs.withColumns({k: p[i] + t * (q[i] - p[i]) for i, k in enumerate("xyz")})
    at = vec("")
    for u, v in ((a, b), (b, c), (c, a)):
        pairs = pairs.where(dot(cross(sub(v, u), sub(at, u)), n) >= 0)
    return pairs.select("mesh_id", F.col("a_id").cast("long").alias("he"), F.col("b_id").cast("long").alias("tri"), F.when(F.col("hq") > 0, 1).otherwise(-1).alias("sign"), "x", "y", "z")


def points_in_rects(rects: DataFrame, points: DataFrame) -> DataFrame:
    """id, point: points (id, x, y) in rectangles (id, lo_x, lo_y, hi_x, hi_y), borders included."""
    flat = rects.select("id", *(F.col(f"{e}_{k}").cast("double") for e in ("lo", "hi") for k in "xy"), F.lit(0.0).alias("lo_z"), F.lit(0.0).alias("hi_z"))
    dots = points.select("id", *(F.col(k).cast("double").alias(f"{e}_{k}") for e in ("lo", "hi") for k in "xy"), F.lit(0.0).alias("lo_z"), F.lit(0.0).alias("hi_z"))
    return overlap_join(flat, dots).select(F.col("a_id").alias("id"), F.col("b_id").alias("point"))


def box_boolean_volume(pairs: DataFrame) -> DataFrame:
    """a, b and the volumes of union, difference and intersection of overlapping axis-aligned boxes, in closed form."""
    size = lambda n: F.lit(1.0) * (F.col(f"{n}hi_x") - F.col(f"{n}lo_x")) * (F.col(f"{n}hi_y") - F.col(f"{n}lo_y")) * (F.col(f"{n}hi_z") - F.col(f"{n}lo_z"))
    both = F.lit(1.0)
    for k in "xyz":
        both = both * (F.least(f"a_hi_{k}", f"b_hi_{k}") - F.greatest(f"a_lo_{k}", f"b_lo_{k}"))
    df = pairs.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), size("a_").alias("va"), size("b_").alias("vb"), both.alias("common"))
    return df.select("a", "b", F.col("common").alias("intersection"), (F.col("va") + F.col("vb") - F.col("common")).alias("union_volume"), (F.col("va") - F.col("common")).alias("difference"))


def slice_segments(tris: DataFrame, height: str = "height") -> DataFrame:
    """mesh_id, tri and the segment in which the plane z = height (a column) cuts each triangle: those whose lowest
    corner is at or below it and whose highest is above; edges upwards give the end, downwards the start."""
    z = {n: F.col(n + "z") for n in "abc"}
    h = F.col(height)
    df = tris.where((F.least(*z.values()) <= h) & (F.greatest(*z.values()) > h))

    def crossing(up: bool, c: str):
        out = F.lit(None).cast("double")
        for p, q in (("a", "b"), ("b", "c"), ("c", "a")):
            rises = (z[p] <= h) & (z[q] > h) if up else (z[p] > h) & (z[q] <= h)
            out = F.coalesce(out, F.when(rises, F.col(p + c) + (F.col(q + c) - F.col(p + c)) * (h - z[p]) / (z[q] - z[p])))
        return out

    return df.select("mesh_id", "tri", *(crossing(up, c).alias(f"{c}{e}") for e, up in ((0, False), (1, True)) for c in "xy"))


def triangulate_convex(points: DataFrame) -> DataFrame:
    """mesh_id, tri, v0, v1, v2 of convex contours (mesh_id, pos): zig-zag from both ends, in closed form."""
    n = points.groupBy("mesh_id").agg(F.count("*").cast("int").alias("n")).where("n >= 3")
    df = n.withColumn("tri", F.explode(F.sequence(F.lit(0), F.col("n") - 3)))
    lo, hi = F.expr("(tri + 1) div 2").cast("int"), F.col("n") - 1 - F.expr("tri div 2").cast("int")
    even = F.col("tri") % 2 == 0
    return df.select("mesh_id", "tri", lo.alias("v0"), (lo + 1).alias("v1"), hi.alias("v2"), even.alias("_e")).select("mesh_id", "tri", "v0", F.when(F.col("_e"), F.col("v1")).otherwise(F.col("v2") - 1).alias("v1"), "v2")


def hull_2d(points: DataFrame) -> DataFrame:
    """mesh_id, pos, x, y: convex hulls of 2D points (mesh_id, x, y), counter-clockwise from the lowest x, y.

    A point strictly inside the triangle fan of extremes cannot be filtered exactly by SQL alone, so points are reduced
    within each partition first, and the few left of each group meet in one task.
    """
    import pandas as pd

    def chain(xy):
        out = []
        for p in xy:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    def ring(frame):
        xy = sorted(set(zip(frame["x"], frame["y"], strict=True)))
        return xy if len(xy) < 3 else chain(xy)[:-1] + chain(xy[::-1])[:-1]

    def reduce(frames):
        for frame in frames:
            yield pd.concat([pd.DataFrame(ring(g), columns=["x", "y"]).assign(mesh_id=k) for k, g in frame.groupby("mesh_id")] or [frame])[["mesh_id", "x", "y"]]

    def finish(frame):
        xy = ring(frame)
        xy = xy if len(xy) >= 3 else []
        return pd.DataFrame({"mesh_id": frame["mesh_id"].iloc[:1].repeat(len(xy)).to_numpy(), "pos": range(len(xy)), "x": [p[0] for p in xy], "y": [p[1] for p in xy]})

    points = points.where("x is not null and y is not null").select("mesh_id", F.col("x").cast("double"), F.col("y").cast("double"))
    return points.mapInPandas(reduce, "mesh_id long, x double, y double").groupBy("mesh_id").applyInPandas(finish, "mesh_id long, pos int, x double, y double")


def prefix_sums(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Adds inclusive and exclusive running sums of ``value`` within ``key``."""
    w = Window.partitionBy(key).orderBy(*order)
    inclusive = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("inclusive", inclusive).withColumn("exclusive", inclusive - F.col(value))

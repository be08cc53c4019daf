"""Constructors from contours, refinement, silhouettes, cuts, pieces and winding numbers.

Solids are triangles (mesh_id, tri, v0, v1, v2, ax..cz), counter-clockwise from outside. Everything is built from the
row at hand; neighbours on a contour come from one window over its mesh_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import Vec, cosd, sind, vec
from tessera.operators.spatial import overlap_join, slice_segments, triangle_boxes
from tessera.operators.topology import halfedges, near_components, paired

_CORNERS = [n + c for n in "abc" for c in "xyz"]


def _triangle(*ends: tuple[Column, Vec]) -> Column:
    """A triangle as a struct from three (vertex number, position)."""
    numbers = (v.cast("long").alias(f"v{k}") for k, (v, _) in enumerate(ends))
    return F.struct(*numbers, *(p[k].cast("double").alias(n + c) for n, (_, p) in zip("abc", ends, strict=True) for k, c in enumerate("xyz")))


def _numbered(df: DataFrame, parts: Column, tri: Column) -> DataFrame:
    """``parts`` (triangle structs, null ones left out) exploded, each numbered by ``tri`` and its place."""
    df = df.select("mesh_id", tri.cast("long").alias("first"), F.posexplode(F.filter(parts, lambda t: t.isNotNull())).alias("place", "t"))
    return df.select("mesh_id", (F.col("first") + F.col("place")).alias("tri"), *(F.col(f"t.{c}") for c in ("v0", "v1", "v2", *_CORNERS)))


def _ring(points: DataFrame) -> DataFrame:
    """Contour points (mesh_id, pos, x, y) with the next point (qx, qy, q), the first one (ox, oy) and their number n."""
    ring = Window.partitionBy("mesh_id").orderBy("pos")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = {c: F.first(c).over(whole) for c in "xy"}
    df = points.select("*", *(F.coalesce(F.lead(c).over(ring), first[c]).alias(f"q{c}") for c in "xy"), *(first[c].alias(f"o{c}") for c in "xy"), F.count("*").over(whole).alias("n"))
    return df.withColumn("q", (F.col("pos") + 1) % F.col("n"))


def extrude(points: DataFrame) -> DataFrame:
    """Solids of convex contours (mesh_id, pos, x, y; per mesh_id height, divisions, twist in degrees, scale_top):
    ``divisions`` + 1 layers, scaled and turned evenly; a scale of 0 makes a cone with one apex.
    A height that is not above 0 gives no solid."""
    return extrude_ring(_ring(points.where("height > 0")))


def extrude_ring(ring: DataFrame, base: Column | None = None) -> DataFrame:
    """``extrude`` of points that know their next one (qx, qy, q), the first one (ox, oy) and their number n, from the
    height ``base`` (a column) on."""
    ring = ring.select("mesh_id", "pos", "x", "y", "qx", "qy", "ox", "oy", "q", "n", "height", "divisions", "twist", "scale_top", (F.lit(0.0) if base is None else base).alias("base"))
    df = ring.where("n >= 3 and height > 0").withColumn("low", F.explode(F.sequence(F.lit(0), F.col("divisions"))))
    df = df.withColumns({"layers": F.col("divisions") + 1, "high": F.col("low") + 1})
    cone = ((F.col("scale_top") == 0) & (F.col("low") == F.col("layers") - 1)).alias("cone")
    lid = ((F.col("high") == F.col("layers")) & ~cone).alias("lid")
    # what a layer and what a corner is made from is worked out once a row: triangles name their corners many times
    knobs = []
    for e in ("low", "high"):
        part = F.col(e) / F.col("layers")
        turn = F.col("twist") * part
        knobs += [(1 + (F.col("scale_top") - 1) * part).alias(f"scale_{e}"), cosd(turn).alias(f"cos_{e}"), sind(turn).alias(f"sin_{e}"), (F.col("height") * part + F.col("base")).alias(f"z_{e}")]
    df = once(df.select("mesh_id", "pos", "x", "y", "qx", "qy", "ox", "oy", "q", "n", "low", "high", cone, lid, *knobs))
    places = []
    for e in ("low", "high"):
        for p in ("", "q", "o"):
            x, y = F.col(f"{p}x") * F.col(f"scale_{e}"), F.col(f"{p}y") * F.col(f"scale_{e}")
            places += [(x * F.col(f"cos_{e}") - y * F.col(f"sin_{e}")).alias(f"{e}_{p}x"), (x * F.col(f"sin_{e}") + y * F.col(f"cos_{e}")).alias(f"{e}_{p}y")]
    df = once(df.select("mesh_id", "pos", "q", "n", "low", "high", "cone", "lid", "z_low", "z_high", *places))

    low, high, n = F.col("low"), F.col("high"), F.col("n")
    at = lambda e, p: (F.col(f"{e}_{p}x"), F.col(f"{e}_{p}y"), F.col(f"z_{e}"))
    number = lambda layer, pos: layer * n + pos
    a, b = (number(low, F.col("pos")), at("low", "")), (number(low, F.col("q")), at("low", "q"))
    top = lambda pos: F.when(F.col("cone"), high * n).otherwise(number(high, pos))
    c, d = (top(F.col("pos")), at("high", "")), (top(F.col("q")), at("high", "q"))
    inner = (F.col("pos") > 0) & (F.col("pos") < n - 1)
    sides = [_triangle(a, b, d), F.when(~F.col("cone"), _triangle(a, d, c))]
    bottom = F.when((low == 0) & inner, _triangle((F.lit(0), at("low", "o")), b, a))
    over = F.when(F.col("lid") & inner, _triangle((number(high, F.lit(0)), at("high", "o")), c, d))
    return _numbered(df, F.array(*sides, bottom, over), 4 * number(low, F.col("pos")))


def revolve(points: DataFrame) -> DataFrame:
    """Full turns of contours right of the axis (mesh_id, pos, x > 0, y; per mesh_id segments); y becomes height."""
    df = _ring(points).where("n >= 3").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("segments") - 1)))
    after = (F.col("k") + 1) % F.col("segments")

    def at(x: str, y: str, k: Column) -> Vec:
        turn = 360.0 * k / F.col("segments")
        return F.col(x) * cosd(turn), F.col(x) * sind(turn), F.col(y)

    number = lambda pos, k: pos * F.col("segments") + k
    a, b = (number(F.col("pos"), F.col("k")), at("x", "y", F.col("k"))), (number(F.col("q"), F.col("k")), at("qx", "qy", F.col("k")))
    c, d = (number(F.col("pos"), after), at("x", "y", after)), (number(F.col("q"), after), at("qx", "qy", after))
    return _numbered(df, F.array(_triangle(a, d, b), _triangle(a, c, d)), 2 * number(F.col("pos"), F.col("k")))


def once(df: DataFrame) -> DataFrame:
    """The same rows, passed through a generator: what is done to the columns afterwards takes their values, and does not
    spell out the expressions that made them again, which outgrows compiled code where they are large."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def _lattice(n: Column) -> list[Column]:
    """(i, j, down) of the small triangles in a face cut ``n`` times an edge, as an array of structs to explode."""
    i = F.sequence(F.lit(0), n - 1)
    return F.flatten(F.transform(i, lambda k: F.transform(F.sequence(F.lit(0), 2 * (n - k) - 2), lambda m: F.struct(k.alias("i"), F.shiftright(m, 1).alias("j"), m.bitwiseAND(F.lit(1)).alias("down")))))


def _octahedral_number(x: Column, y: Column, z: Column, n: Column) -> Column:
    """Number from 0 of the lattice point with |x| + |y| + |z| = n: layer by layer of z, around each ring."""
    r = F.abs(x) + F.abs(y)
    turn = F.when((x > 0) & (y >= 0), y).when((x <= 0) & (y > 0), r - x).when((x < 0) & (y <= 0), 2 * r - y).otherwise(3 * r + x)
    below = F.when(r == 0, 0).otherwise(1 + 2 * r * (r - 1))
    above = 4 * n * n + 2 - (2 * r * r + 2 * r + 1)
    return F.when(z <= 0, below).otherwise(above) + F.when(r == 0, 0).otherwise(turn)


def sphere(instances: DataFrame) -> DataFrame:
    """8 n^2 triangles per instance (mesh_id, radius, n): each face of an octahedron cut n times an edge, then bent.

    A triangle is a row of small integers first; its three corners are numbered and placed once each. Vertices have the
    numbers 0 to 4 n^2 + 1. A radius or n not above 0 gives no solid.
    """
    df = instances.where("n > 0 and radius > 0").select("mesh_id", F.col("radius").cast("double"), F.col("n").cast("long"))
    df = df.select("*", F.explode(_lattice(F.col("n"))).alias("t"))
    df = df.select("mesh_id", "radius", "n", *(F.col(f"t.{c}").alias(c) for c in ("i", "j", "down")), F.explode(F.array(*map(F.lit, range(8)))).alias("octant"))
    sign = {c: 1 - 2 * F.shiftright("octant", k).bitwiseAND(F.lit(1)) for k, c in enumerate("xyz")}
    df = df.withColumns({f"s{c}": v for c, v in sign.items()})
    turned = F.col("sx") * F.col("sy") * F.col("sz") < 0
    # corners of the upright triangle (1, 0), (0, 1), (0, 0) and of the other (1, 1), (0, 1), (1, 0); a mirrored octant
    # takes the last two the other way round
    last = {"b": (F.lit(0), F.lit(1)), "c": (F.col("down"), F.lit(0))}
    steps = {"a": (F.lit(1), F.col("down"))}
    for p, q in (("b", "c"), ("c", "b")):
        steps[p] = tuple(F.when(turned, last[q][k]).otherwise(last[p][k]) for k in range(2))
    places = {}
    for p, (di, dj) in steps.items():
        places |= {f"{p}i": F.col("i") + di, f"{p}j": F.col("j") + dj}
    df = df.select("*", *(v.alias(k) for k, v in places.items()))
    df = df.select("*", *((F.col("n") - F.col(f"{p}i") - F.col(f"{p}j")).alias(f"{p}k") for p in "abc"))
    bent = {f"{p}s{c}": F.sin(F.lit(3.141592653589793 / 2) * F.col(f"{p}{c}") / F.col("n")) for p in "abc" for c in "ijk"}
    df = df.select("*", *(v.alias(k) for k, v in bent.items()))
    scale = {f"{p}r": F.col("radius") / F.sqrt(sum((F.col(f"{p}s{c}") * F.col(f"{p}s{c}") for c in "ijk"), F.lit(0.0))) for p in "abc"}
    df = df.select("*", *(v.alias(k) for k, v in scale.items()))
    number = [_octahedral_number(*(F.col(f"s{c}") * F.col(f"{p}{e}") for c, e in zip("xyz", "ijk", strict=True)), F.col("n")).cast("long").alias(f"v{k}") for k, p in enumerate("abc")]
    at = [(F.col(f"s{c}") * F.col(f"{p}s{e}") * F.col(f"{p}r")).alias(p + c) for p in "abc" for c, e in zip("xyz", "ijk", strict=True)]
    tri = F.col("octant") * F.col("n") * F.col("n") + F.col("i") * (2 * F.col("n") - F.col("i")) + 2 * F.col("j") + F.col("down")
    return once(df.select("mesh_id", tri.cast("long").alias("tri"), *number, *at))


def refine(tris: DataFrame, n: int) -> DataFrame:
    """Each edge in ``n`` parts and so each triangle in n^2; n < 2 is the same solid.

    A new vertex on an edge is numbered by a 64-bit hash of the edge's ends and its place there, so triangles that share
    an edge share its points without a join; ``topology.renumber`` makes the numbers dense.
    """
    if n < 2:
        return tris
    steps = [(i, j, d) for i in range(n) for j in range(n - i) for d in (0, 1) if not d or i + j < n - 1]
    df = tris.select("mesh_id", "tri", *(F.col(f"v{k}").cast("long") for k in range(3)), *_CORNERS, F.posexplode(F.array(*(F.struct(*(F.lit(x).alias(c) for c, x in zip(("i", "j", "down"), s, strict=True))) for s in steps))).alias("place", "t"))
    i, j, down = (F.col(f"t.{c}") for c in ("i", "j", "down"))
    weights = {"a": (i + 1, j + down), "b": (i, j + 1), "c": (i + down, j)}
    out = {}
    for p, (w0, w1) in weights.items():
        out |= {f"{p}0": w0, f"{p}1": w1, f"{p}2": n - w0 - w1}
    df = df.select("*", *(v.alias(f"w_{k}") for k, v in out.items()))

    def number(p: str) -> Column:
        w = [F.col(f"w_{p}{k}") for k in range(3)]
        v = [F.col(f"v{k}") for k in range(3)]
        chain = F.xxhash64(F.least(*v), F.greatest(*v), v[0] + v[1] + v[2], F.lit(n), "tri", w[0], w[1])
        for k in range(3):
            x, y = (k + 1) % 3, (k + 2) % 3
            swap = v[x] > v[y]
            chain = F.when(w[k] == 0, F.xxhash64(F.least(v[x], v[y]), F.greatest(v[x], v[y]), F.when(swap, w[y]).otherwise(w[x]))).otherwise(chain)
        for k in range(3):
            chain = F.when(w[k] == n, v[k]).otherwise(chain)
        return chain

    at = [(sum((F.col(q + c) * F.col(f"w_{p}{k}") for k, q in enumerate("abc")), F.lit(0.0)) / n).alias(f"n_{p}{c}") for p in "abc" for c in "xyz"]
    df = df.select("mesh_id", (F.col("tri") * (n * n) + F.col("place")).alias("tri"), *(number(p).alias(f"v{k}") for k, p in enumerate("abc")), *at)
    return once(df.select("mesh_id", "tri", "v0", "v1", "v2", *(F.col(f"n_{c}").alias(c) for c in _CORNERS)))


def silhouette(tris: DataFrame) -> DataFrame:
    """mesh_id, he and both ends (x0, y0, x1, y1) of half-edges of faces that look up whose neighbour does not."""
    a, b, c = vec("a"), vec("b"), vec("c")
    nz = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    faces = tris.select("mesh_id", "tri", (nz > 0).alias("up"))
    ends = F.array(*(F.struct((3 * F.col("tri") + k).alias("he"), F.col(f"{p}x").alias("x0"), F.col(f"{p}y").alias("y0"), F.col(f"{q}x").alias("x1"), F.col(f"{q}y").alias("y1")) for k, (p, q) in enumerate(("ab", "bc", "ca"))))
    sides = tris.where(nz > 0).select("mesh_id", F.explode(ends).alias("e")).select("mesh_id", "e.*")
    other = faces.where(~F.col("up")).select("mesh_id", F.col("tri").alias("other"))
    pairs = paired(halfedges(tris)).select("mesh_id", "he", F.floor(F.col("paired") / 3).alias("other")).hint("merge").join(other, ["mesh_id", "other"])
    return sides.hint("merge").join(pairs.select("mesh_id", "he"), ["mesh_id", "he"])


def trim_above(tris: DataFrame, height: str = "height") -> DataFrame:
    """mesh_id, ax..cz of what lies above the plane z = ``height`` (a column) of closed solids: clipped triangles, and
    a cap fanned from the mean of the cut's starts (exact in volume for any cut, without overlaps for convex ones)."""
    h = F.col(height)
    over = {n: F.col(n + "z") > h for n in "abc"}
    count = sum((o.cast("int") for o in over.values()), F.lit(0))
    at = lambda n: tuple(F.col(n + c) for c in "xyz")

    def cut(p: str, q: str) -> Vec:
        t = F.try_divide(h - F.col(p + "z"), F.col(q + "z") - F.col(p + "z"))
        return F.col(p + "x") + t * (F.col(q + "x") - F.col(p + "x")), F.col(p + "y") + t * (F.col(q + "y") - F.col(p + "y")), h

    tri = lambda *ps: F.struct(*(p[k].cast("double").alias(n + c) for n, p in zip("abc", ps, strict=True) for k, c in enumerate("xyz")))
    parts = F.when(count == 3, F.array(tri(at("a"), at("b"), at("c"))))
    for p, q, r in ("abc", "bca", "cab"):
        parts = parts.when((count == 1) & over[p], F.array(tri(at(p), cut(p, q), cut(p, r))))
        parts = parts.when((count == 2) & ~over[p], F.array(tri(cut(p, q), at(q), at(r)), tri(cut(p, q), at(r), cut(p, r))))
    kept = tris.select("mesh_id", F.explode(parts).alias("t")).select("mesh_id", "t.*")
    cuts = slice_segments(tris.select("*"), height).hint("merge").join(tris.groupBy("mesh_id").agg(F.first(height).alias("z")), "mesh_id")
    middle = cuts.groupBy("mesh_id").agg(F.avg("x0").alias("mx"), F.avg("y0").alias("my"))
    cap = cuts.hint("merge").join(middle, "mesh_id").select("mesh_id", *(F.col(p).alias(n + c) for n, ps in (("a", ("mx", "my", "z")), ("b", ("x1", "y1", "z")), ("c", ("x0", "y0", "z"))) for c, p in zip("xyz", ps, strict=True)))
    return kept.unionByName(cap)


def compose(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both solids of each mesh_id as one, not merged: the right one's numbers follow the left one's."""
    used = left.groupBy("mesh_id").agg((F.max(F.greatest("v0", "v1", "v2")) + 1).alias("nv"), (F.max("tri") + 1).alias("nt"))
    moved = right.hint("merge").join(used, "mesh_id", "left").withColumns({"nv": F.coalesce("nv", F.lit(0)), "nt": F.coalesce("nt", F.lit(0))})
    moved = moved.withColumns({"tri": F.col("tri") + F.col("nt"), **{f"v{k}": F.col(f"v{k}") + F.col("nv") for k in range(3)}}).select(*right.columns)
    return left.unionByName(moved)


def decompose(tris: DataFrame) -> DataFrame:
    """``tris`` with ``piece``, the smallest vertex of the connected part that a triangle belongs to (numbers below 2^31)."""
    key = lambda v: F.shiftleft(F.col("mesh_id").cast("long"), 31) + F.col(v)
    links = tris.select(F.explode(F.array(*(F.struct(key(p).alias("a"), key(q).alias("b")) for p, q in (("v0", "v1"), ("v1", "v2"))))).alias("l")).select("l.*")
    labels = near_components(links).select("node", F.col("component").bitwiseAND(F.lit((1 << 31) - 1)).alias("piece"))
    whole = tris.select(F.struct("*").alias("row"), key("v0").alias("node")).hint("merge").join(labels, "node")
    return whole.select(*(F.col("row")[c].alias(c) for c in tris.columns if c != "piece"), "piece")


def winding_numbers(points: DataFrame, tris: DataFrame, same_mesh: bool = False) -> DataFrame:
    """id, mesh_id, winding (where not 0) of points (id, x, y, z) in solids: faces that a vertical ray upwards leaves
    through less those it enters by. Points meet the shadows of triangles by a join of boxes over x and y; an edge
    counts for the face on one side of it alone, so rays through edges are counted once. Points with a null or without
    a finite place have no row; repeated points of one id are added up. With ``same_mesh``, points have a mesh_id too
    and meet that solid alone."""
    shade = triangle_boxes(tris.select("mesh_id", "tri", *_CORNERS)).withColumns({"lo_z": F.lit(0.0), "hi_z": F.lit(0.0)})
    dots = points.where(" and ".join(f"abs({c}) < double('infinity')" for c in "xyz")).select("id", *(["mesh_id"] if same_mesh else []), *(F.col(c).cast("double") for c in "xyz"))
    dots = dots.withColumns({f"{e}_{c}": F.col(c) if c != "z" else F.lit(0.0) for e in ("lo", "hi") for c in "xyz"})
    pairs = overlap_join(dots, shade, keys=("mesh_id",)) if same_mesh else overlap_join(dots, shade).withColumnRenamed("b_mesh_id", "mesh_id")
    met = pairs.select(F.col("a_id").alias("id"), "mesh_id", *(F.col(f"a_{c}").alias(f"p{c}") for c in "xyz"), *(F.col(f"b_{c}").alias(c) for c in _CORNERS))

    def crosses(p: str, q: str) -> Column:
        """1 or -1 where a ray to greater x crosses the edge's projection upwards or downwards, else 0."""
        rises, falls = (F.col(p + "y") <= F.col("py")) & (F.col(q + "y") > F.col("py")), (F.col(p + "y") > F.col("py")) & (F.col(q + "y") <= F.col("py"))
        at = lambda p, q: F.col(p + "x") + F.try_divide((F.col("py") - F.col(p + "y")) * (F.col(q + "x") - F.col(p + "x")), F.col(q + "y") - F.col(p + "y"))
        # from the lower end, so that both faces of an edge get the same number
        return F.when(rises & (at(p, q) > F.col("px")), 1).when(falls & (at(q, p) > F.col("px")), -1).otherwise(0)

    a, b, c = vec("a"), vec("b"), vec("c")
    u, v = [b[k] - a[k] for k in range(3)], [c[k] - a[k] for k in range(3)]
    n = u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]
    z = a[2] - F.try_divide(n[0] * (F.col("px") - a[0]) + n[1] * (F.col("py") - a[1]), n[2])
    met = met.withColumn("turn", crosses("a", "b") + crosses("b", "c") + crosses("c", "a")).where("turn <> 0")
    met = met.where((n[2] != 0) & (z > F.col("pz")))
    return met.groupBy("id", "mesh_id").agg(F.sum("turn").alias("winding")).where("winding <> 0")

"""Queries of vector, matrix, quaternion, box and index algebra, and the same by other formulas in SQL.

Vectors are taken from the embeddings: e0, e1, ... are their elements as doubles.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import linalg as L
from tessera.functions import vectors as V
from tessera.operators import columns
from tessera.operators.solids import once
from tessera.plans.queries import _rounded, _table


class Sql(str):
    """SQL text with the operators of numbers."""

    def _with(self, op: str, other) -> Sql:
        return Sql(f"({self} {op} {_sql(other)})")

    def __add__(self, other):
        return self._with("+", other)

    def __radd__(self, other):
        return _sql(other)._with("+", self)

    def __sub__(self, other):
        return self._with("-", other)

    def __rsub__(self, other):
        return _sql(other)._with("-", self)

    def __mul__(self, other):
        return self._with("*", other)

    def __rmul__(self, other):
        return _sql(other)._with("*", self)

    def __truediv__(self, other):
        return self._with("/", other)

    def __neg__(self):
        return Sql(f"(-{self})")


def _sql(x) -> Sql:
    return x if isinstance(x, Sql) else Sql(f"({x})::DOUBLE") if isinstance(x, (int, float)) else Sql(x)


def _add(items):
    items = list(items)
    out = items[0]
    for x in items[1:]:
        out = out + x
    return out


def _root(x) -> Sql:
    return Sql(f"sqrt({x})")


N = 16
E = [Sql(f"e{k}") for k in range(N)]
_FROM = "FROM (SELECT vec_id, " + ", ".join(f"embedding[{k + 1}]::DOUBLE AS e{k}" for k in range(N)) + " FROM embeddings)"


def _elements(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[Column]]:
    df = _table(spark, sf_dir, "embeddings")
    df = df.select("vec_id", *(F.col("embedding")[k].cast("double").alias(f"e{k}") for k in range(N)))
    return df, [F.col(f"e{k}") for k in range(N)]


def _picked(df: DataFrame, cols: dict[str, Column], places: int = 6, plain: tuple[str, ...] = ()) -> DataFrame:
    out = df.select("vec_id", *(c.alias(k) for k, c in cols.items()))
    return _rounded(out, *(k for k in cols if k not in plain), places=places)


def _select(cols: dict[str, Sql], places: int = 6, plain: tuple[str, ...] = ()) -> str:
    return "SELECT vec_id, " + ", ".join(f"{v} AS {k}" if k in plain else f"round({v}, {places}) + 0.0 AS {k}" for k, v in cols.items()) + f" {_FROM}"


def _dot(a, b):
    return _add(x * y for x, y in zip(a, b, strict=True))


def _cross(a, b):
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def _size(a):
    return _root(_dot(a, a))


def _arc(x):
    return Sql(f"acos(least(greatest({x}, -1), 1))")


# ---- vectors

_FLAGS = ("first_least", "first_most", "some", "every", "finite")


def vector_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products, lengths, distances, angles, turns, blends and component folds."""
    df, e = _elements(spark, sf_dir)
    a, b, t = tuple(e[:3]), tuple(e[3:6]), F.abs(e[6])
    c = V.cross(a, b)
    ua, ub = L.unit(a), L.unit(b)
    sl, nl, le, pick = L.slerp(ua, ub, t), L.nlerp(a, b, t), L.lerp(a, b, t), L.select([x > 0 for x in a], a, b)
    turned = L.rotate2(e[6], a[:2])
    cols = {
        "dot": V.dot(a, b), "cx": c[0], "cy": c[1], "cz": c[2], "length": V.length(a), "length2": L.length2(a), "distance": L.distance(a, b), "distance2": L.distance2(a, b),
        "angle": L.angle(ua, ub), "turned_x": turned[0], "turned_y": turned[1], "slerp_x": sl[0], "nlerp_y": nl[1], "lerp_z": le[2], "pick": pick[0] + pick[1] + pick[2],
        "total": L.total(a), "product": L.product(a), "least": L.least_of(a), "most": L.greatest_of(a), "unit_x": L.safe_normalize(a)[0], "no_unit": L.safe_normalize(tuple(x * 0 for x in a))[0],
        "clamped": V.clamp(a[0], -0.05, 0.05), "arc": L.acos(a[0]), "wrapped": L.wrap(40 * a[0]), "beside": V.dot(L.orthogonal_to(a, ub), ub), "first_least": L.argmin(a), "first_most": L.argmax(a),
        "some": L.any_of([x > 0 for x in a]), "every": L.all_of([x > 0 for x in a]), "finite": L.is_finite(a) & ~L.is_finite([a[0] + float("inf")]),
    }
    return _picked(df, {k: (v.cast("int") if k.startswith("first") else v) for k, v in cols.items()}, plain=_FLAGS)


def _vector_sql() -> str:
    a, b, t = E[:3], E[3:6], Sql("abs(e6)")
    c = _cross(a, b)
    ua, ub = [x / _size(a) for x in a], [x / _size(b) for x in b]
    th = _arc(_dot(ua, ub))
    mix = [p * (1 - t) + q * t for p, q in zip(a, b, strict=True)]
    low, high = Sql(f"least({', '.join(a)})"), Sql(f"greatest({', '.join(a)})")
    first = lambda v: Sql(f"CAST(CASE {' '.join(f'WHEN {x} = {v} THEN {k}' for k, x in enumerate(a))} END AS INTEGER)")
    cols = {
        "dot": _dot(a, b), "cx": c[0], "cy": c[1], "cz": c[2], "length": _size(a), "length2": _dot(a, a), "distance": _root(_dot(a, a) + _dot(b, b) - 2 * _dot(a, b)), "distance2": _dot(a, a) + _dot(b, b) - 2 * _dot(a, b),
        "angle": th, "turned_x": a[0] * Sql("cos(e6)") - a[1] * Sql("sin(e6)"), "turned_y": a[0] * Sql("sin(e6)") + a[1] * Sql("cos(e6)"),
        "slerp_x": (ua[0] * Sql(f"sin((1 - {t}) * {th})") + ub[0] * Sql(f"sin({t} * {th})")) / Sql(f"sin({th})"), "nlerp_y": mix[1] / _size(mix), "lerp_z": mix[2],
        "pick": _add(Sql(f"CASE WHEN {x} > 0 THEN {x} ELSE {y} END") for x, y in zip(a, b, strict=True)), "total": a[0] + a[1] + a[2], "product": a[0] * a[1] * a[2], "least": low, "most": high, "unit_x": ua[0], "no_unit": Sql("0.0::DOUBLE"),
        "clamped": Sql("least(greatest(e0, -0.05), 0.05)"), "arc": _arc(a[0]), "wrapped": Sql("CASE WHEN 40 * e0 < -pi() THEN 40 * e0 + 2 * pi() WHEN 40 * e0 > pi() THEN 40 * e0 - 2 * pi() ELSE 40 * e0 END"), "beside": Sql("0.0::DOUBLE"), "first_least": first(low), "first_most": first(high),
        "some": Sql(f"({high} > 0)"), "every": Sql(f"({low} > 0)"), "finite": Sql("true"),
    }
    return _select(cols, plain=_FLAGS)


# ---- matrices


def matrix_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Determinants up to 4x4, adjugates, inverses, products, and what singular values add up to."""
    df, e = _elements(spark, sf_dir)
    m3, m4, m2 = (tuple(tuple(e[n * r : n * r + n]) for r in range(n)) for n in (3, 4, 2))
    # passed on as columns: spelled out in every use, they outgrow compiled code
    df = once(df.withColumns({f"s{k}": v for k, v in enumerate(L.singular_values(m3))}))
    s = [F.col(f"s{k}") for k in range(3)]
    prod, out, one = L.matmul(m3, L.transpose(m3)), L.outer(m3[0], m3[1]), L.matmul(m4, L.inverse(m4))
    cols = {
        "det2": L.determinant(m2), "det3": L.determinant(m3), "det4": L.determinant(m4), "trace": L.trace(m4), "diagonal": L.diagonal(m3)[1], "adjugate": L.adjugate(m3)[0][2], "product": prod[0][1], "outer": out[2][0],
        "applied": L.apply(m3, m3[0])[1], "one": L.trace(one) / 4, "none": one[0][1] + one[3][2], "squares": s[0] * s[0] + s[1] * s[1] + s[2] * s[2], "volume": s[0] * s[1] * s[2], "pairs": s[0] * s[0] * s[1] * s[1] + s[1] * s[1] * s[2] * s[2] + s[2] * s[2] * s[0] * s[0],
        "ordered": (s[0] >= s[1]) & (s[1] >= s[2]),
    }
    return _picked(df, cols, plain=("ordered",))


def _parity(p) -> int:
    return -1 if sum(p[i] > p[j] for i in range(len(p)) for j in range(i + 1, len(p))) % 2 else 1


def _matrix_sql() -> str:
    at = lambda n: lambda r, c: E[n * r + c]

    def det(n):
        m = at(n)
        out = []
        for p in permutations(range(n)):
            term = m(0, p[0])
            for r in range(1, n):
                term = term * m(r, p[r])
            out.append(term if _parity(p) > 0 else -term)
        return _add(out)

    m = at(3)
    gram = [[_add(m(k, r) * m(k, c) for k in range(3)) for c in range(3)] for r in range(3)]
    cols = {
        "det2": det(2), "det3": det(3), "det4": det(4), "trace": E[0] + E[5] + E[10] + E[15], "diagonal": E[4], "adjugate": m(0, 1) * m(1, 2) - m(0, 2) * m(1, 1), "product": _add(m(0, k) * m(1, k) for k in range(3)), "outer": E[2] * E[3],
        "applied": _add(m(1, k) * m(0, k) for k in range(3)), "one": Sql("1.0::DOUBLE"), "none": Sql("0.0::DOUBLE"), "squares": _add(E[k] * E[k] for k in range(9)), "volume": Sql(f"abs({det(3)})"),
        "pairs": gram[0][0] * gram[1][1] - gram[0][1] * gram[1][0] + gram[1][1] * gram[2][2] - gram[1][2] * gram[2][1] + gram[0][0] * gram[2][2] - gram[0][2] * gram[2][0], "ordered": Sql("true"),
    }
    return _select(cols, plain=("ordered",))


# ---- quaternions and matrix makers


def quaternions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, e = _elements(spark, sf_dir)
    p, q, v, t = tuple(e[:4]), tuple(e[4:8]), tuple(e[8:11]), F.abs(e[11])
    up, uq = L.unit(p), L.unit(q)
    one = L.qmul(p, L.qinv(p))
    back, power, step = L.qexp(L.qlog(p)), L.qpow(up, t), L.qslerp(up, uq, t)
    turned, made = L.apply(L.quaternion_matrix(up), v), L.quaternion(L.qaxis(p), L.qangle(p))
    whole = L.qmul(L.qmul(up, (*v, F.lit(0.0))), L.qconj(up))
    cols = {
        "qx": L.qmul(p, q)[0], "qy": L.qmul(p, q)[1], "qw": L.qmul(p, q)[3], "one": one[3], "none": one[0] + one[1] + one[2], "back_x": back[0], "back_w": back[3], "power_w": power[3], "power_x": power[0],
        "angle": L.qangle(p), "axis_y": L.qaxis(p)[1], "step_size": L.length2(step), "step_w": step[3], "turned_x": turned[0], "turned_z": turned[2], "same": whole[0] - turned[0], "made_z": made[2], "log_w": L.qlog(p)[3], "exp_w": L.qexp(p)[3],
    }
    return _picked(df, cols)


def _quaternion_sql() -> str:
    p, q, v, t = E[:4], E[4:8], E[8:11], Sql("abs(e11)")
    sp, sq = _size(p), _size(q)
    up, uq = [x / sp for x in p], [x / sq for x in q]
    half = _arc(up[3])
    im = _size(p[:3])
    d = _dot(up, uq)
    th = _arc(Sql(f"abs({d})"))
    sign = Sql(f"CASE WHEN {d} < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END")
    u = up[:3]
    twice = [2 * x for x in _cross(u, v)]
    turned = [a + up[3] * b + c for a, b, c in zip(v, twice, _cross(u, twice), strict=True)]
    cols = {
        "qx": p[3] * q[0] + p[0] * q[3] + p[1] * q[2] - p[2] * q[1], "qy": p[3] * q[1] - p[0] * q[2] + p[1] * q[3] + p[2] * q[0], "qw": p[3] * q[3] - p[0] * q[0] - p[1] * q[1] - p[2] * q[2], "one": Sql("1.0::DOUBLE"), "none": Sql("0.0::DOUBLE"),
        "back_x": p[0], "back_w": p[3], "power_w": Sql(f"cos({half} * {t})"), "power_x": p[0] / im * Sql(f"sin({half} * {t})"), "angle": 2 * Sql(f"atan2({im}, {p[3]})"), "axis_y": p[1] / im, "step_size": Sql("1.0::DOUBLE"),
        "step_w": (up[3] * Sql(f"sin((1 - {t}) * {th})") + sign * uq[3] * Sql(f"sin({t} * {th})")) / Sql(f"sin({th})"), "turned_x": turned[0], "turned_z": turned[2], "same": Sql("0.0::DOUBLE"),
        "made_z": p[2] / sp, "log_w": Sql(f"ln({sp})"), "exp_w": Sql(f"exp({p[3]}) * cos({im})"),
    }
    return _select(cols)


def matrix_makers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves, scales, poses, cameras, turns in degrees and mirrors, each applied to a point."""
    df, e = _elements(spark, sf_dir)
    v, s, up = tuple(e[:3]), tuple(e[3:6]), L.unit(tuple(e[6:10]))
    eye, center = tuple(e[10:13]), tuple(e[13:16])
    at = (*v, F.lit(1.0))
    camera = L.look_at(eye, center, (F.lit(0.0), F.lit(1.0), F.lit(0.0)))
    seen, here = L.apply(camera, (*center, F.lit(1.0))), L.apply(camera, (*eye, F.lit(1.0)))
    posed = L.apply(L.pose(up, s), at)
    degrees = [F.rint(400 * x) for x in e[3:6]]
    turned, flipped = L.apply(L.euler(*degrees), v), L.apply(L.mirror(s), v)
    cols = {
        "moved": L.apply(L.translation(s), at)[1], "scaled": L.apply(L.scaling(s), at)[2], "posed_x": posed[0], "posed_y": posed[1], "seen_x": seen[0], "seen_z": seen[2], "here": here[0] + here[1] + here[2],
        "turned_x": turned[0], "turned_y": turned[1], "turned_z": turned[2], "flipped_x": flipped[0], "flipped_z": flipped[2], "quarter": L.apply(L.euler(F.lit(90.0), F.lit(0.0), F.lit(0.0)), v)[1],
    }
    return _picked(df, cols)


def _makers_sql() -> str:
    v, s, q = E[:3], E[3:6], E[6:10]
    size = _size(q)
    u, w = [x / size for x in q[:3]], q[3] / size
    twice = [2 * x for x in _cross(u, v)]
    posed = [a + w * b + c + d for a, b, c, d in zip(v, twice, _cross(u, twice), s, strict=True)]
    gap = [a - b for a, b in zip(E[13:16], E[10:13], strict=True)]
    sn = [Sql(f"sin(radians(round_even(400 * {x}, 0)))") for x in s]
    cs = [Sql(f"cos(radians(round_even(400 * {x}, 0)))") for x in s]
    x, y, z = v
    y, z = y * cs[0] - z * sn[0], y * sn[0] + z * cs[0]
    x, z = x * cs[1] + z * sn[1], z * cs[1] - x * sn[1]
    x, y = x * cs[2] - y * sn[2], x * sn[2] + y * cs[2]
    k = 2 * _dot(v, s) / _dot(s, s)
    cols = {
        "moved": v[1] + s[1], "scaled": v[2] * s[2], "posed_x": posed[0], "posed_y": posed[1], "seen_x": Sql("0.0::DOUBLE"), "seen_z": -_size(gap), "here": Sql("0.0::DOUBLE"),
        "turned_x": x, "turned_y": y, "turned_z": z, "flipped_x": v[0] - k * s[0], "flipped_z": v[2] - k * s[2], "quarter": -v[2],
    }
    return _select(cols)


# ---- boxes and rectangles

_BOX_FLAGS = ("holds", "holds_box", "below", "meets", "finite", "rect_empty", "rect_holds", "rect_meets")


def box_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, e = _elements(spark, sf_dir)
    box = (tuple(F.least(e[k], e[k + 3]) for k in range(3)), tuple(F.greatest(e[k], e[k + 3]) for k in range(3)))
    other = (tuple(F.least(e[k], e[k + 3]) for k in range(6, 9)), tuple(F.greatest(e[k], e[k + 3]) for k in range(6, 9)))
    p, v = tuple(e[12:15]), tuple(e[13:16])
    rect, rect2 = (box[0][:2], box[1][:2]), (other[0][:2], other[1][:2])
    both, moved, times = L.box_union(box, other), L.box_moved(box, v), L.box_times(rect, (F.lit(2.0), F.lit(3.0)))
    turned = L.box_transformed(box, tuple(tuple(F.lit(x) for x in row) for row in ((0.0, -2.0, 0.0, 1.0), (3.0, 0.0, 0.0, -1.0), (0.0, 0.0, -1.0, 0.5))))
    cols = {
        "size_x": L.box_size(box)[0], "center_y": L.box_center(box)[1], "scale": L.box_scale(box), "volume": L.box_volume(box), "union_lo": both[0][2], "union_hi": both[1][0], "moved": moved[1][2], "times": times[1][1],
        "turned_lo": turned[0][0], "turned_hi": turned[1][2], "rect_area": L.box_volume(rect), "rect_center": L.box_center(rect)[0], "rect_scale": L.box_scale(rect), "holds": L.box_contains(box, p), "holds_box": L.box_contains_box(both, other),
        "below": L.box_overlaps_below(box, p), "meets": V.overlap(*box, *other), "finite": L.box_is_finite(box), "rect_empty": L.rect_is_empty((rect[1], rect[0])), "rect_holds": L.box_contains(rect, p[:2]),
        "rect_meets": L.all_of([(rect[0][k] <= rect2[1][k]) & (rect2[0][k] <= rect[1][k]) for k in range(2)]),
    }
    return _picked(df, cols, plain=_BOX_FLAGS)


def _box_sql() -> str:
    lo, hi = [Sql(f"least({E[k]}, {E[k + 3]})") for k in range(3)], [Sql(f"greatest({E[k]}, {E[k + 3]})") for k in range(3)]
    lo2, hi2 = [Sql(f"least({E[k]}, {E[k + 3]})") for k in range(6, 9)], [Sql(f"greatest({E[k]}, {E[k + 3]})") for k in range(6, 9)]
    p = E[12:15]
    within = lambda n: Sql(" AND ".join(f"({p[k]} BETWEEN {lo[k]} AND {hi[k]})" for k in range(n)))
    meet = lambda n: Sql("(" + " AND ".join(f"NOT ({lo[k]} > {hi2[k]} OR {lo2[k]} > {hi[k]})" for k in range(n)) + ")")
    gap = [Sql(f"abs({E[k]} - {E[k + 3]})") for k in range(3)]
    cols = {
        "size_x": gap[0], "center_y": (E[1] + E[4]) / 2, "scale": Sql(f"greatest({', '.join(f'abs({E[k]})' for k in range(6))})"), "volume": gap[0] * gap[1] * gap[2], "union_lo": Sql("least(e2, e5, e8, e11)"), "union_hi": Sql("greatest(e0, e3, e6, e9)"),
        "moved": hi[2] + E[15], "times": 3 * hi[1], "turned_lo": 1 - 2 * hi[1], "turned_hi": 0.5 - lo[2], "rect_area": gap[0] * gap[1], "rect_center": (E[0] + E[3]) / 2, "rect_scale": Sql("greatest(abs(e0), abs(e1), abs(e3), abs(e4))"),
        "holds": Sql(f"({within(3)})"), "holds_box": Sql("true"), "below": Sql(f"({within(2)})"), "meets": meet(3), "finite": Sql("true"), "rect_empty": Sql("true"), "rect_holds": Sql(f"({within(2)})"), "rect_meets": meet(2),
    }
    return _select(cols, plain=_BOX_FLAGS)


# ---- triangles

_TRI_FLAGS = ("turn", "before", "before_tie")


def triangle_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Barycentric weights, projections that keep the turn, distances of edges, symbolic order, arcs."""
    df, e = _elements(spark, sf_dir)
    tri, p = tuple(tuple(e[3 * k : 3 * k + 3]) for k in range(3)), tuple(e[9:12])
    w = L.barycentric(p, tri, 1e-9)
    at = tuple(sum((w[k] * tri[k][c] for k in range(1, 3)), w[0] * tri[0][c]) for c in range(3))
    n = V.cross(V.sub(tri[1], tri[0]), V.sub(tri[2], tri[0]))
    flat = [L.projected(n, c) for c in tri]
    arc = L.circular_tangent(tri[0], tri[1])
    cols = {
        "weights": w[0] + w[1] + w[2], "weight": w[1], "below": V.dot(V.sub(at, tri[0]), n), "turn": V.ccw(*flat, 0.0), "before": L.shadows(e[0], e[1], e[2]), "before_tie": L.shadows(e[0], e[0], e[2]),
        "gap": F.sqrt(L.segment_distance2(tri[0], tri[1], tri[2], p)), "touch": L.segment_distance2(tri[0], tri[1], tri[1], p), "arc_w": arc[3], "arc_x": arc[0],
    }
    return _picked(df, cols, plain=_TRI_FLAGS)


def _triangle_sql() -> str:
    a, b, c, p = E[:3], E[3:6], E[6:9], E[9:12]
    minus = lambda x, y: [i - j for i, j in zip(x, y, strict=True)]
    u, v, w = minus(b, a), minus(c, a), minus(p, a)
    uu, uv, vv, uw, vw = _dot(u, u), _dot(u, v), _dot(v, v), _dot(u, w), _dot(v, w)
    # nearest points of two segments over all clamped choices
    q, s = minus(b, a), minus(p, c)

    def to_segment(x, y, z):
        d = minus(z, y)
        t = Sql(f"least(greatest({_dot(minus(x, y), d) / _dot(d, d)}, 0), 1)")
        gap = [i - (j + t * k) for i, j, k in zip(x, y, d, strict=True)]
        return _dot(gap, gap)

    ends = Sql(f"least({to_segment(a, c, p)}, {to_segment(b, c, p)}, {to_segment(c, a, b)}, {to_segment(p, a, b)})")
    n = _cross(q, s)
    r = minus(c, a)
    k, m = _dot(_cross(r, s), n) / _dot(n, n), _dot(_cross(r, q), n) / _dot(n, n)
    line = _dot(r, n) * _dot(r, n) / _dot(n, n)
    gap2 = Sql(f"CASE WHEN {k} BETWEEN 0 AND 1 AND {m} BETWEEN 0 AND 1 THEN least({line}, {ends}) ELSE {ends} END")
    weight = Sql(f"greatest({_dot(a, b) / _size(a) / _size(b)}, 0.5)")
    cols = {
        "weights": Sql("1.0::DOUBLE"), "weight": (vv * uw - uv * vw) / (uu * vv - uv * uv), "below": Sql("0.0::DOUBLE"), "turn": Sql("CAST(1 AS INTEGER)"), "before": Sql("CASE WHEN e0 = e1 THEN e2 < 0 ELSE e0 < e1 END"), "before_tie": Sql("(e2 < 0)"),
        "gap": _root(gap2), "touch": Sql("0.0::DOUBLE"), "arc_w": (2 * weight + 1) / 3, "arc_x": a[0] / _size(a) * _size(b) / (2 * weight + 1),
    }
    return _select(cols, plain=_TRI_FLAGS)


# ---- indices and orders


def index_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _table(spark, sf_dir, "lineitem")
    k, he = F.col("l_linenumber") % 3, F.col("l_orderkey") * 3 + F.col("l_linenumber") % 3
    key = L.encode_place(F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber"))
    x, y, z = L.decode_place(key)
    return line.select("l_orderkey", "l_linenumber", "l_partkey", L.next3(k).cast("int").alias("next3"), L.prev3(k).cast("int").alias("prev3"), L.next_halfedge(he).alias("next_he"), key.alias("place"), (x * 1000003 + y * 1009 + z).alias("back"))


INDEX_SQL = """SELECT l_orderkey, l_linenumber, l_partkey, CAST((l_linenumber + 1) % 3 AS INTEGER) AS next3, CAST((l_linenumber + 2) % 3 AS INTEGER) AS prev3, CAST(l_orderkey * 3 + (l_linenumber + 1) % 3 AS BIGINT) AS next_he,
CAST((l_partkey + 1) * 1099511627776 + (l_suppkey + 1) * 1048576 + l_linenumber + 1 AS BIGINT) AS place, CAST(l_partkey * 1000003 + l_suppkey * 1009 + l_linenumber AS BIGINT) AS back FROM lineitem"""


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), F.col("o_custkey").alias("value"), "o_orderstatus")


def gather_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of orders fetched from other places, sent there, and put in a new order."""
    values = _orders(spark, sf_dir).select("i", "value")
    index = values.select("i", F.floor(F.col("i") * 7 / 3).cast("long").alias("at"))
    back = columns.gather(values, index).withColumnRenamed("value", "gathered")
    sent = columns.scatter(values, values.select("i", F.floor(F.col("i") / 2).cast("long").alias("at"))).withColumnRenamed("value", "scattered")
    turned = columns.permute(values, values.select("i", (F.lit(-1) - F.col("i")).alias("at")).withColumn("at", F.col("at") * -1 - 1)).withColumnRenamed("value", "permuted")
    return back.hint("merge").join(sent, "i", "left").hint("merge").join(turned, "i")


GATHER_SQL = """WITH v AS (SELECT o_orderkey AS i, o_custkey AS value FROM orders), s AS (SELECT i // 2 AS at, max_by(value, i) AS value FROM v GROUP BY ALL)
SELECT v.i, g.value AS gathered, s.value AS scattered, v.value AS permuted FROM v LEFT JOIN v g ON g.i = v.i * 7 // 3 LEFT JOIN s ON s.at = v.i"""


def compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines kept in order, repeats in a row left out, stable ranks."""
    line = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag")
    line = line.withColumn("place", F.row_number().over(_by_line()))
    kept = columns.compact(line, F.col("l_quantity") > 10, "l_orderkey", "place")
    single = columns.unique(kept, "l_orderkey", ["place"], "l_returnflag")
    return columns.stable_order(single, "l_orderkey", "l_returnflag", "place").select("l_orderkey", "place", "i", "rank", "l_returnflag")


def _by_line():
    from pyspark.sql import Window

    return Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")


COMPACT_SQL = """WITH p AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS INTEGER) AS place FROM lineitem),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY place) - 1 AS BIGINT) AS i, lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY place) AS before FROM p WHERE l_quantity > 10)
SELECT l_orderkey, place, i, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag, place) - 1 AS BIGINT) AS rank, l_returnflag FROM k WHERE before IS DISTINCT FROM l_returnflag"""


def radix_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.histogram(_table(spark, sf_dir, "lineitem"), "l_partkey", digits=3)


HISTOGRAM_SQL = "SELECT CAST(digit AS INTEGER) AS digit, CAST((l_partkey >> (8 * digit)) & 255 AS BIGINT) AS bucket, count(*) AS n FROM lineitem, (VALUES (0), (1), (2)) d(digit) GROUP BY ALL"


def column_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").cast("long").alias("q"))
    return columns.folds(line, "l_orderkey", "q", F.col("q") > 10)


FOLDS_SQL = "SELECT l_orderkey, CAST(sum(q) AS BIGINT) AS total, min(q) AS least, max(q) AS most, count(*) FILTER (q > 10) AS n_kept, bool_and(q > 10) AS all_kept FROM (SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS q FROM lineitem) GROUP BY l_orderkey"


def absolute_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sums of absolute values."""
    line = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", (F.col("l_quantity").cast("long") - 25).alias("q"))
    return columns.scans(line, "l_orderkey", ["l_linenumber", "l_partkey", "l_extendedprice"], "q").drop("l_extendedprice", "q")


SCANS_SQL = """WITH l AS (SELECT *, abs(CAST(l_quantity AS BIGINT) - 25) AS q FROM lineitem), s AS (SELECT *, CAST(sum(q) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s FROM l)
SELECT l_orderkey, l_linenumber, l_partkey, s AS abs_inclusive, s - q AS abs_exclusive FROM s"""


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.sequence(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), (F.col("p_size") % 5).alias("n")))


def paired_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as starts and ends along their part numbers, the i-th with the i-th."""
    line = _table(spark, sf_dir, "lineitem")
    edges = line.select(F.col("l_orderkey").alias("key"), (F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("id"), (F.col("l_quantity") % 2 == 0).alias("is_start"), F.col("l_partkey").alias("at"), F.col("l_linenumber").alias("tie"))
    return columns.pair_up(edges)


PAIR_SQL = """WITH e AS (SELECT l_orderkey AS key, l_partkey * 8 + l_linenumber AS id, l_quantity % 2 = 0 AS s, l_partkey AS place, l_linenumber AS tie FROM lineitem),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY key, s ORDER BY place, tie, id) AS INTEGER) AS rank FROM e)
SELECT key, rank, max(CASE WHEN s THEN id END) AS "start", max(CASE WHEN NOT s THEN id END) AS "end" FROM r GROUP BY key, rank"""

QUERIES = {
    f.__name__: f
    for f in (
        vector_algebra, matrix_algebra, quaternions, matrix_makers, box_algebra, triangle_algebra, index_algebra, gather_scatter, compaction, radix_histogram, column_folds, absolute_scans, sequences, paired_events,
    )
}
ORACLE_SQL = {
    "vector_algebra": _vector_sql(),
    "matrix_algebra": _matrix_sql(),
    "quaternions": _quaternion_sql(),
    "matrix_makers": _makers_sql(),
    "box_algebra": _box_sql(),
    "triangle_algebra": _triangle_sql(),
    "index_algebra": INDEX_SQL,
    "gather_scatter": GATHER_SQL,
    "compaction": COMPACT_SQL,
    "radix_histogram": HISTOGRAM_SQL,
    "column_folds": FOLDS_SQL,
    "absolute_scans": SCANS_SQL,
    "sequences": "SELECT p_partkey AS key, CAST(unnest(range(p_size % 5)) AS BIGINT) AS i FROM part",
    "paired_events": PAIR_SQL,
}

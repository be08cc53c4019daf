"""Vector, matrix, quaternion and box algebra on columns.

A vector is a tuple of columns, a matrix a tuple of its rows, a quaternion (x, y, z, w), a box a pair of vectors (lowest
and highest corner). Nothing here moves rows: everything compiles into the projection it stands in. A null in gives a
null out; what is divided by zero is null or as said.
"""

from __future__ import annotations

from functools import reduce
from operator import add, and_, mul, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.vectors import Vec, cross, dot, length, sub

Matrix = tuple[tuple[Column, ...], ...]
PI = 3.141592653589793


# ---- vectors


def total(v) -> Column:
    return reduce(add, v)


def product(v) -> Column:
    return reduce(mul, v)


def least_of(v) -> Column:
    return F.least(*v)


def greatest_of(v) -> Column:
    return F.greatest(*v)


def argmin(v) -> Column:
    """Place of the first smallest component."""
    low, out = F.least(*v), F.lit(len(v) - 1)
    for k in range(len(v) - 2, -1, -1):
        out = F.when(v[k] == low, k).otherwise(out)
    return out


def argmax(v) -> Column:
    return argmin(tuple(-x for x in v))


def any_of(v) -> Column:
    return reduce(or_, v)


def all_of(v) -> Column:
    return reduce(and_, v)


def is_finite(v) -> Column:
    return all_of([F.abs(x) < float("inf") for x in v])


def length2(v) -> Column:
    return total([x * x for x in v])


def distance(a, b) -> Column:
    return F.sqrt(distance2(a, b))


def distance2(a, b) -> Column:
    return length2([p - q for p, q in zip(a, b, strict=True)])


def angle(a, b) -> Column:
    """Angle of two unit vectors of any size, 0 to pi."""
    return acos(total([p * q for p, q in zip(a, b, strict=True)]))


def acos(x: Column) -> Column:
    """Arc cosine, arguments beyond 1 taken as 1."""
    return F.acos(F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0)))


def rotate2(angle: Column, v) -> tuple[Column, Column]:
    """A 2D vector turned counter-clockwise."""
    return v[0] * F.cos(angle) - v[1] * F.sin(angle), v[0] * F.sin(angle) + v[1] * F.cos(angle)


def select(mask, a, b) -> tuple[Column, ...]:
    return tuple(F.when(m, p).otherwise(q) for m, p, q in zip(mask, a, b, strict=True))


def lerp(a, b, t: Column) -> tuple[Column, ...]:
    return tuple(p * (1 - t) + q * t for p, q in zip(a, b, strict=True))


def unit(v) -> tuple[Column, ...]:
    """Over its length; null components where that is 0."""
    size = F.sqrt(length2(v))
    return tuple(F.try_divide(x, size) for x in v)


def nlerp(a, b, t: Column) -> tuple[Column, ...]:
    return unit(lerp(a, b, t))


def slerp(a, b, t: Column) -> tuple[Column, ...]:
    """On the great circle of two unit vectors; the nearer straight way where they are alike."""
    th = angle(a, b)
    near = th == 0
    s = F.sin(th)
    p, q = F.try_divide(F.sin((1 - t) * th), s), F.try_divide(F.sin(t * th), s)
    return tuple(F.when(near, x).otherwise(x * p + y * q) for x, y in zip(a, b, strict=True))


def safe_normalize(v) -> tuple[Column, ...]:
    """The unit vector; zero where there is none that is finite."""
    size = F.sqrt(length2(v))
    good = (size > 0) & (size < float("inf"))
    return tuple(F.when(good, x / size).otherwise(0.0) for x in v)


# ---- matrices


def transpose(m: Matrix) -> Matrix:
    return tuple(zip(*m, strict=True))


def matmul(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(total([row[k] * b[k][c] for k in range(len(b))]) for c in range(len(b[0]))) for row in a)


def apply(m: Matrix, v) -> tuple[Column, ...]:
    return tuple(total([x * y for x, y in zip(row, v, strict=True)]) for row in m)


def outer(a, b) -> Matrix:
    return tuple(tuple(x * y for y in b) for x in a)


def diagonal(m: Matrix) -> tuple[Column, ...]:
    return tuple(m[k][k] for k in range(len(m)))


def trace(m: Matrix) -> Column:
    return total(diagonal(m))


def _minor(m: Matrix, r: int, c: int) -> Matrix:
    return tuple(tuple(x for k, x in enumerate(row) if k != c) for j, row in enumerate(m) if j != r)


def determinant(m: Matrix) -> Column:
    """By the first row; up to 4x4."""
    if len(m) == 1:
        return m[0][0]
    return total([(x if k % 2 == 0 else -x) * determinant(_minor(m, 0, k)) for k, x in enumerate(m[0])])


def adjugate(m: Matrix) -> Matrix:
    n = range(len(m))
    return tuple(tuple((1 if (r + c) % 2 == 0 else -1) * determinant(_minor(m, c, r)) for c in n) for r in n)


def inverse(m: Matrix) -> Matrix:
    """Null components where the determinant is 0."""
    d = determinant(m)
    return tuple(tuple(F.try_divide(x, d) for x in row) for row in adjugate(m))


def translation(v) -> Matrix:
    zero, one = F.lit(0.0), F.lit(1.0)
    return tuple(tuple(one if r == c else v[r] if c == 3 and r < 3 else zero for c in range(4)) for r in range(4))


def scaling(v) -> Matrix:
    zero, one = F.lit(0.0), F.lit(1.0)
    return tuple(tuple((v[r] if r < 3 else one) if r == c else zero for c in range(4)) for r in range(4))


def rotation(q) -> Matrix:
    """4x4 of a unit quaternion."""
    m = quaternion_matrix(q)
    zero = F.lit(0.0)
    return (*((*row, zero) for row in m), (zero, zero, zero, F.lit(1.0)))


def pose(q, v) -> Matrix:
    """Turned by a quaternion, then moved."""
    return matmul(translation(v), rotation(q))


def look_at(eye, center, up) -> Matrix:
    """World to camera: the camera at ``eye`` looks along its negative z axis at ``center``."""
    f = unit(sub(center, eye))
    s = unit(cross(f, up))
    u = cross(s, f)
    rows = (s, u, tuple(-x for x in f))
    return (*((*r, -dot(r, eye)) for r in rows), (F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)))


def euler(x: Column, y: Column, z: Column) -> Matrix:
    """3x3 of turns in degrees about x, then y, then z; exact at multiples of 90."""
    from tessera.functions.vectors import cosd, sind

    one, zero = F.lit(1.0), F.lit(0.0)
    rx = ((one, zero, zero), (zero, cosd(x), -sind(x)), (zero, sind(x), cosd(x)))
    ry = ((cosd(y), zero, sind(y)), (zero, one, zero), (-sind(y), zero, cosd(y)))
    rz = ((cosd(z), -sind(z), zero), (sind(z), cosd(z), zero), (zero, zero, one))
    return matmul(rz, matmul(ry, rx))


def mirror(normal) -> Matrix:
    """3x3 reflection in the plane through the origin with this normal; null where it has no length."""
    n = unit(normal)
    return tuple(tuple((1.0 if r == c else 0.0) - 2 * n[r] * n[c] for c in range(3)) for r in range(3))


def singular_values(m: Matrix) -> tuple[Column, Column, Column]:
    """Of a 3x3 matrix, largest first: roots of the eigenvalues of its transpose times itself, in closed form."""
    a = matmul(transpose(m), m)
    mean = trace(a) / 3
    off = a[0][1] * a[0][1] + a[0][2] * a[0][2] + a[1][2] * a[1][2]
    p = F.sqrt((total([(x - mean) * (x - mean) for x in diagonal(a)]) + 2 * off) / 6)
    b = tuple(tuple(F.try_divide(x - mean if r == c else x, p) for c, x in enumerate(row)) for r, row in enumerate(a))
    phi = acos(F.coalesce(determinant(b) / 2, F.lit(1.0))) / 3
    top, low = mean + 2 * p * F.cos(phi), mean + 2 * p * F.cos(phi + 2 * PI / 3)
    root = lambda x: F.sqrt(F.greatest(x, F.lit(0.0)))
    return root(top), root(3 * mean - top - low), root(low)


def spectral_norm(m: Matrix) -> Column:
    return singular_values(m)[0]


# ---- quaternions


def qmul(p, q) -> tuple[Column, ...]:
    v = cross(p[:3], q[:3])
    return (*(p[3] * q[k] + q[3] * p[k] + v[k] for k in range(3)), p[3] * q[3] - dot(p[:3], q[:3]))


def qconj(q) -> tuple[Column, ...]:
    return -q[0], -q[1], -q[2], q[3]


def qinv(q) -> tuple[Column, ...]:
    size = length2(q)
    return tuple(F.try_divide(x, size) for x in qconj(q))


def qexp(q) -> tuple[Column, ...]:
    size = length(q[:3])
    e = F.exp(q[3])
    return (*(e * F.when(size == 0, 0.0).otherwise(F.try_divide(x * F.sin(size), size)) for x in q[:3]), e * F.cos(size))


def qlog(q) -> tuple[Column, ...]:
    size, whole = length(q[:3]), F.sqrt(length2(q))
    turn = acos(F.try_divide(q[3], whole))
    return (*(F.when(size == 0, 0.0).otherwise(F.try_divide(x * turn, size)) for x in q[:3]), F.log(whole))


def qpow(q, t: Column) -> tuple[Column, ...]:
    """Length to the power, angle times it."""
    size, whole = length(q[:3]), F.sqrt(length2(q))
    turn, grown = acos(F.try_divide(q[3], whole)) * t, F.pow(whole, t)
    return (*(F.when(size == 0, 0.0).otherwise(F.try_divide(x * F.sin(turn) * grown, size)) for x in q[:3]), grown * F.cos(turn))


def qangle(q) -> Column:
    return 2 * F.atan2(length(q[:3]), q[3])


def qaxis(q) -> tuple[Column, ...]:
    return unit(q[:3])


def quaternion(axis, turn: Column) -> tuple[Column, ...]:
    """A turn about a unit axis."""
    return (*(x * F.sin(turn / 2) for x in axis), F.cos(turn / 2))


def quaternion_matrix(q) -> Matrix:
    x, y, z, w = q
    return (
        (w * w + x * x - y * y - z * z, 2 * (x * y - z * w), 2 * (z * x + y * w)),
        (2 * (x * y + z * w), w * w - x * x + y * y - z * z, 2 * (y * z - x * w)),
        (2 * (z * x - y * w), 2 * (y * z + x * w), w * w - x * x - y * y + z * z),
    )


def qslerp(a, b, t: Column) -> tuple[Column, ...]:
    """The shorter way round."""
    d = total([p * q for p, q in zip(a, b, strict=True)])
    return slerp(a, tuple(F.when(d < 0, -x).otherwise(x) for x in b), t)


# ---- boxes (3D) and rectangles (2D)


def box_size(box) -> tuple[Column, ...]:
    return tuple(h - l for l, h in zip(*box, strict=True))


def box_center(box) -> tuple[Column, ...]:
    return tuple((h + l) / 2 for l, h in zip(*box, strict=True))


def box_scale(box) -> Column:
    """Greatest absolute coordinate."""
    return F.greatest(*(F.abs(x) for side in box for x in side))


def box_volume(box) -> Column:
    """Area for rectangles."""
    return product(box_size(box))


def box_union(a, b):
    return tuple(F.least(p, q) for p, q in zip(a[0], b[0], strict=True)), tuple(F.greatest(p, q) for p, q in zip(a[1], b[1], strict=True))


def box_moved(box, v):
    return tuple(tuple(x + y for x, y in zip(side, v, strict=True)) for side in box)


def box_times(box, v):
    return tuple(tuple(x * y for x, y in zip(side, v, strict=True)) for side in box)


def box_transformed(box, m: Matrix):
    """Bounds of a box under an axis-aligned affine matrix (rows of coefficients and offset): corners to corners."""
    ends = [tuple(total([c * x for c, x in zip(row[:-1], side, strict=True)]) + row[-1] for row in m) for side in box]
    return tuple(F.least(p, q) for p, q in zip(*ends, strict=True)), tuple(F.greatest(p, q) for p, q in zip(*ends, strict=True))


def box_contains(box, point) -> Column:
    """Touching counts."""
    return all_of([(x >= l) & (x <= h) for x, l, h in zip(point, *box, strict=True)])


def box_contains_box(box, other) -> Column:
    return box_contains(box, other[0]) & box_contains(box, other[1])


def box_overlaps_below(box, point) -> Column:
    """A vertical line through the point meets the box."""
    return all_of([(point[k] <= box[1][k]) & (point[k] >= box[0][k]) for k in range(2)])


def rect_is_empty(rect) -> Column:
    return any_of([h <= l for l, h in zip(*rect, strict=True)])


def box_is_finite(box) -> Column:
    return is_finite(box[0]) & is_finite(box[1])


# ---- triangles


def main_axis(normal) -> Column:
    """2, 1 or 0: the axis along which the normal is greatest, later ones first."""
    size = [F.abs(x) for x in normal]
    return F.when((size[2] > size[0]) & (size[2] > size[1]), 2).when(size[1] > size[0], 1).otherwise(0)


def projected(normal, p) -> tuple[Column, Column]:
    """A point without the main axis of ``normal``, so that what is counter-clockwise about it stays so."""
    axis, n = main_axis(normal), normal
    x = F.when(axis == 2, p[0]).when(axis == 1, p[2]).otherwise(p[1])
    y = F.when(axis == 2, p[1]).when(axis == 1, p[0]).otherwise(p[2])
    down = F.when(axis == 2, n[2]).when(axis == 1, n[1]).otherwise(n[0]) < 0
    return F.when(down, -x).otherwise(x), y


def barycentric(p, corners, tolerance: float) -> tuple[Column, Column, Column]:
    """Weights of the corners at ``p``: 1 for a corner within the tolerance, on an edge those of its ends, else the ratio
    of areas; triangles without area are taken as their longest edge, points as their first corner."""
    near = [distance2(p, c) < tolerance * tolerance for c in corners]
    edges = [sub(corners[(k + 2) % 3], corners[(k + 1) % 3]) for k in range(3)]  # the edge that faces corner k
    size2 = [length2(e) for e in edges]
    n = cross(sub(corners[1], corners[0]), sub(corners[2], corners[0]))
    area2 = length2(n)
    longest = argmax(size2)
    flat = area2 <= greatest_of(size2) * tolerance * tolerance
    shares = [F.try_divide(dot(cross(edges[k], sub(p, corners[(k + 1) % 3])), n), area2) for k in range(3)]
    along = [F.try_divide(dot(edges[k], sub(p, corners[(k + 1) % 3])), size2[k]) for k in range(3)]  # share of corner k + 2
    away = [length2(cross(edges[k], sub(p, corners[(k + 1) % 3]))) < size2[k] * tolerance * tolerance for k in range(3)]
    out = []
    for c in range(3):
        on = [F.lit(0.0), F.lit(0.0), F.lit(0.0)]
        for k in range(3):
            on[k] = F.lit(0.0) if c == k else along[k] if c == (k + 2) % 3 else 1 - along[k]
        w = F.when(near[0], 1.0 if c == 0 else 0.0).when(near[1], 1.0 if c == 1 else 0.0).when(near[2], 1.0 if c == 2 else 0.0)
        w = w.when(greatest_of(size2) <= tolerance * tolerance, 1.0 if c == 0 else 0.0)
        for k in range(3):
            w = w.when(flat & (longest == k), on[k])
        for k in range(3):
            w = w.when(away[k], on[k])
        out.append(w.otherwise(shares[c]))
    return tuple(out)


def shadows(p: Column, q: Column, direction: Column) -> Column:
    """Whether ``p`` comes before ``q``; equal ones are ordered by the sign of ``direction``."""
    return F.when(p == q, direction < 0).otherwise(p < q)


def segment_distance2(p, q, r, s) -> Column:
    """Squared distance of the segments pq and rs: of their lines where that point lies on both, else of an end and the
    other segment."""
    u, v, w = sub(q, p), sub(s, r), sub(p, r)
    a, b, c, d, e = dot(u, u), dot(u, v), dot(v, v), dot(u, w), dot(v, w)
    det = a * c - b * b
    t, k = F.try_divide(b * e - c * d, det), F.try_divide(a * e - b * d, det)
    inside = (det > 0) & (t >= 0) & (t <= 1) & (k >= 0) & (k <= 1)
    lines = length2(tuple(w[i] + u[i] * t - v[i] * k for i in range(3)))
    ends = F.least(point_segment2(p, r, s), point_segment2(q, r, s), point_segment2(r, p, q), point_segment2(s, p, q))
    return F.when(inside, F.least(lines, ends)).otherwise(ends)


def point_segment2(p, a, b) -> Column:
    u = sub(b, a)
    t = F.coalesce(F.least(F.greatest(F.try_divide(dot(sub(p, a), u), dot(u, u)), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    return distance2(p, tuple(a[i] + u[i] * t for i in range(3)))


# ---- indices and keys


def next3(k: Column) -> Column:
    return F.when(k == 2, 0).otherwise(k + 1)


def prev3(k: Column) -> Column:
    return F.when(k == 0, 2).otherwise(k - 1)


def next_halfedge(he: Column) -> Column:
    return F.when(he % 3 == 2, he - 2).otherwise(he + 1)


def encode_place(x: Column, y: Column, z: Column, bits: int = 20) -> Column:
    """A place of a grid as one long; coordinates from -1 up to 2^bits - 2, the first one up to 2^(63 - 2 bits) - 2."""
    up = [(c + 1).cast("long") for c in (x, y, z)]
    return F.shiftleft(up[0], 2 * bits).bitwiseOR(F.shiftleft(up[1], bits)).bitwiseOR(up[2])


def decode_place(key: Column, bits: int = 20) -> tuple[Column, Column, Column]:
    mask = F.lit((1 << bits) - 1)
    return F.shiftright(key, 2 * bits) - 1, F.shiftright(key, bits).bitwiseAND(mask) - 1, key.bitwiseAND(mask) - 1


def wrap(x: Column) -> Column:
    """An angle from -pi to pi."""
    return F.when(x < -PI, x + 2 * PI).when(x > PI, x - 2 * PI).otherwise(x)


def angle_between(a, b) -> Column:
    """0 to pi, of unit vectors."""
    return angle(a, b)


def orthogonal_to(v, reference) -> tuple[Column, ...]:
    """``v`` less its part along the unit vector ``reference``."""
    along = dot(v, reference)
    return tuple(x - along * y for x, y in zip(v, reference, strict=True))


def circular_tangent(tangent, edge) -> tuple[Column, ...]:
    """Weighted tangent (x, y, z, w) of a quarter-like arc over ``edge`` that leaves along ``tangent``."""
    way = safe_normalize(tangent)
    w = F.greatest(dot(way, safe_normalize(edge)), F.lit(0.5))
    half = length(edge) / 2
    # the control point in homogeneous form, brought down from a quadratic to a cubic curve
    return (*(F.lit(2.0 / 3) * x * half / (w * 2.0 / 3 + 1.0 / 3) for x in way), (w * 2.0 / 3 + 1.0 / 3))

"""Scalar and vector expressions on columns. A vector is a tuple of three columns, a box a pair of vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(prefix: str) -> Vec:
    return F.col(prefix + "x"), F.col(prefix + "y"), F.col(prefix + "z")


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def length(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def sind(x: Column) -> Column:
    """Sine of degrees, exact at multiples of 90."""
    turn = F.pmod(F.rint(x / 90).cast("long"), F.lit(4))
    rest = F.radians(x - 90 * F.rint(x / 90))
    return F.when(turn == 0, F.sin(rest)).when(turn == 1, F.cos(rest)).when(turn == 2, -F.sin(rest)).otherwise(-F.cos(rest))


def cosd(x: Column) -> Column:
    return sind(x + 90)


def smoothstep(lo: float, hi: float, x: Column) -> Column:
    t = F.least(F.greatest((x - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0))
    return t * t * (3 - 2 * t)


def ccw(p, q, r, tolerance: float) -> Column:
    """1, 0 or -1: the turn of three 2D points, 0 within the tolerance of a line."""
    ux, uy, vx, vy = q[0] - p[0], q[1] - p[1], r[0] - p[0], r[1] - p[1]
    area, base = ux * vy - uy * vx, F.greatest(ux * ux + uy * uy, vx * vx + vy * vy)
    return F.when(4 * area * area <= base * tolerance * tolerance, 0).when(area > 0, 1).otherwise(-1)


def overlap(a_lo: Vec, a_hi: Vec, b_lo: Vec, b_hi: Vec) -> Column:
    """Boxes that touch overlap."""
    out = F.lit(True)
    for k in range(3):
        out = out & (a_lo[k] <= b_hi[k]) & (b_lo[k] <= a_hi[k])
    return out


def spread_bits(x: Column) -> Column:
    """Ten bits, two zeros between each."""
    for shift, mask in ((16, 0x030000FF), (8, 0x0300F00F), (4, 0x030C30C3), (2, 0x09249249)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return x


def morton(p: Vec, lo: Vec, hi: Vec) -> Column:
    """30-bit Morton code of a point in a box: 1024 steps an axis, x highest."""
    step = [F.least(F.greatest(F.floor(1024 * (p[k] - lo[k]) / (hi[k] - lo[k])), F.lit(0)), F.lit(1023)).cast("long") for k in range(3)]
    return 4 * spread_bits(step[0]) + 2 * spread_bits(step[1]) + spread_bits(step[2])


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a * (1 - t) + b * t


def clamp(x: Column, lo, hi) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def normalized(a: Vec) -> Vec:
    """Unit vector; zero where there is none."""
    size = length(a)
    return tuple(F.when(size > 0, x / size).otherwise(0.0) for x in a)


def determinant(rows: tuple[Vec, Vec, Vec]) -> Column:
    return dot(rows[0], cross(rows[1], rows[2]))


def inverse(rows: tuple[Vec, Vec, Vec]) -> tuple[Vec, Vec, Vec]:
    """Inverse of a 3x3 matrix; null where the determinant is 0."""
    d = determinant(rows)
    columns = cross(rows[1], rows[2]), cross(rows[2], rows[0]), cross(rows[0], rows[1])
    return tuple(tuple(F.when(d != 0, columns[c][r] / d) for c in range(3)) for r in range(3))


def quaternion_product(p: tuple, q: tuple) -> tuple:
    """Of quaternions (x, y, z, w)."""
    v = cross(p[:3], q[:3])
    return (*(p[3] * q[k] + q[3] * p[k] + v[k] for k in range(3)), p[3] * q[3] - dot(p[:3], q[:3]))


def circular_segments(radius: Column, angle: float = 10.0, edge: float = 1.0) -> Column:
    """Segments of a circle: the fewer of those that a smallest angle and a smallest edge ask for, in fours, 4 at least."""
    n = F.least(F.lit(int(360 / angle)), F.floor(2 * 3.141592653589793 * radius / edge)).cast("int") + 3
    return F.greatest(n - n % 4, F.lit(4))

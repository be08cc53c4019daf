"""Solids as rows. A solid is generated once per row of an instance table, without a join: literal shapes have a
fixed few triangles, which are exploded."""

from __future__ import annotations

import math
from itertools import combinations, product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import cosd, sind

#: Corners of the unit cube are numbered 4x + 2y + z; each face is a quad seen counter-clockwise from outside.
CUBE_FACES = ((0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3))
CUBE_VERTS = tuple((v >> 2 & 1, v >> 1 & 1, v & 1) for v in range(8))
CUBE = tuple(t for a, b, c, d in CUBE_FACES for t in ((a, b, c), (a, c, d)))
#: Alternate corners of a cube of side two around the origin, in the order of their coordinates.
TETRA_VERTS = tuple(sorted(v for v in product((-1, 1), repeat=3) if v[0] * v[1] * v[2] == 1))
OCTA_VERTS = ((-1, 0, 0), (0, -1, 0), (0, 0, -1), (0, 0, 1), (0, 1, 0), (1, 0, 0))


def _outward(verts, face) -> tuple[int, int, int]:
    """The face of a solid around the origin, seen counter-clockwise from outside."""
    (ax, ay, az), (bx, by, bz), (cx, cy, cz) = (verts[v] for v in face)
    turn = ax * (by * cz - bz * cy) + ay * (bz * cx - bx * cz) + az * (bx * cy - by * cx)
    return face if turn > 0 else (face[0], face[2], face[1])


#: Every three corners are a face, those of the octahedron that have no two opposite ones.
TETRA = tuple(_outward(TETRA_VERTS, f) for f in combinations(range(4), 3))
OCTA = tuple(_outward(OCTA_VERTS, f) for f in combinations(range(6), 3) if all(i + j != 5 for i, j in combinations(f, 2)))
SHAPES = {"cube": (CUBE_VERTS, CUBE), "tetrahedron": (TETRA_VERTS, TETRA), "octahedron": (OCTA_VERTS, OCTA)}


def triangles(instances: DataFrame, shape: str = "cube") -> DataFrame:
    """mesh_id, tri, v0, v1, v2 and corners (ax..cz) of one ``shape`` per instance (mesh_id, sx, sy, sz, tx, ty, tz):
    scaled, then moved. A negative determinant turns triangles over, so that outside stays outside."""
    verts, faces = SHAPES[shape]

    def rows(order: tuple[int, int, int]):
        """All triangles as one literal, their corners in this order."""
        turned = [[f[i] for i in order] for f in faces]
        return F.array(*(F.struct(F.lit(k).alias("tri"), *(F.lit(v).alias(f"v{i}") for i, v in enumerate(f)), *(F.lit(float(verts[v][a])).alias(f"{n}{c}") for n, v in zip("abc", f, strict=True) for a, c in enumerate("xyz"))) for k, f in enumerate(turned)))

    # turned over before they are exploded: a corner stays one product and one sum wherever later steps spell it out again
    df = instances.withColumn("t", F.explode(F.when((F.col("sx") * F.col("sy") * F.col("sz")) < 0, rows((0, 2, 1))).otherwise(rows((0, 1, 2)))))
    corners = [(F.col(f"t.{n}{c}") * F.col(f"s{c}") + F.col(f"t{c}")).alias(n + c) for n in "abc" for c in "xyz"]
    return df.select("mesh_id", *(F.col(f"t.{c}").alias(c) for c in ("tri", "v0", "v1", "v2")), *corners)


def circle(instances: DataFrame, segments: str = "segments") -> DataFrame:
    """mesh_id, pos, x, y of a regular polygon per instance (mesh_id, radius, segments), counter-clockwise."""
    df = instances.withColumn("pos", F.explode(F.sequence(F.lit(0), F.col(segments) - 1)))
    angle = 360.0 * F.col("pos") / F.col(segments)
    return df.select("mesh_id", "pos", (F.col("radius") * cosd(angle)).alias("x"), (F.col("radius") * sind(angle)).alias("y"))


def sphere_vertices(instances: DataFrame) -> DataFrame:
    """mesh_id, octant lattice place and position per instance (mesh_id, radius, n): each octahedron face cut n times
    an edge; lattice points shared by faces come once, since their signed integer place is the key."""
    n = F.col("n")
    df = instances.withColumn("i", F.explode(F.sequence(-n, n))).withColumn("j", F.explode(F.sequence(F.abs("i") - n, n - F.abs("i"))))
    left = n - F.abs("i") - F.abs("j")
    df = df.withColumn("k", F.explode(F.when(left == 0, F.array(F.lit(0))).otherwise(F.array(-left, left))))
    bent = {a: F.signum(F.col(a)) * F.sin(F.lit(3.141592653589793 / 2) * F.abs(a) / n) for a in "ijk"}
    size = F.sqrt(sum((b * b for b in bent.values()), F.lit(0.0)))
    return df.select("mesh_id", "i", "j", "k", *((F.col("radius") * bent[a] / size).alias(c) for a, c in zip("ijk", "xyz", strict=True)))


def affine(tris: DataFrame, matrix: list[float]) -> DataFrame:
    """Triangles under a 3x4 row-major matrix; turned over where its determinant is negative."""
    m = [matrix[k : k + 4] for k in (0, 4, 8)]
    d = sum(m[0][i] * (m[1][(i + 1) % 3] * m[2][(i + 2) % 3] - m[1][(i + 2) % 3] * m[2][(i + 1) % 3]) for i in range(3))
    moved = {n: {c: m[r][0] * F.col(n + "x") + m[r][1] * F.col(n + "y") + m[r][2] * F.col(n + "z") + m[r][3] for r, c in enumerate("xyz")} for n in "abc"}
    order, ends = ("abc", ("v0", "v1", "v2")) if d >= 0 else ("acb", ("v0", "v2", "v1"))
    return tris.select("mesh_id", "tri", *(F.col(e).alias(f"v{i}") for i, e in enumerate(ends)), *(moved[o][c].alias(n + c) for n, o in zip("abc", order, strict=True) for c in "xyz"))


def rotation(x: float, y: float = 0.0, z: float = 0.0) -> list[float]:
    """3x4 matrix of turns in degrees about x, then y, then z; exact at multiples of 90."""

    def both(degrees: float) -> tuple[float, float]:
        quarter = round(degrees / 90)
        rest = math.radians(degrees - 90 * quarter)
        s, c = math.sin(rest), math.cos(rest)
        return ((s, c), (c, -s), (-s, -c), (-c, s))[quarter % 4]

    (sx, cx), (sy, cy), (sz, cz) = both(x), both(y), both(z)
    return [
        cy * cz, sx * sy * cz - cx * sz, cx * sy * cz + sx * sz, 0.0,
        cy * sz, sx * sy * sz + cx * cz, cx * sy * sz - sx * cz, 0.0,
        -sy, sx * cy, cx * cy, 0.0,
    ]


def reflection(x: float, y: float, z: float) -> list[float]:
    """3x4 matrix of the mirror through the origin with this normal."""
    n, size = (x, y, z), x * x + y * y + z * z
    return [v for r in range(3) for v in (*((1.0 if r == c else 0.0) - 2 * n[r] * n[c] / size for c in range(3)), 0.0)]


def translate(tris: DataFrame, x: float, y: float, z: float) -> DataFrame:
    return affine(tris, [1.0, 0.0, 0.0, x, 0.0, 1.0, 0.0, y, 0.0, 0.0, 1.0, z])


def scale(tris: DataFrame, x: float, y: float, z: float) -> DataFrame:
    return affine(tris, [x, 0.0, 0.0, 0.0, 0.0, y, 0.0, 0.0, 0.0, 0.0, z, 0.0])


def rotate(tris: DataFrame, x: float, y: float = 0.0, z: float = 0.0) -> DataFrame:
    return affine(tris, rotation(x, y, z))


def mirror(tris: DataFrame, x: float, y: float, z: float) -> DataFrame:
    """No rows if the normal has no length."""
    return affine(tris, reflection(x, y, z)) if x * x + y * y + z * z > 0 else tris.where("false")

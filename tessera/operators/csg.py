"""Solids as expressions: ``(a.translate(1, 0, 0) + b - c).triangles()``.

An expression is a small tree on the driver; nothing is computed until its triangles are asked for. Before that, nests of
one operation become one node, a difference of a difference takes all that is to go at once, and moves are multiplied and
pushed to the leaves, where they are one projection. A node used twice in a tree is computed once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import booleans, shapes
from tessera.storage import materialize

_IDENTITY = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0]


def _times(a: list[float], b: list[float]) -> list[float]:
    """The 3x4 matrix that does ``b``, then ``a``."""
    return [sum(a[4 * r + k] * b[4 * k + c] for k in range(3)) + (a[4 * r + 3] if c == 3 else 0.0) for r in range(3) for c in range(4)]


class Solid:
    """A leaf (a table of triangles) or an operation on solids, under a matrix."""

    def __init__(self, tris: DataFrame | None = None, op: str = "leaf", children: tuple[Solid, ...] = (), matrix: list[float] | None = None):
        self.tris, self.op, self.children, self.matrix = tris, op, children, matrix or _IDENTITY
        self._found: DataFrame | None = None

    # moves

    def transform(self, matrix: list[float]) -> Solid:
        return Solid(self.tris, self.op, self.children, _times(matrix, self.matrix))

    def translate(self, x: float, y: float, z: float) -> Solid:
        return self.transform([1.0, 0.0, 0.0, x, 0.0, 1.0, 0.0, y, 0.0, 0.0, 1.0, z])

    def scale(self, x: float, y: float, z: float) -> Solid:
        return self.transform([x, 0.0, 0.0, 0.0, 0.0, y, 0.0, 0.0, 0.0, 0.0, z, 0.0])

    def rotate(self, x: float, y: float = 0.0, z: float = 0.0) -> Solid:
        return self.transform(shapes.rotation(x, y, z))

    def mirror(self, x: float, y: float, z: float) -> Solid:
        return self.transform(shapes.reflection(x, y, z))

    # set operations

    def __add__(self, other: Solid) -> Solid:
        return Solid(op="add", children=(self, other))

    def __sub__(self, other: Solid) -> Solid:
        return Solid(op="subtract", children=(self, other))

    def __xor__(self, other: Solid) -> Solid:
        return Solid(op="intersect", children=(self, other))

    @staticmethod
    def batch(solids: list[Solid], op: str = "add") -> Solid:
        return solids[0] if len(solids) == 1 else Solid(op=op, children=tuple(solids))

    # plan

    def flat(self) -> Solid:
        """The same solid with nests of one operation as one node and matrices at the leaves alone."""
        if self.op == "leaf":
            return self
        parts = [Solid(c.tris, c.op, c.children, _times(self.matrix, c.matrix)).flat() if self.matrix != _IDENTITY else c.flat() for c in self.children]
        out: list[Solid] = []
        for k, c in enumerate(parts):
            if self.op in ("add", "intersect") and c.op == self.op:
                out += c.children
            elif self.op == "subtract" and k == 0 and c.op == "subtract":
                out += c.children
            elif self.op == "subtract" and k > 0 and c.op == "add":
                out += c.children
            else:
                out.append(c)
        return Solid(op=self.op, children=tuple(out))

    def describe(self) -> str:
        """The plan as text."""
        return "leaf" if self.op == "leaf" else f"{self.op}({', '.join(c.describe() for c in self.children)})"

    def triangles(self) -> DataFrame:
        """Triangles of the flattened plan; every node is written once."""
        return self.flat()._compute({})

    def _compute(self, seen: dict) -> DataFrame:
        if id(self) in seen:
            return seen[id(self)]
        if self.op == "leaf":
            out = self.tris if self.matrix == _IDENTITY else shapes.affine(self.tris, self.matrix)
        else:
            parts = [c._compute(seen).select(*booleans._NAMES).withColumn("part", F.lit(k)) for k, c in enumerate(self.children)]
            out = materialize(booleans.batch(reduce(DataFrame.unionByName, parts), self.op), "csg")
        seen[id(self)] = out
        return out

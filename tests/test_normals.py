"""Normals of corners: fans are found where the corners of a vertex lie, without joins."""

import math

import pytest

from tessera.operators import shapes, smooth

from test_components import pieces


def by_hand(rows, limit):
    """{(mesh_id, tri, k): normal} by union-find over the corners of each vertex."""
    sub = lambda p, q: [x - y for x, y in zip(p, q, strict=True)]
    dot = lambda p, q: sum(x * y for x, y in zip(p, q, strict=True))
    size = lambda p: math.sqrt(dot(p, p))
    face, sides, links, weight = {}, {}, [], {}
    for r in rows:
        at = [[r[p + c] for c in "xyz"] for p in "abc"]
        u, v = sub(at[1], at[0]), sub(at[2], at[0])
        n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
        face[r.mesh_id, r.tri] = [x / size(n) for x in n]
        for k in range(3):
            x, y = sub(at[(k + 1) % 3], at[k]), sub(at[(k + 2) % 3], at[k])
            weight[r.mesh_id, r.tri, k] = math.acos(max(-1.0, min(1.0, dot(x, y) / size(x) / size(y))))
            sides[r.mesh_id, r[f"v{k}"], r[f"v{(k + 1) % 3}"]] = (r.tri, k)
    links += [(c, c) for c in weight]
    for (m, s, e), (t, k) in sides.items():
        if (m, e, s) in sides:
            o, j = sides[m, e, s]
            if math.degrees(math.acos(max(-1.0, min(1.0, dot(face[m, t], face[m, o]))))) <= limit:
                links += [((m, t, k), (m, o, (j + 1) % 3)), ((m, t, (k + 1) % 3), (m, o, j))]
    fan, sums = pieces(links), {}
    for (m, t, k), w in weight.items():
        held = sums.setdefault(fan[m, t, k], [0.0] * 3)
        for i in range(3):
            held[i] += w * face[m, t][i]
    return {c: [x / size(sums[fan[c]]) for x in sums[fan[c]]] for c in weight}


@pytest.mark.parametrize("limit", [30.0, 60.0, 100.0])
def test_corner_normals_by_hand(spark, limit):
    sizes = spark.createDataFrame([(k, 1.0 + k, 2.0, 0.5 * k + 0.25, 0.0, 0.0, 0.0) for k in range(6)] + [(None, *[1.0] * 6)], "mesh_id long, sx double, sy double, sz double, tx double, ty double, tz double")
    for shape in ("cube", "octahedron"):
        # two faces are taken away from one solid
        tris = shapes.triangles(sizes, shape).where("mesh_id is null or mesh_id <> 3 or tri > 1")
        out = smooth.corner_normals(tris, limit)
        assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
        want = by_hand(tris.where("mesh_id is not null").collect(), limit)
        found = {(r.mesh_id, r.tri, r.k): (r.nx, r.ny, r.nz) for r in out.collect()}
        assert found.keys() == want.keys()
        assert all(found[c] == pytest.approx(want[c], abs=1e-12) for c in want)

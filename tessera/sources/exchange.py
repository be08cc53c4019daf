"""Meshes as exchange records, one row a mesh: loading with a status, merging of open edges, export.

A record has flat arrays: ``vert_properties`` (``num_prop`` numbers a vertex, the first three its place), ``tri_verts``,
``merge_from`` and ``merge_to`` (vertices that are one), ``run_index``, ``run_original_id``, ``run_transform`` (12 numbers
a run), ``face_id``, ``halfedge_tangent``, ``tolerance``. A missing or null array is an empty one. Errors are data: a
status, never an exception; a mesh with one other than NoError has no triangles.

One record is one row, so a single mesh must fit an executor; triangles are exploded before anything is compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.spatial import overlap_join
from tessera.operators.topology import connected_components, halfedges, open_edges, undirected

#: The names of what can be wrong with a mesh, and what they mean.
STATUS = {
    "NoError": "No Error",
    "NonFiniteVertex": "Non Finite Vertex",
    "NotManifold": "Not Manifold",
    "VertexOutOfBounds": "Vertex Out Of Bounds",
    "PropertiesWrongLength": "Properties Wrong Length",
    "MissingPositionProperties": "Missing Position Properties",
    "MergeVectorsDifferentLengths": "Merge Vectors Different Lengths",
    "MergeIndexOutOfBounds": "Merge Index Out Of Bounds",
    "TransformWrongLength": "Transform Wrong Length",
    "RunIndexWrongLength": "Run Index Wrong Length",
    "FaceIDWrongLength": "Face ID Wrong Length",
    "InvalidConstruction": "Invalid Construction",
    "ResultTooLarge": "Result Too Large",
}
RECORD = (
    "mesh_id long, num_prop int, vert_properties array<double>, tri_verts array<long>, merge_from array<long>, merge_to array<long>, "
    "run_index array<long>, run_original_id array<int>, run_transform array<double>, face_id array<long>, halfedge_tangent array<double>, tolerance double"
)
_ARRAYS = {"vert_properties": "double", "tri_verts": "bigint", "merge_from": "bigint", "merge_to": "bigint", "run_index": "bigint", "run_original_id": "int", "run_transform": "double", "face_id": "bigint", "halfedge_tangent": "double"}
#: Least tolerance as a share of the greatest coordinate, for places in double and in single precision.
PRECISION, SINGLE = 1e-12, 2.0**-23


def text_of(status: Column) -> Column:
    """The words for a status."""
    return F.create_map(*(F.lit(x) for pair in STATUS.items() for x in pair))[status]


def _whole(meshes: DataFrame) -> DataFrame:
    """All fields, missing and null arrays empty."""
    held = {c: F.coalesce(F.col(c).cast(f"array<{t}>"), F.array().cast(f"array<{t}>")) if c in meshes.columns else F.array().cast(f"array<{t}>") for c, t in _ARRAYS.items()}
    more = {"num_prop": F.coalesce(F.col("num_prop"), F.lit(3)).cast("int") if "num_prop" in meshes.columns else F.lit(3), "tolerance": F.coalesce(F.col("tolerance"), F.lit(0.0)).cast("double") if "tolerance" in meshes.columns else F.lit(0.0)}
    return meshes.select(F.col("mesh_id").cast("long"), *(v.alias(k) for k, v in {**more, **held}.items()))


def _finite(array: str) -> Column:
    return F.forall(array, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))


def _first_error(n_vert: Column, n_tri: Column) -> Column:
    """What is wrong with the record itself, the first in a fixed order; null if nothing is."""
    size = F.size
    outside = lambda x: x.isNull() | (x < 0) | (x >= n_vert)
    runs = size("run_original_id")
    return (
        F.when((n_vert == 0) & (n_tri == 0), F.lit(None).cast("string"))
        .when((n_vert < 4) | (n_tri < 4), "NotManifold")
        .when(F.col("num_prop") < 3, "MissingPositionProperties")
        .when(size("merge_from") != size("merge_to"), "MergeVectorsDifferentLengths")
        .when((size("run_transform") > 0) & (12 * runs != size("run_transform")), "TransformWrongLength")
        .when((runs > 0) & (size("run_index") > 0) & (runs + 1 != size("run_index")) & (runs != size("run_index")), "RunIndexWrongLength")
        .when((size("face_id") > 0) & (size("face_id") != n_tri), "FaceIDWrongLength")
        .when(~_finite("vert_properties"), "NonFiniteVertex")
        .when(~_finite("run_transform") | ~_finite("halfedge_tangent"), "InvalidConstruction")
        .when(F.exists("merge_from", outside) | F.exists("merge_to", outside), "MergeIndexOutOfBounds")
        .when(F.exists("tri_verts", outside), "VertexOutOfBounds")
    )


def _counted(meshes: DataFrame) -> DataFrame:
    per = F.greatest("num_prop", F.lit(1))
    df = _whole(meshes).withColumns({"n_vert": F.floor(F.size("vert_properties") / per).cast("long"), "n_tri": F.floor(F.size("tri_verts") / 3).cast("long")})
    return df.withColumn("error", _first_error(F.col("n_vert"), F.col("n_tri")))


def _triangles(good: DataFrame) -> DataFrame:
    """Triangles of records without errors: merged vertices (v0..v2), their own (p0..p2) and places; those with a vertex
    twice are left out."""
    merged = F.map_from_entries(F.map_entries(F.map_from_arrays(F.array_distinct("merge_from"), F.transform(F.array_distinct("merge_from"), lambda x: F.get("merge_to", F.array_position("merge_from", x).cast("int") - 1)))))
    df = good.withColumn("merged", merged)
    corner = lambda i, k: F.get("tri_verts", (3 * i + k).cast("int"))
    place = lambda v, c: F.get("vert_properties", (v * F.col("num_prop") + c).cast("int"))
    df = df.select("*", F.explode(F.when(F.col("n_tri") > 0, F.sequence(F.lit(0).cast("long"), F.col("n_tri") - 1))).alias("tri"))
    df = df.select("mesh_id", "tri", "merged", "vert_properties", "num_prop", *(corner(F.col("tri"), k).alias(f"p{k}") for k in range(3)))
    df = df.withColumns({f"v{k}": F.coalesce(F.col("merged")[F.col(f"p{k}")], F.col(f"p{k}")) for k in range(3)})
    df = df.select("mesh_id", "tri", "v0", "v1", "v2", *(place(F.col(f"v{k}"), c).alias(p + a) for k, p in enumerate("abc") for c, a in enumerate("xyz")), "p0", "p1", "p2")
    return df.where("v0 <> v1 and v1 <> v2 and v2 <> v0")


def load(meshes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``status`` (mesh_id, status, n_vert, n_tri, num_prop, epsilon, tolerance) of every record, and the triangles
    (mesh_id, tri, v0..v2, ax..cz, p0..p2) of those without error."""
    counted = _counted(meshes)
    tris = _triangles(counted.where("error is null"))
    pairs = undirected(halfedges(tris)).groupBy("mesh_id").agg(F.max(F.abs(F.col("forward") - F.col("backward"))).alias("open"))
    open_ = pairs.where("open > 0").select(F.col("mesh_id").alias("bad"))
    joined = counted.hint("merge").join(open_, F.col("mesh_id").eqNullSafe(F.col("bad")), "left")
    status = F.coalesce("error", F.when(F.col("bad").isNotNull(), "NotManifold"), F.lit("NoError"))
    places = F.filter("vert_properties", lambda x, i: i % F.col("num_prop") < 3)
    scale = F.coalesce(F.array_max(F.transform(places, F.abs)), F.lit(0.0))
    empty = status != "NoError"
    out = joined.select(
        "mesh_id", status.alias("status"), *(F.when(empty, F.lit(0)).otherwise(F.col(c)).cast("long").alias(c) for c in ("n_vert", "n_tri")), "num_prop",
        F.when(empty, F.lit(0.0)).otherwise(PRECISION * scale).alias("epsilon"), F.when(empty, F.lit(0.0)).otherwise(F.greatest("tolerance", PRECISION * scale)).alias("tolerance"),
    )
    return out, tris.hint("merge").join(open_, F.col("mesh_id").eqNullSafe(F.col("bad")), "left_anti")


def load_single(meshes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same for places in single precision, which raises the least tolerance."""
    rounded = F.transform(F.col("vert_properties").cast("array<float>"), lambda x: x.cast("double"))
    status, tris = load(meshes.withColumn("vert_properties", rounded))
    return status.withColumn("tolerance", F.greatest("tolerance", F.col("epsilon") / PRECISION * SINGLE)), tris


def set_tolerance(status: DataFrame, tolerance: Column | float) -> DataFrame:
    """``tolerance`` anew, never below epsilon."""
    value = tolerance if isinstance(tolerance, Column) else F.lit(float(tolerance))
    return status.withColumn("tolerance", F.greatest(value, F.col("epsilon")))


def set_epsilon(status: DataFrame, bounds: DataFrame, least: float = 0.0) -> DataFrame:
    """epsilon: ``least``, but not below what the bounds (mesh_id, min_x..max_z) ask for; tolerance not below epsilon."""
    scale = F.greatest(*(F.abs(F.col(f"{e}_{c}")) for e in ("min", "max") for c in "xyz"))
    df = status.drop("epsilon").hint("merge").join(bounds.select("mesh_id", F.greatest(F.lit(float(least)), PRECISION * scale).alias("epsilon")), "mesh_id", "left")
    return df.withColumn("tolerance", F.greatest("tolerance", "epsilon"))


def merge(meshes: DataFrame) -> DataFrame:
    """merge_from, merge_to of records whose triangles leave edges open: vertices of open edges that lie within the
    tolerance of each other, on each axis and over any chain, become the least of them. Other records stay as they are.
    """
    counted = _counted(meshes)
    good = counted.where("error is null")
    tris = _triangles(good)
    ends = open_edges(tris).select("mesh_id", F.explode(F.array("start_v", "end_v")).alias("vert")).distinct()
    scale = F.array_max(F.transform(F.filter("vert_properties", lambda x, i: i % F.col("num_prop") < 3), F.abs))
    places = ends.hint("merge").join(good.select("mesh_id", "vert_properties", "num_prop", F.greatest("tolerance", PRECISION * scale).alias("reach")), "mesh_id")
    at = {c: F.get("vert_properties", (F.col("vert") * F.col("num_prop") + k).cast("int")) for k, c in enumerate("xyz")}
    boxes = places.select("mesh_id", F.col("vert").alias("id"), *((at[c] + (F.col("reach") / 2 if e == "hi" else -F.col("reach") / 2)).alias(f"{e}_{c}") for e in ("lo", "hi") for c in "xyz"))
    pairs = overlap_join(boxes, boxes, self_join=True, keys=("mesh_id",))
    # one number for mesh and vertex, by rank, so that solids' vertices are nodes of one graph
    nodes = boxes.select("mesh_id", "id").withColumn("node", F.xxhash64("mesh_id", "id"))
    links = pairs.select(F.xxhash64("mesh_id", "a_id").alias("a"), F.xxhash64("mesh_id", "b_id").alias("b"))
    groups = nodes.hint("merge").join(connected_components(links), "node").withColumn("to", F.min("id").over(Window.partitionBy("mesh_id", "component")))
    lists = groups.where("id <> to").groupBy("mesh_id").agg(F.array_sort(F.collect_list(F.struct("id", "to"))).alias("m"))
    out = counted.hint("merge").join(lists, "mesh_id", "left")
    both = {c: F.concat(F.col(c), F.coalesce(F.col("m")[f], F.array().cast("array<bigint>"))) for c, f in (("merge_from", "id"), ("merge_to", "to"))}
    return out.withColumns(both).drop("m", "n_vert", "n_tri", "error")


def export(tris: DataFrame, props: DataFrame | None = None, single: bool = False) -> DataFrame:
    """Records of solids: vertices in the order of their numbers, triangles in that of theirs, one run a value of the
    column ``original_id`` if ``tris`` has one. ``props`` (mesh_id, vert, props) adds channels."""
    runs = "original_id" in tris.columns
    order = ["original_id", "tri"] if runs else ["tri"]
    corners = F.explode(F.array(*(F.struct(F.col(f"v{k}").cast("long").alias("vert"), *(F.col(p + c).alias(c) for c in "xyz")) for k, p in enumerate("abc")))).alias("p")
    verts = tris.select("mesh_id", corners).select("mesh_id", "p.*").groupBy("mesh_id", "vert").agg(*(F.min(c).alias(c) for c in "xyz"))
    if props is not None:
        verts = verts.hint("merge").join(props.select("mesh_id", F.col("vert").cast("long"), "props"), ["mesh_id", "vert"], "left")
    else:
        verts = verts.withColumn("props", F.array().cast("array<double>"))
    one = F.struct("vert", F.concat(F.array("x", "y", "z"), F.coalesce("props", F.array().cast("array<double>"))).alias("p"))
    packed = verts.groupBy("mesh_id").agg(F.array_sort(F.collect_list(one)).alias("held"))
    kind = "array<float>" if single else "array<double>"
    packed = packed.select("mesh_id", F.col("held.vert").alias("old"), F.flatten("held.p").cast(kind).alias("vert_properties"), F.size(F.col("held")[0]["p"]).alias("num_prop"))
    row = F.struct(*order, *(F.col(f"v{k}").cast("long").alias(f"v{k}") for k in range(3)))
    faces = tris.groupBy("mesh_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    number = lambda v: F.array_position("old", v).cast("long") - 1
    dense = F.col("old")[F.size("old") - 1] == F.size("old") - 1
    index = F.flatten(F.transform("rows", lambda t: F.array(*(F.when(dense, t[f"v{k}"]).otherwise(number(t[f"v{k}"])) for k in range(3)))))
    out = packed.hint("merge").join(faces, "mesh_id")
    cols = ["mesh_id", "num_prop", "vert_properties", index.alias("tri_verts")]
    if runs:
        ids = F.array_distinct(F.col("rows.original_id"))
        starts = F.transform(ids, lambda i: 3 * (F.array_position(F.col("rows.original_id"), i).cast("long") - 1))
        cols += [F.concat(starts, F.array(3 * F.size("rows").cast("long"))).alias("run_index"), ids.alias("run_original_id")]
    return out.select(*cols)


def point_lookup(meshes: DataFrame) -> tuple[Column, Column, Column]:
    """Expressions over a record for a vertex number ``i``, a triangle number ``i`` and a half-edge number ``i``: place,
    corners and tangent."""
    at = lambda array, start, n: F.slice(array, (start + 1).cast("int"), F.lit(n))
    i = F.col("i")
    return at("vert_properties", i * F.col("num_prop"), 3), at("tri_verts", 3 * i, 3), at("halfedge_tangent", 4 * i, 4)

"""OBJ text: ``v x y z``, ``f a b c`` (from 1, or from the end if negative), heads ``# tolerance = t``, ``# epsilon = e``.

A file is one row and is numbered by itself, so many files are read side by side and one must fit an executor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.storage import fresh_path


def _number_after(name: str) -> Column:
    found = F.filter("lines", lambda x: x.rlike(rf"^#\s*{name}\s*="))
    return F.regexp_extract(F.coalesce(F.get(found, F.lit(0)), F.lit("")), r"=\s*(\S+)", 1).try_cast("double")


def read_obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vertices (file, vert, x, y, z), triangles (file, tri, v0, v1, v2), numbered from 0 in file order, and files (file,
    tolerance, epsilon, status).

    The status is InvalidConstruction if a face is no triangle, VertexOutOfBounds if one names a vertex that is not
    there, NonFiniteVertex if a place is no finite number; triangles of such files are left out. Lines of other kinds and
    blank ones are passed over. An empty file gives no rows at all.
    """
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", "\r?\n").alias("lines"))
    rows = lines.select("file", F.posexplode("lines").alias("at", "line")).select("file", "at", F.split(F.btrim("line"), "[ \t]+").alias("part"))
    rows = rows.where(F.get("part", F.lit(0)).isin("v", "f"))
    here = Window.partitionBy("file").orderBy("at")
    rows = rows.withColumn("kind", F.get("part", F.lit(0))).withColumn("seen", F.count_if(F.col("kind") == "v").over(here))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("file", "kind").orderBy("at")) - 1)
    verts = rows.where("kind = 'v'").select("file", F.col("place").cast("int").alias("vert"), *(F.get("part", F.lit(k + 1)).try_cast("double").alias(c) for k, c in enumerate("xyz")))

    def corner(k: int) -> Column:
        n = F.get(F.split(F.get("part", F.lit(k + 1)), "/"), F.lit(0)).try_cast("int")
        return F.when(n < 0, F.col("seen") + n).otherwise(n - 1).cast("int")

    faces = rows.where("kind = 'f'").select("file", F.col("place").cast("int").alias("tri"), *(corner(k).alias(f"v{k}") for k in range(3)), (F.size("part") == 4).alias("whole"))
    n = verts.groupBy("file").agg(F.count("*").alias("n_vert"), F.min(F.coalesce(sum((F.abs(c) for c in "yz"), F.abs("x")) < float("inf"), F.lit(False))).alias("finite"))
    held = faces.groupBy("file").agg(F.min("whole").alias("whole"), F.min(F.least(*(F.coalesce(f"v{k}", F.lit(-1)) for k in range(3)))).alias("lo"), F.max(F.greatest("v0", "v1", "v2")).alias("hi"))
    status = (
        F.when(F.col("whole") == F.lit(False), "InvalidConstruction").when(F.col("finite") == F.lit(False), "NonFiniteVertex")
        .when((F.col("lo") < 0) | (F.col("hi") >= F.coalesce("n_vert", F.lit(0))), "VertexOutOfBounds").otherwise("NoError")
    )
    files = lines.select("file", _number_after("tolerance").alias("tolerance"), _number_after("epsilon").alias("epsilon")).join(n, "file", "left").join(held, "file", "left")
    files = files.select("file", "tolerance", "epsilon", status.alias("status"))
    good = files.where("status = 'NoError'").select("file")
    return verts, faces.join(good, "file", "left_semi").select("file", "tri", "v0", "v1", "v2"), files


def obj_text(vertices: DataFrame, triangles: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """mesh_id, value: the OBJ text of each mesh (mesh_id, vert, x, y, z; mesh_id, tri, v0, v1, v2), with the heads of
    ``heads`` (mesh_id, tolerance, epsilon) if given."""
    v = vertices.groupBy("mesh_id").agg(F.array_sort(F.collect_list(F.struct("vert", F.concat_ws(" ", F.lit("v"), "x", "y", "z").alias("s")))).alias("v"))
    f = triangles.groupBy("mesh_id").agg(F.array_sort(F.collect_list(F.struct("tri", F.concat_ws(" ", F.lit("f"), *(F.col(f"v{k}") + 1 for k in range(3))).alias("s")))).alias("f"))
    out = v.join(f, "mesh_id", "left")
    none = F.array().cast("array<string>")
    head = none
    if heads is not None:
        out = out.join(heads.select("mesh_id", "tolerance", "epsilon"), "mesh_id", "left")
        line = lambda c: F.concat(F.lit(f"# {c} = "), F.col(c).cast("string"))
        head = F.filter(F.array(line("tolerance"), line("epsilon")), lambda x: x.isNotNull())
    return out.select("mesh_id", F.array_join(F.concat(head, F.col("v.s"), F.coalesce(F.col("f.s"), none)), "\n").alias("value"))


def write_obj(vertices: DataFrame, triangles: DataFrame, heads: DataFrame | None = None, folder: str | None = None) -> str:
    """One text file a mesh below ``folder`` (a new one in the shared folder if none is given), which it returns."""
    folder = folder or fresh_path(vertices.sparkSession, "obj")
    text = obj_text(vertices, triangles, heads)
    text.repartition("mesh_id").write.partitionBy("mesh_id").option("lineSep", "\n").text(folder)
    return folder

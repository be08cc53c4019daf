"""Index operations on tables whose rows are numbered by a column ``i``: the ones that meshes are kept in order by.

All are joins, groupings or windows on ``i`` or a key; none gathers a table. Rows with a null index are left out by joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sequence(sizes: DataFrame) -> DataFrame:
    """key, i from 0 up to ``n`` less one, for each row (key, n)."""
    return sizes.where("n > 0").select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("i"))


def gather(values: DataFrame, index: DataFrame) -> DataFrame:
    """i, value: for each (i, at) of ``index`` the value (i, value) at that place; null where there is none."""
    return index.hint("merge").join(values.select(F.col("i").alias("at"), "value"), "at", "left").select("i", "value")


def scatter(values: DataFrame, index: DataFrame) -> DataFrame:
    """i, value: the value at i goes to place ``at``; the last one where several do."""
    moved = values.hint("merge").join(index, "i").select(F.col("at").alias("i"), F.col("i").alias("from"), "value")
    return moved.groupBy("i").agg(F.max_by("value", "from").alias("value"))


def permute(values: DataFrame, new_to_old: DataFrame) -> DataFrame:
    """The rows in a new order: place i takes the value of place ``at``."""
    return gather(values, new_to_old)


def compact(df: DataFrame, keep: Column, key: str, order: str) -> DataFrame:
    """Rows for which ``keep`` holds, with their new place ``i`` within ``key``, in their old order."""
    kept = df.where(F.coalesce(keep, F.lit(False)))
    return kept.withColumn("i", (F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).cast("long"))


def unique(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows without those whose value equals that of the row before, within ``key``."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order)) == 1
    return df.withColumn("_same", before.eqNullSafe(F.col(value)) & ~first).where("not _same").drop("_same")


def histogram(df: DataFrame, value: str, digits: int = 8, bits: int = 8) -> DataFrame:
    """digit, bucket, n: how many values have which bits at each of ``digits`` places, the lowest first."""
    part = F.explode(F.array(*(F.struct(F.lit(d).alias("digit"), F.shiftright(F.col(value).cast("long"), d * bits).bitwiseAND(F.lit((1 << bits) - 1)).alias("bucket")) for d in range(digits))))
    return df.where(F.col(value).isNotNull()).select(part.alias("p")).select("p.*").groupBy("digit", "bucket").agg(F.count("*").alias("n"))


def stable_order(df: DataFrame, key: str, by: str, place: str) -> DataFrame:
    """Adds ``rank``: the place of each row within ``key`` when sorted by ``by``, equal ones in their old order."""
    return df.withColumn("rank", (F.row_number().over(Window.partitionBy(key).orderBy(by, place)) - 1).cast("long"))


def folds(df: DataFrame, key: str, value: str, keep: Column) -> DataFrame:
    """key, total, least, most, n_kept, all_kept of each key."""
    return df.groupBy(key).agg(F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"), F.count_if(keep).alias("n_kept"), F.min(F.coalesce(keep, F.lit(False))).alias("all_kept"))


def scans(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Adds running sums of the absolute values: ``abs_inclusive`` with the row, ``abs_exclusive`` without it."""
    total = F.sum(F.abs(value)).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("abs_inclusive", total).withColumn("abs_exclusive", total - F.abs(value))


def pair_up(edges: DataFrame) -> DataFrame:
    """key, start, end: the starts and the ends (key, id, is_start, at, tie) of each key, each sorted by place, then tie;
    the i-th start goes with the i-th end. What is over has no partner."""
    rank = F.row_number().over(Window.partitionBy("key", "is_start").orderBy("at", "tie", "id"))
    df = edges.withColumn("rank", rank)
    both = df.groupBy("key", "rank").agg(F.max(F.when(F.col("is_start"), F.col("id"))).alias("start"), F.max(F.when(~F.col("is_start"), F.col("id"))).alias("end"))
    return both.select("key", "rank", "start", "end")


def morton_order(points: DataFrame, bounds: tuple[tuple[float, ...], tuple[float, ...]]) -> DataFrame:
    """``points`` (mesh_id, vert, x, y, z) with code and rank within the mesh by Morton code, equal ones in their old
    order; places that are not finite are dropped."""
    from tessera.functions.vectors import morton

    lo, hi = (tuple(F.lit(x) for x in side) for side in bounds)
    whole = points.where(" and ".join(f"abs({c}) < double('infinity')" for c in "xyz"))
    coded = whole.withColumn("code", morton(tuple(F.col(c) for c in "xyz"), lo, hi))
    return stable_order(coded, "mesh_id", "code", "vert")


def face_order(tris: DataFrame, bounds: tuple[tuple[float, ...], tuple[float, ...]]) -> DataFrame:
    """mesh_id, tri, code, rank of triangles by the Morton code of the mean of their corners."""
    middle = tris.select("mesh_id", F.col("tri").alias("vert"), *(((F.col("a" + c) + F.col("b" + c) + F.col("c" + c)) / 3).alias(c) for c in "xyz"))
    return morton_order(middle, bounds).select("mesh_id", F.col("vert").alias("tri"), "code", "rank")


def least_first(tris: DataFrame) -> DataFrame:
    """mesh_id, tri, v0, v1, v2 with each triangle turned so that its least vertex comes first."""
    low = F.least("v0", "v1", "v2")
    turned = [F.when(F.col("v0") == low, F.col(f"v{k}")).when(F.col("v1") == low, F.col(f"v{(k + 1) % 3}")).otherwise(F.col(f"v{(k + 2) % 3}")) for k in range(3)]
    return tris.select("mesh_id", "tri", *(t.alias(f"v{k}") for k, t in enumerate(turned)))

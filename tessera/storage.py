"""Intermediates in the shared folder, and joins in which one key may hold a large share of all rows."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no folder and runs in one process, as in tests.
DEFAULT_SHARED = "file:///tmp/checkpoints"
#: A key is hot from so many rows on, and from the share 1 / MOST_HOT of all rows: so at most MOST_HOT keys are.
HOT_ROWS, MOST_HOT = 1 << 16, 1 << 16
#: The driver's garbage is collected between two intermediates when its heap takes more than this share of its limit, and
#: more than a tenth above what it took after the last collection.
GROWN = 0.5
_after = 0


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``, which a cluster must set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = DEFAULT_SHARED
    return where.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/tessera-{label}-{uuid.uuid4().hex[:12]}"


def ease_driver(spark: SparkSession) -> bool:
    """Have the driver's garbage collected if its heap has grown; whether it was.

    Only a whole collection lets Spark drop what the plans that are gone leave behind (sizes of shuffled blocks, broadcast
    tasks, shuffle files) and gives memory back: left alone, a heap grows to its limit however little of it is in use.
    """
    global _after
    heap = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() <= max(GROWN * heap.maxMemory(), 1.1 * _after):
        return False
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()
    _after = heap.totalMemory()
    return True


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it again."""
    spark = df.sparkSession
    ease_driver(spark)
    path = fresh_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.tessera_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``tables``; nothing may read them any more."""
    for df in tables:
        remove_path(df.sparkSession, df.tessera_path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, whichever store it is in."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def shuffle_width(spark: SparkSession) -> int:
    """How many partitions a repartitioning of the whole input gets."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread_join(uses: DataFrame, facts: DataFrame, keys: list[str], by: list[str], total: int, how: str = "inner") -> DataFrame:
    """``uses`` (many rows a key, ``total`` in all) joined with ``facts`` (one row a key) on ``keys``.

    A hot key of ``uses`` is split in as many parts as its rows ask for, dealt by a hash of the columns ``by``, which
    tell its rows apart, and its fact is repeated for each. The list of hot keys, which is broadcast, has at most
    MOST_HOT rows, and no more than twice that many facts are added. ``uses`` is read twice. Null keys match nothing.
    """
    if total <= HOT_ROWS:
        return uses.join(facts, keys, how)
    least = max(HOT_ROWS, total // MOST_HOT)
    counted = uses.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > least)
    hot = F.broadcast(counted.select(*keys, F.ceil(F.col("_rows") / least).cast("int").alias("_parts")))
    part = F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*by), F.col("_parts"))).cast("int")
    left = uses.join(hot, keys, "left").withColumn("_part", part).drop("_parts")
    parts = F.when(F.col("_parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_parts") - 1))
    right = facts.join(hot, keys, "left").withColumn("_part", F.explode(parts)).drop("_parts")
    return left.join(right, [*keys, "_part"], how).drop("_part")

"""The folder that all executors share, tables in it, and numbers for rows that are stored there.

Tables written here cut lineage: they survive lost executors and are never computed twice. Each is deleted when its
operator says so (drop), or else when the driver ends.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a local session gets a folder of its own; a cluster gets an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _OWN:
            _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="rankflow-")
        found = _OWN[context.applicationId]
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder; what is written there is deleted when the driver ends, at the latest."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    # Marking needs the path to be there; the table replaces the empty folder.
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(place)
    system.deleteOnExit(place)
    return path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete what was written at paths; nothing may read it any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame, label: str, **options: str) -> tuple[DataFrame, str]:
    """df as written to the shared folder, with the options for the writer, and read back; its path for drop()."""
    path = new_path(df.sparkSession, label)
    df.write.mode("overwrite").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    return stored(df, label, **options)[0]


def ranged(df: DataFrame, order: list[str], label: str = "ranges") -> DataFrame:
    """df with _part and _own: ranges of `order` by number, and each row's place in its range from 0.

    The rows are written once with both numbers. Deriving them twice from a plan (once for sizes, once for rows) gives
    ranges that differ: bounds are sampled anew, and adaptive execution joins partitions its own way in each branch.
    Order by all columns where rows may be many to a key: only equal rows then share a range by force.
    """
    keys = [F.col(f"`{c}`") for c in order]
    sorted_rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return materialize(_by_task(sorted_rows), label)


def _by_task(df: DataFrame) -> DataFrame:
    """df with _part and _own: its tasks' numbers, and each row's within its task."""
    at = _free(df, "_at")
    numbered = df.withColumn(at, F.monotonically_increasing_id())  # the task's number, then the row's within it
    return numbered.select(F.shiftright(at, 33).cast("int").alias("_part"), F.col(at).bitwiseAND(F.lit((1 << 33) - 1)).alias("_own"), *[F.col(f"`{c}`") for c in df.columns])


def _free(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def starts_of(parts: DataFrame, size=None, name: str = "_start") -> DataFrame:
    """(_part, name): what the ranges before hold, rows or the sum of `size`. One row a range meets in the window."""
    sizes = parts.groupBy("_part").agg((F.count(F.lit(1)) if size is None else F.sum(size)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(name))


def numbered_rows(df: DataFrame, order: list[str], name: str = "record_no") -> DataFrame:
    """df with `name`: each row's place in the order, from 0, without gaps. No row is lost whatever the partitioning."""
    parts = ranged(df, order)
    return parts.join(starts_of(parts), "_part").select((F.col("_start") + F.col("_own")).alias(name), *[F.col(f"`{c}`") for c in df.columns])


def placed_rows(df: DataFrame, name: str = "_at") -> DataFrame:
    """df with `name`: each row's place in the order of partitions and rows that Spark gives it, written once so that it stays."""
    parts = materialize(_by_task(df), "places")
    return parts.join(starts_of(parts), "_part").select((F.col("_start") + F.col("_own")).alias(name), *[F.col(f"`{c}`") for c in df.columns])

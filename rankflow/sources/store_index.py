"""An index beside a store: which records each file holds, by number and by key.

A store's files hold ranges of the key in order, so a record's number is the sum of the rows of all files before its own and its
place in that. The index has one row a file (its first number, its rows, its first and last key) and lies in the store's
own folder, under a name that readers of the folder pass over. A lookup reads the index, then the one file that holds the record;
a lookup by key reads the files whose keys reach from at most it to at least it, with the key pushed down to their row
groups. Numbers of all records need no sort: each row knows its file and its place in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

INDEX = "_index"


def write_index(spark: SparkSession, path: str, keys: list[str]) -> None:
    """Index a store that is sorted by keys; only these are read."""
    rows = spark.read.parquet(path).select(F.col("_metadata.file_name").alias("file"), F.struct(*[F.col(f"`{k}`") for k in keys]).alias("key"))
    files = rows.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))
    # Spark numbers the files of a sorted write; one row a file meets in the window.
    order = Window.orderBy(F.regexp_extract("file", r"part-(\d+)", 1).cast("long"), "file")
    before = F.coalesce(F.sum("rows").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files.withColumn("first_no", before).coalesce(1).write.mode("overwrite").parquet(f"{path}/{INDEX}")


def index_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, rows, first_key, last_key, first_no): a row a file."""
    return spark.read.parquet(f"{path}/{INDEX}")


def record_count(spark: SparkSession, path: str) -> int:
    return int(index_of(spark, path).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0])


def _rows_of(spark: SparkSession, path: str, files: list) -> DataFrame:
    """Rows of some of a store's files, with record_no."""
    whole = spark.read.parquet(path)
    if not files:
        return whole.withColumn("record_no", F.lit(0).cast("long")).where("false")
    own = spark.read.schema(whole.schema).parquet(*[f"{path}/{f.file}" for f in files])
    first: Column = F.create_map(*[F.lit(x) for f in files for x in (f.file, f.first_no)])[F.col("_metadata.file_name")] if len(files) > 1 else F.lit(files[0].first_no)
    return own.withColumn("record_no", first + F.col("_metadata.row_index"))


def record_by_no(spark: SparkSession, path: str, number: int) -> DataFrame:
    """The record of a number, with record_no; no row where there is none."""
    files = index_of(spark, path).where((F.col("first_no") <= number) & (F.col("first_no") + F.col("rows") > number)).select("file", "first_no").collect()  # one at most
    return _rows_of(spark, path, files).where(F.col("record_no") == number)


def records_of_key(spark: SparkSession, path: str, *key: object) -> DataFrame:
    """All records of a key, or of the first parts of one, with record_no."""
    index = index_of(spark, path)
    names = index.schema["first_key"].dataType.names[: len(key)]
    part = lambda c: F.struct(*[F.col(f"{c}.`{n}`") for n in names])
    wanted = F.struct(*[F.lit(k).cast(index.schema["first_key"].dataType[n].dataType).alias(n) for k, n in zip(key, names, strict=True)])
    files = index.where((part("first_key") <= wanted) & (part("last_key") >= wanted)).select("file", "first_no").collect()  # names of files
    rows = _rows_of(spark, path, files)
    for k, n in zip(key, names, strict=True):
        rows = rows.where(F.col(f"`{n}`") == F.lit(k).cast(index.schema["first_key"].dataType[n].dataType))
    return rows


def record_no(spark: SparkSession, path: str, *key: object) -> int:
    """The number of the first record of a key; -1 where there is none."""
    found = records_of_key(spark, path, *key).agg(F.min("record_no")).first()[0]
    return -1 if found is None else int(found)


def numbered_store(spark: SparkSession, path: str) -> DataFrame:
    """All records with record_no, as they lie there: no shuffle."""
    first = index_of(spark, path).select(F.col("file").alias("_file"), "first_no")  # a row a file
    rows = spark.read.parquet(path).withColumn("_file", F.col("_metadata.file_name")).withColumn("_row", F.col("_metadata.row_index"))
    return rows.join(F.broadcast(first), "_file").withColumn("record_no", F.col("first_no") + F.col("_row")).drop("_file", "_row", "first_no")

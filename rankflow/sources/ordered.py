"""Lines of several files in order: of the files as they are listed, and of the lines as they lie there.

Spark packs the parts of files into tasks by size, so the order of its partitions tells nothing. Each line is placed by the
number of its file in the list, the byte at which its part of the file begins, and its number within the task, which only grows
along a part. These three sort all lines, whatever parts and tasks there are; sums of earlier ranges make them line numbers.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankflow.storage import numbered_rows

#: The columns by which lines are in order.
PLACE = ["file_no", "block", "at"]


def listed_files(spark: SparkSession, paths: list[str]) -> list[str]:
    """Every file that the paths name: paths in order, the files of a folder or pattern by name; one may come again."""
    return [f for p in paths for f in sorted(spark.read.text(p).inputFiles())]


def ordered_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file_no, block, at, value): lines with their places. A file that is listed twice gives its lines twice."""
    files = listed_files(spark, paths)
    if not files:
        return spark.createDataFrame([], "file_no int, block long, at long, value string")
    text = spark.read.text(sorted({p for p in paths}))
    # Spark writes a local path with one slash or three, by where it is asked for.
    name = F.regexp_replace("_metadata.file_path", "^(\\w+:)/+", "$1/")
    placed = text.select("value", name.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    numbers = spark.createDataFrame([(re.sub("^(\\w+:)/+", r"\1/", f), i) for i, f in enumerate(files)], "file string, file_no int")
    # One row for each file, which the driver lists anyway.
    return placed.join(F.broadcast(numbers), "file").select(*PLACE, "value")


def numbered_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(line_no, file_no, value): line_no from 0, without gaps, over all files in order."""
    return numbered_rows(ordered_lines(spark, paths), PLACE, "line_no").select("line_no", "file_no", "value")


def copy_lines(spark: SparkSession, paths: list[str], first: int = 0, most: int | None = None) -> DataFrame:
    """(line_no, value): the lines from number `first` on, at most so many."""
    rows = numbered_lines(spark, paths).where(F.col("line_no") >= first)
    return (rows if most is None else rows.where(F.col("line_no") < first + most)).select("line_no", "value")


def concatenated(spark: SparkSession, paths: list[str], out: str, compression: str | None = None) -> None:
    """The lines of several files or folders as one folder, whose files by name hold them in order."""
    ordered_lines(spark, paths).orderBy(*PLACE).select("value").write.option("compression", compression or "none").text(out)

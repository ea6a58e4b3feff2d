"""Sinks by URI."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankflow.functions.text import count_text
from rankflow.relation import Relation
from rankflow.sources import store_index
from rankflow.sources.ordered import concatenated
from rankflow.storage import drop, new_path

__all__ = ["StorePusher", "as_text", "concatenated", "file_checksums", "push_store", "write_history", "write_jdbc", "write_lines", "write_nothing", "write_records", "write_scores", "write_store", "write_table", "write_uri", "write_xml"]


def as_text(r: Relation):
    """A record as its line: the key, and after a TAB its data; counts have at least twelve digits."""
    if r.kind == "count":
        return F.concat_ws("\t", r.key(), count_text(F.col("count")))
    return F.concat_ws("\t", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in r.df.columns if c != "pos"])


def _level(compression: str | None, level: int | None) -> dict[str, str]:
    """The options of a compression and its level, from 1 (fast) to 9 (small); zstd has more. Each goes with one write."""
    out = {"compression": compression or "none"}
    if level is not None:
        if compression in ("gzip", "deflate"):
            names = {1: "BEST_SPEED", 9: "BEST_COMPRESSION"} | dict(zip(range(2, 9), "TWO THREE FOUR FIVE SIX SEVEN EIGHT".split(), strict=True))
            out["zlib.compress.level"] = names[level]
        elif compression == "zstd":
            out["io.compression.codec.zstd.level"] = str(level)
        else:
            raise ValueError(f"no levels for {compression}")
    return out


def write_lines(r: Relation, path: str, compression: str | None = None, level: int | None = None) -> None:
    r.df.select(as_text(r).alias("value")).write.options(**_level(compression, level)).text(path)


def write_table(r: Relation, path: str, separator: str = "\t", header: bool = True, compression: str | None = None, level: int | None = None, key_marks: bool = False) -> None:
    """key_marks: keys are marked in the header, name=Key.1 and so on, as delimited() reads them."""
    named = r.df.toDF(*[f"{c}=Key.{r.keys.index(c) + 1}" if c in r.keys else c for c in r.df.columns]) if key_marks else r.df
    named.write.option("sep", separator).option("header", header).option("escape", '"').options(**_level(compression, level)).csv(path)


def write_xml(r: Relation, path: str, row_tag: str = "row", root_tag: str = "rows") -> None:
    r.df.write.format("xml").option("rowTag", row_tag).option("rootTag", root_tag).save(path)


def write_records(r: Relation, path: str) -> None:
    r.df.write.parquet(path)


def write_store(r: Relation, path: str, files: int | None = None) -> None:
    """Ranges of the key, each sorted: what store() reads with row groups to skip; and the index of its record numbers."""
    key = [F.col(f"`{k}`") for k in r.keys]
    ranged = r.df.repartitionByRange(files, *key) if files else r.df.repartitionByRange(*key)
    ranged.sortWithinPartitions(*key).write.parquet(path)
    store_index.write_index(r.df.sparkSession, path, list(r.keys))


class StorePusher:
    """Records pushed one by one from the driver into a store: a bounded buffer, parts in the shared folder, one sort at the end."""

    def __init__(self, spark: SparkSession, schema: str, key: str, buffer: int = 100_000):
        self.spark, self.schema, self.key, self.buffer = spark, schema, key, buffer
        self.rows: list[tuple] = []
        self.path: str | None = None

    def add(self, *values: object) -> None:
        self.rows.append(values)
        if len(self.rows) >= self.buffer:
            self._flush()

    def _flush(self) -> None:
        if self.path is None:
            self.path = new_path(self.spark, "pushed")
        self.spark.createDataFrame(self.rows, self.schema).write.mode("append").parquet(self.path)
        self.rows = []

    def write(self, path: str, reducer: Callable[[Relation], Relation] | None = None, kind: str = "table") -> None:
        """Write the store; reducer: what equal keys come to."""
        if self.rows or self.path is None:
            self._flush()
        r = Relation(self.spark.read.schema(self.schema).parquet(self.path), (self.key,), kind)
        write_store(reducer(r) if reducer else r, path)
        drop(self.spark, self.path)


def push_store(df: DataFrame, function: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, key: str, path: str, reducer: Callable[[Relation], Relation] | None = None, kind: str = "table") -> None:
    """A store of the records that function pushes from the rows of each task; reducer: what equal keys come to."""
    r = Relation(df.mapInPandas(function, schema), (key,), kind)
    write_store(reducer(r) if reducer else r, path)


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, crc32, sha256) of each file."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", F.col("length").alias("bytes"), F.crc32("content").alias("crc32"), F.sha2("content", 256).alias("sha256"))


def write_jdbc(r: Relation, url: str, table: str, **options: str) -> None:
    r.df.write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()


def write_nothing(r: Relation) -> None:
    """Run the plan and drop its rows."""
    r.df.write.format("noop").mode("overwrite").save()


def write_scores(df: DataFrame, path: str, group: str, label: str, score: str) -> None:
    """The table of scores: m:QueryId, m:Rating, Score, parted by TABs, with a header."""
    named = df.select(F.col(f"`{group}`").alias("m:QueryId"), F.col(f"`{label}`").alias("m:Rating"), F.col(f"`{score}`").alias("Score"))
    named.write.option("sep", "\t").option("header", True).csv(path)


def write_history(spark: SparkSession, history: list[dict[str, float]], path: str) -> None:
    """A model's errors by iteration, as one table parted by TABs."""
    names = sorted({k for row in history for k in row}, key=lambda k: (k != "iteration", k))
    rows = [tuple(None if row.get(k) is None else float(row[k]) for k in names) for row in history]
    df = spark.createDataFrame(rows, ", ".join(f"`{k}` double" for k in names))
    df.withColumn("iteration", F.col("iteration").cast("int")).coalesce(1).sortWithinPartitions("iteration").write.option("sep", "\t").option("header", True).csv(path)


def write_uri(r: Relation, uri: str) -> None:
    scheme, _, rest = uri.partition(":")
    compression = next((name for end, name in ((".gz", "gzip"), (".bz2", "bzip2"), (".zst", "zstd")) if uri.endswith(end)), None)
    bare = uri[: uri.rindex(".")] if compression else uri
    if uri in ("null", "nul"):
        write_nothing(r)
    elif scheme in ("records", "recs"):
        write_records(r, rest)
    elif scheme in ("store", "tstore"):
        write_store(r, rest)
    elif bare.endswith((".csv", ".tsv")):
        write_table(r, uri, "," if bare.endswith(".csv") else "\t", compression=compression)
    elif uri.endswith(".parquet"):
        write_records(r, uri)
    elif uri.endswith(".xml"):
        write_xml(r, uri)
    else:
        write_lines(r, uri, compression)

"""Stores in hash buckets of the key, for joins and reductions that need no shuffle.

Two stores with as many buckets join, and one reduces, bucket by bucket: Spark knows from the table's bucket specification that
equal keys lie in one bucket, so their plans hold no exchange. Ranges (write_store) serve order, prefixes and numbers;
buckets serve what is done to equal keys again and again. Each bucket is one sorted file. A store is a folder: what it is (keys,
buckets, schema) lies beside its files, so that any session can open it by its path.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rankflow.relation import Relation

ABOUT = "_about"


def _quoted(names: list[str]) -> str:
    return ", ".join("`" + n.replace("`", "``") + "`" for n in names)


def write_buckets(r: Relation, path: str, buckets: int) -> None:
    """The relation in so many buckets of its key, each a file sorted by it. The folder must be new."""
    keys, spark = list(r.keys), r.df.sparkSession
    name = _table_name(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    by_key = r.df.repartition(buckets, *[F.col(f"`{k}`") for k in keys])
    by_key.write.format("parquet").option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    about = {"keys": keys, "buckets": buckets, "kind": r.kind, "name": r.name, "schema": json.loads(r.df.schema.json())}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/{ABOUT}")


def _table_name(path: str) -> str:
    return "rankflow_" + hashlib.md5(path.rstrip("/").encode()).hexdigest()


def buckets(spark: SparkSession, path: str) -> Relation:
    """A store that write_buckets wrote, by this session or another."""
    about = json.loads(spark.read.text(f"{path}/{ABOUT}").first().value)
    name = _table_name(path)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in StructType.fromJson(about["schema"]).fields)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({_quoted(about['keys'])}) SORTED BY ({_quoted(about['keys'])}) INTO {about['buckets']} BUCKETS LOCATION '{path}'")
    return Relation(spark.table(name), tuple(about["keys"]), about["kind"], about["name"])


def merged_buckets(left: Relation, right: Relation) -> DataFrame:
    """For each key of two stores of as many buckets, the rows of both: (keys, left: array of rows, right: array of rows), without a shuffle.

    A key's rows become one value, as wherever they are merged by hand; keys of one side have an empty array on the other.
    """
    rows = lambda r, name: r.df.groupBy(*[F.col(f"`{k}`") for k in r.keys]).agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in r.df.columns if c not in r.keys])).alias(name))
    both = rows(left, "left").join(rows(right, "right").toDF(*left.keys, "right"), list(left.keys), "full")
    return both.select(*[F.col(f"`{k}`") for k in left.keys], *[F.coalesce(F.col(c), F.array().cast(both.schema[c].dataType)).alias(c) for c in ("left", "right")])

"""Order, limits and samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankflow.functions.text import key_hash
from rankflow.relation import Relation
from rankflow.storage import ranged

#: Fixed value: the seed where none is given.
SEED = 31415927


def sort(r: Relation, direction: str = "+") -> Relation:
    """By key, in the order of its UTF-8 bytes; nothing to do if it is so already."""
    if r.ordering == direction:
        return r
    return r.with_df(r.df.orderBy(r.key().desc() if direction == "-" else r.key().asc()), ordering=direction)


def head(r: Relation, n: int) -> Relation:
    """The first n rows; after a sort, a top-k without a full sort."""
    return r.with_df(r.df.limit(n))


def random(r: Relation, n: int, seed: int = SEED) -> Relation:
    """n rows, the same for the same rows and seed: those with the smallest hashes of row and seed."""
    text = F.concat_ws("\t", F.lit(str(seed)), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in r.df.columns])
    return r.with_df(r.df.orderBy(F.md5(text)).limit(n), ordering=None)


def in_range(df: DataFrame, group: str, low: float, high: float, seed: int = 0) -> DataFrame:
    """Whole groups whose number in [0, 1), made from id and seed, lies in [low, high)."""
    return df.where(share_of(group, seed).between(low, high) & (share_of(group, seed) < high))


def bucketed(r: Relation, buckets: int, hasher: Callable[[Column], Column] = key_hash, out: str = "bucket") -> Relation:
    """A column with the bucket of each row's key, by a hash that may be the user's own."""
    return r.with_df(r.df.withColumn(out, F.pmod(hasher(r.key()), F.lit(buckets)).cast("int")))


def share_of(group: str, seed: int = 0):
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def partitioned(df: DataFrame, group: str, shares: str = "8:1:1", seed: int = 0, names: tuple[str, ...] = ("train", "valid", "test")) -> DataFrame:
    """A column `split`: groups dealt out by shares a:b:c; the last takes what is left."""
    parts = [float(x) for x in shares.split(":")]
    if len(parts) > len(names) or min(parts) < 0 or not sum(parts):
        raise ValueError(f"not a split: {shares!r}")
    at, out = 0.0, None
    for p, name in zip(parts[:-1], names, strict=False):
        at += p / sum(parts)
        cond = share_of(group, seed) < at
        out = F.when(cond, name) if out is None else out.when(cond, name)
    last = names[len(parts) - 1]
    return df.withColumn("split", F.lit(last) if out is None else out.otherwise(last))


def top_n(df: DataFrame, group: str, score: str, n: int, tie: str) -> DataFrame:
    """The n rows of each group with the highest scores; Spark keeps only n a group before its shuffle."""
    w = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def rank0(df: DataFrame, group: str, score: str, tie: str) -> DataFrame:
    """The place of each row in its group by descending score, from 0."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(tie))) - 1)


def contiguous_groups(df: DataFrame, value: str, order: list[str], by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """A column `group_no`: it grows whenever the value differs from the row before. Without `by`, over all rows, by ranges."""
    if not by:
        return placed_runs(df, value, order).withColumnRenamed("_run", "group_no").select(*df.columns, "group_no")
    w = Window.partitionBy(*by).orderBy(*order)
    changed = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    return df.withColumn("_new", changed).withColumn("group_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_new")


def placed_runs(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """df with _at, each row's place in the order, and _run, the number of its run of equal values; both from 0.

    Runs are found within stored ranges; where ranges meet, the last value of one and the first of the next tell whether a run goes on.
    One row a range meets in a window.
    """
    parts = ranged(df, order)
    own = Window.partitionBy("_part").orderBy("_own")
    changed = F.when((F.col("_own") == 0) | F.lag(value).over(own).eqNullSafe(F.col(value)), 0).otherwise(1)
    parts = parts.withColumn("_new", changed).withColumn("_within", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    v = F.col(f"`{value}`")
    edges = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.max("_within").alias("_changes"), F.min_by(v, "_own").alias("_first"), F.max_by(v, "_own").alias("_last"))
    along = Window.orderBy("_part")
    begins = F.when(F.row_number().over(along) == 1, 1).when(F.lag("_last").over(along).eqNullSafe(F.col("_first")), 0).otherwise(1)
    edges = edges.withColumn("_begins", begins)
    upto, before = along.rowsBetween(Window.unboundedPreceding, 0), along.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    edges = edges.select("_part", F.coalesce(F.sum("_n").over(before), zero).alias("_rows"), (F.sum("_begins").over(upto) + F.coalesce(F.sum("_changes").over(before), zero) - 1).alias("_runs"))
    placed = parts.join(edges, "_part")
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_rows") + F.col("_own")).alias("_at"), (F.col("_runs") + F.col("_within")).alias("_run"))


def shuffled(df: DataFrame, seed: int = SEED) -> DataFrame:
    """Rows in an order that only the rows and the seed decide, whatever the partitions."""
    return df.orderBy(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns]), *[F.col(f"`{c}`") for c in df.columns])


def sampled_groups(df: DataFrame, group: str, n: int, seed: int = 0) -> DataFrame:
    """Rows of n groups drawn without replacement: those with the smallest numbers made from id and seed. n ids are broadcast if they are few."""
    chosen = df.select(group).distinct().orderBy(share_of(group, seed), group).limit(n)
    return df.join(chosen, group, "left_semi")

"""Reduction of equal keys. Aggregates are partial before their shuffle, so hot keys arrive as one row per task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction

from rankflow.relation import Relation


def reduce(r: Relation, using: dict[str, Callable[[Column], Column]] | None = None) -> Relation:
    """Counts are summed, strings appended in the order of pos, edge maps merged by summing; tables need `using`.

    using: an aggregate for each column that is no key.
    """
    if using:
        missing = [c for c in r.df.columns if c not in r.keys and c not in using]
        if missing:
            raise ValueError(f"no reducer for {missing}")
        out = r.df.groupBy(*[F.col(f"`{k}`") for k in r.keys]).agg(*[f(F.col(f"`{c}`")).alias(c) for c, f in using.items()])
    elif r.kind == "count":
        out = r.df.groupBy("key").agg(F.sum("count").cast("decimal(20,0)").alias("count"))
    elif r.kind == "string":
        out = append_strings(r.df)
    elif r.kind == "map":
        out = merge_maps(r.df)
    else:
        raise ValueError("rows of this kind can't be reduced: name a reducer for each column")
    return r.with_df(out, ordering=None)


#: Rows (and bytes) that a task looks at together before the shuffle, and how many of them a key has where they are folded.
GATHERED, GATHERED_BYTES, WORTH = 200_000, 1 << 26, 64


def _gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches put together up to GATHERED rows or GATHERED_BYTES, or so."""
    held: list[pd.DataFrame] = []
    rows = size = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        rows, size = rows + len(batch), size + int(batch.memory_usage(deep=True).sum())
        if rows >= GATHERED or size >= GATHERED_BYTES:
            yield pd.concat(held, ignore_index=True)
            held, rows, size = [], 0, 0
    if held:
        yield pd.concat(held, ignore_index=True)


def reduce_by_function(r: Relation, function: Callable[[pd.DataFrame, pd.DataFrame | None], pd.DataFrame], finish: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> Relation:
    """Rows of equal keys folded by the user's own function(rows, before): a frame with one row a key, of the relation's columns.

    `rows` hold one key; `before` is what the rows seen so far came to, or None. The function runs in every task before
    the shuffle, over keys with many of the rows at hand, and again after it, so it must not depend on the order or the
    grouping of rows; a hot key then arrives as one row per task. Rows of other keys are sent as they are: folding a few
    rows costs more than sending them. finish(row) makes the last change.
    """
    keys, schema = list(r.keys), r.df.schema

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, pd.DataFrame] = {}
        for batch in _gathered(batches):
            code = batch.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
            many = np.bincount(code)[code] >= WORTH
            if not many.all():
                yield batch[~many][schema.names]
            for key, rows in batch[many].groupby(keys, sort=False, dropna=False):
                held[key] = function(rows, held.get(key))
            if len(held) > 10_000:
                yield pd.concat(held.values())[schema.names]
                held = {}
        if held:
            yield pd.concat(held.values())[schema.names]

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        out = function(rows, None)
        return (finish(out) if finish else out)[schema.names]

    some = r.df.mapInPandas(partial, schema)
    return r.with_df(some.groupBy(*[F.col(f"`{k}`") for k in keys]).applyInPandas(whole, schema), ordering=None)


def append_strings(df: DataFrame) -> DataFrame:
    """(key, pos, value) -> (key, pos, value): the values of a key one after another by pos."""
    parts = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return df.groupBy("key").agg(F.min("pos").alias("pos"), F.concat_ws("", F.transform(parts, lambda x: x["value"])).alias("value"))


def merge_maps(df: DataFrame) -> DataFrame:
    """(key, edges map) -> one map a key, weights of equal edges summed."""
    flat = df.select("key", F.explode("edges").alias("edge", "weight")).groupBy("key", "edge").agg(F.sum("weight").alias("weight"))
    return flat.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("edge", "weight")))).alias("edges"))


def observed(r: Relation, observation) -> Relation:
    """The relation as it is; once it has run, the pyspark Observation holds its `records` and the `bytes` of their keys."""
    return r.with_df(r.df.observe(observation, F.count(F.lit(1)).alias("records"), F.sum(F.octet_length(r.key())).alias("bytes")))


def positions(df: DataFrame, array: str, by: list[str], count: str | None = None) -> DataFrame:
    """(by, position, total[, agg_count]): sums of arrays of scores by place, and how many rows (or what sum of `count`) they are of."""
    flat = df.select(*by, *([F.col(count).alias("_c")] if count else []), F.posexplode(array).alias("position", "score"))
    return flat.groupBy(*by, "position").agg(F.sum("score").alias("total"), (F.sum("_c") if count else F.count(F.lit(1))).alias("agg_count"))


def largest_positions(df: DataFrame, array: str, by: list[str], count: str, sampling: str) -> DataFrame:
    """(by, position, score, agg_count, sampling): merged scores, the greatest by place, with the greatest count and sampling."""
    flat = df.select(*by, F.col(count).alias("_c"), F.col(sampling).alias("_s"), F.posexplode(array).alias("position", "score"))
    return flat.groupBy(*by, "position").agg(F.max("score").alias("score"), F.max("_c").alias("agg_count"), F.max("_s").alias("sampling"))


def about(r: Relation) -> DataFrame:
    """One row that describes a relation; none for an empty one. num_bytes: its records as lines, in UTF-8."""
    line = F.concat_ws("\t", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in r.df.columns])
    facts = r.df.agg(F.count(F.lit(1)).alias("num_records"), F.sum(F.octet_length(line)).alias("num_bytes"))
    return facts.where("num_records > 0").select(
        F.lit(r.name).alias("name"), F.lit(r.kind).alias("kind"), F.lit(",".join(r.df.columns)).alias("columns"), F.lit("+".join(r.keys)).alias("key"), "num_records", "num_bytes", F.lit(r.ordering or "").alias("sorted")
    )


#: A Bloom filter has this many bits at most (8 MB); with more keys it lets more rows through, and loses none.
MOST_BITS = 1 << 26


def bloom_filter(keys: DataFrame, column: str, n_keys: int | None = None, bits_per_key: int = 10) -> bytes | None:
    """A Bloom filter over a column, built by partial aggregation; None if there is no key. n_keys: their number, else it is counted."""
    n_keys = n_keys or max(1, keys.select(F.approx_count_distinct(column, 0.02)).first()[0])
    bits = min(MOST_BITS, max(64, n_keys * bits_per_key))
    made = InternalFunction._invoke_internal_function_over_columns("bloom_filter_agg", F.xxhash64(column), F.lit(n_keys).cast("long"), F.lit(bits).cast("long"))
    found = keys.agg(made.alias("f")).first().f
    return None if found is None else bytes(found)


def bloom_merged(a: bytes | None, b: bytes | None) -> bytes | None:
    """The filter of the keys of both; they must have been built with the same numbers of keys and bits a key."""
    if a is None or b is None:
        return a if b is None else b
    if len(a) != len(b) or a[:12] != b[:12]:
        raise ValueError("filters of different shapes can't be merged")
    return (np.frombuffer(a, np.uint8) | np.frombuffer(b, np.uint8)).tobytes()


def bloom_filtered(df: DataFrame, column: str, made: bytes | None) -> DataFrame:
    """Rows that may be in the filter: all that are, and a few that are not. Spark's own runtime filters use the same expression."""
    if made is None:
        return df.where(F.lit(False))
    jvm = df.sparkSession._jvm
    utils = jvm.org.apache.spark.sql.classic.ExpressionUtils
    test = jvm.org.apache.spark.sql.catalyst.expressions.BloomFilterMightContain(utils.expression(F.lit(made)._jc), utils.expression(F.xxhash64(column)._jc))
    return df.where(Column(utils.column(test)))

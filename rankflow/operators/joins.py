"""Joins on the key. Broadcast, shuffle and the splitting of skewed keys are left to Catalyst and adaptive execution."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankflow.relation import Relation
from rankflow.storage import numbered_rows, placed_rows


def _condition(left: Relation, right: Relation, names: list[str]) -> Column:
    """Key columns pairwise in their own types, cast to text only where types differ. A null key matches nothing.

    Keys of different widths are compared as one text each, parts joined by TAB.
    """
    if len(left.keys) != len(right.keys):
        return left.key() == F.concat_ws("\t", *[F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("")) for n in names])
    out = None
    types, others = dict(left.df.dtypes), dict(right.df.dtypes)
    for k, other, n in zip(left.keys, right.keys, names, strict=True):
        a, b = F.col(f"`{k}`"), F.col(f"`{n}`")
        same = a == b if types[k] == others[other] or _both_whole(types[k], others[other]) else a.cast("string") == b.cast("string")
        out = same if out is None else out & same
    return out


def _both_whole(a: str, b: str) -> bool:
    return {a, b} <= {"tinyint", "smallint", "int", "bigint"}


def _joined(left: Relation, right: Relation, how: str) -> Relation:
    """All left columns, then the right's that are no keys; a name that is taken becomes <right source>:<name>."""
    names = {c.lower() for c in left.df.columns}
    rest = [c for c in right.df.columns if c not in right.keys]
    fresh = [c if c.lower() not in names else f"{right.name}:{c}" for c in rest]
    keys = [f"_right_key{i}" for i in range(len(right.keys))]
    b = right.df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(right.keys, keys, strict=True)], F.lit(True).alias("_there"), *[F.col(f"`{c}`").alias(n) for c, n in zip(rest, fresh, strict=True)])
    out = left.df.join(b, _condition(left, right, keys), how)
    value = (lambda c: F.col(f"`{c}`")) if how == "inner" else (lambda c: _blank(b, c))
    return left.with_df(out.select(*[F.col(f"`{c}`") for c in left.df.columns], *[value(c).alias(c) for c in fresh]), ordering=None, kind="table")


def _blank(df: DataFrame, name: str) -> Column:
    """Blank text for rows without a partner; other types keep null."""
    c = F.col(f"`{name}`")
    return F.when(F.col("_there").isNull(), F.lit("")).otherwise(c) if dict(df.dtypes)[name] == "string" else c


def inner_join(left: Relation, right: Relation) -> Relation:
    return _joined(left, right, "inner")


def left_outer_join(left: Relation, right: Relation) -> Relation:
    return _joined(left, right, "left")


def _filtered(left: Relation, right: Relation, how: str) -> Relation:
    names = [f"_right_key{i}" for i in range(len(right.keys))]
    keys = right.df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(right.keys, names, strict=True)])
    return left.with_df(left.df.join(keys, _condition(left, right, names), how))


def filter_by_right(left: Relation, right: Relation) -> Relation:
    """Left rows whose key is on the right; left duplicates stay."""
    return _filtered(left, right, "left_semi")


def filter_not_right(left: Relation, right: Relation) -> Relation:
    return _filtered(left, right, "left_anti")


def concat(*relations: Relation, source: str | None = None) -> Relation:
    """All rows, whatever columns each has; columns of different types become text, unless all are numbers. source: a column for the number of the relation that a row came from."""
    first = relations[0]
    kinds: dict[str, set[str]] = {}
    for r in relations:
        for c, t in r.df.dtypes:
            kinds.setdefault(c.lower(), set()).add(t)
    mixed = {c for c, ts in kinds.items() if len(ts) > 1 and not all(re.match(r"(tinyint|smallint|int|bigint|float|double|decimal.*)$", t) for t in ts)}
    as_text = [r.df.select(*[F.col(f"`{c}`").cast("string").alias(c) if c.lower() in mixed else F.col(f"`{c}`") for c in r.df.columns]) for r in relations]
    numbered = [df if source is None else df.withColumn(source, F.lit(i)) for i, df in enumerate(as_text)]
    out = numbered[0]
    for df in numbered[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return first.with_df(out, ordering=None)


def merge(direction: str, *relations: Relation) -> Relation:
    """All rows in the order of their keys; rows of equal keys in the order of the relations."""
    both = concat(*relations, source="_source")
    order = both.key().desc() if direction == "-" else both.key().asc()
    return both.with_df(both.df.orderBy(order, "_source").drop("_source"), ordering=direction)


def zip_join(left: DataFrame, right: DataFrame, order: tuple[list[str], list[str]] | None = None) -> DataFrame:
    """Rows of equal place side by side; different numbers of rows are an error.

    order: the columns that give each side's places. Without them, places are those of Spark's partitions and rows, which
    mean something only where each side is read from files as it lies there.
    """

    def placed(df: DataFrame, by: list[str] | None, name: str) -> DataFrame:
        rows = placed_rows(df) if by is None else numbered_rows(df, [*by, *[c for c in df.columns if c not in by]], "_at")
        return rows.select("_at", F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))

    by_left, by_right = order or (None, None)
    both = placed(left, by_left, "_l").join(placed(right, by_right, "_r"), "_at", "full")
    checked = both.withColumn("_l", F.when(F.col("_l").isNull() | F.col("_r").isNull(), F.raise_error(F.lit("the inputs have different numbers of rows"))).otherwise(F.col("_l")))
    return checked.select(F.col("_at").alias("row_id"), "_l.*", *[F.col(f"_r.`{c}`").alias(c if c not in left.columns else f"right:{c}") for c in right.columns])

"""Projections of keyed records: to tables, counts and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankflow.columns import joined, parse, resolve, text_of
from rankflow.relation import Relation


def split_lines(r: Relation, names: list[str], separator: str = "\t") -> Relation:
    """Lines into columns of the given names; fields that a line lacks are ''."""
    import re

    parts = F.split(r.key(), re.escape(separator), -1)
    cols = [F.coalesce(F.get(parts, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)]
    return Relation(r.df.where(r.key() != "").select(*cols), (names[0],), "table", r.name, None)


def _width(expressions: list[str]) -> int:
    return max([1, *(int(p[1:]) for e in expressions for p in parse(e) if p[0] == "$")])


def _as_table(r: Relation, expressions: list[str], names: list[str] | None = None) -> Relation:
    if r.kind != "line":
        return r
    return split_lines(r, names or [f"{r.name}.Key.{i + 1}" for i in range(_width(expressions))])


def to_table(r: Relation, key: str, names: str | None = None) -> Relation:
    """Key the rows by the named columns; lines are parted at TAB, under the given names or <source>.Key.<n>.

    Keying a table by what already is its key changes nothing.
    """
    key = key.rstrip("!+-")  # an assertion of order is accepted and never relied on
    t = _as_table(r, [key], parse(names) if names else None)
    return Relation(t.df, tuple(resolve(key, t.df.columns)), "table", r.name, None)


def to_count(r: Relation, key: str, count: str | None = None) -> Relation:
    """(key, count): 1 a row, or a column's number. Blank keys are left out.

    A column that ends in ! counts what is no number as 0; without it, that is an error. Existing counts stay unless a
    column is named.
    """
    lenient = bool(count) and count.endswith("!")
    count = count.rstrip("!") if count else None
    if r.kind == "count" and count is None:
        number = F.col("count")
    elif count is None:
        number = F.lit(1)
    t = _as_table(r, [key, *([count] if count else [])])
    if count:
        text = text_of(resolve(count, t.df.columns)[0])
        parsed = F.trim(text).try_cast("decimal(20,0)")
        parsed = F.when(F.trim(text).rlike("^[0-9]+(\\.[0-9]+)?$"), parsed)
        number = F.coalesce(parsed, F.lit(0)) if lenient else F.coalesce(parsed, F.raise_error(F.concat(F.lit("not a count: "), text)).cast("decimal(20,0)"))
    names = joined(resolve(key, t.df.columns))
    return Relation(t.df.select(names.alias("key"), number.cast("decimal(20,0)").alias("count")).where("key <> ''"), ("key",), "count", r.name, None)


def to_line(r: Relation, key: str) -> Relation:
    """The key alone."""
    t = _as_table(r, [key])
    return Relation(t.df.select(joined(resolve(key, t.df.columns)).alias("key")), ("key",), "line", r.name, None)

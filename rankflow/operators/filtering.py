"""Filters: predicates, key search, user filters."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankflow.relation import Relation

_FILTERS: dict[str, tuple[Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], str | None]] = {}


#: What whole numbers are computed as, so that sums and products do not wrap around.
_WIDE = {"tinyint": "BIGINT", "smallint": "BIGINT", "int": "BIGINT", "bigint": "DECIMAL(38,0)"}


def predicate_sql(predicate: str, columns: list[str], types: dict[str, str] | None = None) -> str:
    """The SQL of a predicate: outside of quotes, `record.Name` is a column, `==`, `&&`, `||` and `!` are operators.

    Quotes are ', " or ^; a quote inside is doubled or follows a backslash, as in SQL. types: those of columns, where a predicate that
    computes is to take whole numbers as wider ones.
    """
    unquoted = re.sub(r"""(['"^]).*?\1""", "", predicate, flags=re.DOTALL)
    wide = _WIDE if types and re.search(r"[-+*]", unquoted) else {}

    def column(name: str) -> str:
        found = _named(columns, name)
        kind = wide.get((types or {}).get(found, ""))
        return f"CAST(`{found}` AS {kind})" if kind else f"`{found}`"

    out = []
    for m in re.finditer(r"""(?P<q>['"^])(?P<in>(?:\\.|(?P=q)(?P=q)|(?!(?P=q)).)*)(?P=q)|(?P<out>[^'"^]+|.)""", predicate, re.DOTALL):
        if m["q"]:
            text = m["in"].replace(m["q"] * 2, m["q"])
            text = re.sub(r"\\(.)|'", lambda x: "\\'" if x[0] == "'" else x[0], text, flags=re.DOTALL)
            out.append(f"'{text}'")
            continue
        piece = re.sub(r"\brecord\.(\w+)", lambda x: column(x[1]), m["out"])
        piece = re.sub(r"!(?!=)", " NOT ", piece)
        out.append(piece.replace("==", "=").replace("&&", " AND ").replace("||", " OR "))
    return "".join(out)


def where(r: Relation, predicate: str, strict: bool = False, failures=None) -> Relation:
    """Rows for which a SQL predicate is true (see predicate_sql).

    A row for which it can't be evaluated (a text that is no number, a division by zero, a missing value) is dropped, or
    fails the job if strict. Whole numbers are computed in wider types, so they don't wrap around. While the plan is made, the session's
    ANSI setting is changed, for other threads of the session too. failures: a pyspark Observation; its `failed` is the number of
    rows so dropped.
    """
    session = r.df.sparkSession
    text = predicate_sql(predicate, r.df.columns, None if strict else dict(r.df.dtypes))
    before = session.conf.get("spark.sql.ansi.enabled")
    session.conf.set("spark.sql.ansi.enabled", str(strict).lower())  # plans are analysed, and keep their mode, as they are made
    try:
        df = r.df
        if failures is not None:
            df = df.observe(failures, F.count_if(F.expr(text).isNull()).alias("failed"))
        return r.with_df(df.where(F.expr(text)))
    finally:
        session.conf.set("spark.sql.ansi.enabled", before)


def _named(columns: list[str], name: str) -> str:
    for c in columns:
        if c.lower() == name.lower():
            return c
    raise ValueError(f"no column {name!r} in {columns}")


def key_query(r: Relation, text: str) -> Relation:
    """Rows whose key is the text, or begins with it if it ends in *. {n} is the character of code n."""
    text = re.sub(r"\{(\d+)\}", lambda m: chr(int(m[1])), text)
    kind = dict(r.df.dtypes)[r.keys[0]] if len(r.keys) == 1 else None
    key = F.col(f"`{r.keys[0]}`") if kind == "string" else r.key()
    if text.endswith("*"):
        return r.with_df(r.df.where(key.startswith(text[:-1])))
    found = key == text
    if kind not in (None, "string"):  # the typed comparison reaches the scan, the texts decide ('007' is not 7)
        found = (F.col(f"`{r.keys[0]}`") == F.lit(text).try_cast(kind)) & found
    return r.with_df(r.df.where(found))


def register_filter(name: str, function: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str | None = None) -> None:
    """A user filter: batches of rows in, any rows out; what follows the last batch is its finish. Stopping early is leaving the loop."""
    _FILTERS[name] = function, schema


def user_filter(r: Relation, name: str) -> Relation:
    if name not in _FILTERS:
        raise ValueError(f"no user filter {name!r}")
    function, schema = _FILTERS[name]
    out = r.df.mapInPandas(function, schema or r.df.schema)
    return r.with_df(out, keys=r.keys if all(k in out.columns for k in r.keys) else (out.columns[0],), ordering=None)


def load_filter(source: str, name: str) -> None:
    """Register the user filter that a Python source defines: a function `accept(batches)`, and `SCHEMA` if it changes the columns.

    The source is run on the driver; the function goes to the executors. It is the user's own code.
    """
    space: dict[str, object] = {"__name__": f"filter_{name}"}
    exec(compile(source, name, "exec"), space)
    if not callable(space.get("accept")):
        raise ValueError(f"{name}: a filter source defines accept(batches)")
    register_filter(name, space["accept"], space.get("SCHEMA"))


_OPERATORS: dict[str, Callable[[Relation], Relation]] = {}


def register_operator(name: str, function: Callable[[Relation], Relation]) -> None:
    """An operator of the user's own over a whole relation: it sees columns, keys and order, and adds to the plan."""
    _OPERATORS[name] = function


def user_operator(r: Relation, name: str) -> Relation:
    if name not in _OPERATORS:
        raise ValueError(f"no user operator {name!r}")
    return _OPERATORS[name](r)


def filled_rows(r: Relation, label: str, column: str, value: str | None) -> Relation:
    """Rows of a group that count: labelled without the mark Filled_, or the filter column has the wanted value, or none is wanted."""
    if value is None:
        return r
    named = F.coalesce(F.col(label).cast("string"), F.lit(""))
    return r.with_df(r.df.where(((named != "") & ~named.startswith("Filled_")) | (F.col(column).cast("string") == value)))


def active_features(r: Relation, names: list[str], meta: str = "m:") -> Relation:
    """Metadata columns and those features that are named, in their own order, whatever their case."""
    wanted = {n.lower() for n in names}
    keep = [c for c in r.df.columns if c.startswith(meta) or c.lower() in wanted]
    return r.with_df(r.df.select([F.col(f"`{c}`") for c in keep]))


def empty(schema: str | T.StructType, spark) -> Relation:
    df = spark.createDataFrame([], schema)
    return Relation(df, (df.columns[0],), "table", "empty", "+")

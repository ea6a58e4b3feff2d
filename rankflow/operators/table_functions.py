"""User filters as table functions: objects that see a key's rows one after the other, and the end of them.

A filter is a class with eval(row), which yields any rows, and, if it wants, terminate(), which yields what is left after a key's
last row. Each key's rows meet a fresh object in one task, in the order asked for; STOP ends a key's rows early, and Spark skips
the rest. State is the object's own, so a key of any number of rows is never held as a whole. Without keys, each task's rows meet one
object.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.udtf import SkipRestOfInputTableException

from rankflow.relation import Relation

#: Raised by eval: no more rows of this key are wanted; terminate() still runs.
STOP = SkipRestOfInputTableException


def table_filter(r: Relation, kind: type, schema: str, by: tuple[str, ...] | None = None, order: tuple[str, ...] = ()) -> Relation:
    """The rows that `kind` yields. by: columns whose equal values make a key, the relation's own if not given; (): each task's rows in one go."""
    function = F.udtf(kind, returnType=schema)
    keys = r.keys if by is None else by
    table = r.df.asTable()
    if keys:
        table = table.partitionBy(*keys)
        if order:
            table = table.orderBy(*order)
    out: DataFrame = function(table)
    return r.with_df(out, keys=tuple(k for k in r.keys if k in out.columns) or (out.columns[0],), ordering=None)

"""Sources of the user's own as Spark data sources: planned in partitions, told of filters, read as a batch or as a stream.

A source is a class with
    schema              a DDL string
    parts(options)      what each task reads: any picklable values, made on the driver
    read(part, options) yields Arrow batches, or tuples; runs in the task, anew if that is lost
and, where it can make use of them,
    push(filters)       takes (column, operator, value) for comparisons with constants, before parts() is called; yields those it
                        can't apply wholly, which Spark then applies itself (operators: = < <= > >= in null notnull startswith)
    latest(options)     for streams: how many parts there are by now; parts that were read do not change
Registered under a name it is opened by spark.read.format(name), spark.readStream.format(name), or source().
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import datasource as D

from rankflow.relation import Relation

_OPERATORS = {D.EqualTo: "=", D.EqualNullSafe: "<=>", D.LessThan: "<", D.LessThanOrEqual: "<=", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.In: "in", D.IsNull: "null", D.IsNotNull: "notnull", D.StringStartsWith: "startswith"}


class _Part(D.InputPartition):
    def __init__(self, value: object):
        super().__init__(value)


class _Reader(D.DataSourceReader):
    def __init__(self, own: object, options: dict[str, str]):
        self.own, self.options = own, options

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        if not hasattr(self.own, "push"):
            yield from filters
            return
        asked = {}
        for f in filters:
            name = _OPERATORS.get(type(f))
            if name is None or len(f.attribute) != 1:
                yield f
            else:
                asked[f.attribute[0], name, getattr(f, "value", None)] = f
        for left in self.own.push(list(asked)):
            yield asked[left]

    def partitions(self) -> list[D.InputPartition]:
        return [_Part(p) for p in self.own.parts(self.options)]

    def read(self, partition: D.InputPartition) -> Iterator:
        yield from self.own.read(partition.value, self.options)


class _StreamReader(D.DataSourceStreamReader):
    """Offsets are numbers of parts."""

    def __init__(self, own: object, options: dict[str, str]):
        self.own, self.options = own, options

    def initialOffset(self) -> dict:
        return {"part": 0}

    def latestOffset(self) -> dict:
        return {"part": self.own.latest(self.options)}

    def partitions(self, start: dict, end: dict) -> list[D.InputPartition]:
        return [_Part(p) for p in list(self.own.parts(self.options))[start["part"] : end["part"]]]

    def read(self, partition: D.InputPartition) -> Iterator:
        yield from self.own.read(partition.value, self.options)

    def commit(self, end: dict) -> None:
        pass


def register_source(spark: SparkSession, name: str, kind: type) -> None:
    """Make a source class known to a session under a name."""

    class Source(D.DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return kind.schema

        def reader(self, schema) -> D.DataSourceReader:
            return _Reader(kind(), dict(self.options))

        def streamReader(self, schema) -> D.DataSourceStreamReader:
            return _StreamReader(kind(), dict(self.options))

    if hasattr(kind, "push"):
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Source)


def source(spark: SparkSession, name: str, key: str, **options: str) -> Relation:
    """A relation over a registered source."""
    return Relation(spark.read.format(name).options(**options).load(), (key,), "table", name)

"""Sources and filters of the user's own: data sources, table functions, bucketed stores."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rankflow.operators import joins, reduction, table_functions
from rankflow.relation import Relation
from rankflow.sources import bucketed, data_source


class Squares:
    """Numbers below n and their squares, ten a part."""

    schema = "n long, square long"

    def __init__(self):
        self.least = 0

    def push(self, filters):
        for f in filters:
            name, operator, value = f
            if (name, operator) == ("n", ">="):
                self.least = max(self.least, value)
            else:
                yield f

    def parts(self, options):
        return [(i, min(i + 10, int(options["n"]))) for i in range(0, int(options["n"]), 10) if i + 10 > self.least]

    def latest(self, options):
        return len(self.parts(options))

    def read(self, part, options):
        for n in range(max(part[0], self.least), part[1]):
            yield n, n * n


class Groups:
    """Row groups of a Parquet file."""

    schema = "k long, v string"

    def parts(self, options):
        return list(range(pq.ParquetFile(options["path"]).num_row_groups))

    def read(self, part, options):
        yield from pq.ParquetFile(options["path"]).read_row_group(part).to_batches()


def test_a_source_in_parts_with_filters(spark):
    data_source.register_source(spark, "squares", Squares)
    r = data_source.source(spark, "squares", "n", n="95")
    assert r.df.rdd.getNumPartitions() == 10 and r.df.count() == 95
    some = r.df.where("n >= 87 and square < 8000")
    assert some.rdd.getNumPartitions() == 2
    assert sorted(map(tuple, some.collect())) == [(n, n * n) for n in range(87, 90)]


def test_a_source_as_a_stream(spark):
    data_source.register_source(spark, "squares", Squares)
    stream = spark.readStream.format("squares").option("n", "45").load()
    query = stream.writeStream.format("memory").queryName("squares_seen").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("squares_seen").count() == 45


def test_a_source_of_arrow_batches(spark, tmp_path):
    path = str(tmp_path / "x.parquet")
    pq.write_table(pa.table({"k": list(range(1000)), "v": [f"v{i}" for i in range(1000)]}), path, row_group_size=100)
    data_source.register_source(spark, "groups", Groups)
    df = data_source.source(spark, "groups", "k", path=path).df
    assert df.rdd.getNumPartitions() == 10 and df.agg(F.sum("k"), F.count_distinct("v")).first()[:] == (499500, 1000)


class Until:
    """Rows of a key until their sum exceeds 100, then one with the key's count and sum."""

    def __init__(self):
        self.key, self.n, self.total = None, 0, 0

    def eval(self, row):
        self.key = row["k"]
        self.n, self.total = self.n + 1, self.total + row["v"]
        yield self.key, "row", row["v"]
        if self.total > 100:
            raise table_functions.STOP("enough")

    def terminate(self):
        if self.n:
            yield self.key, "end", self.total


def test_a_filter_sees_the_end_of_its_key_and_stops_early(spark):
    r = random.Random(2)
    rows = [(k, r.randint(1, 40)) for k in range(30) for _ in range(r.randint(1, 12))]
    df = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(rows)], "k int, v int, i int").repartition(5)
    got = table_functions.table_filter(Relation(df, ("k",)), Until, "k int, what string, v int", order=("i",))
    want = []
    for k in range(30):
        total = 0
        for own, v in rows:
            if own == k and total <= 100:
                total += v
                want.append((k, "row", v))
        want.append((k, "end", total))
    assert sorted(map(tuple, got.df.collect())) == sorted(want) and got.keys == ("k",)
    whole = table_functions.table_filter(Relation(df, ("k",)), Until, "k int, what string, v int", by=())
    assert whole.df.where("what = 'end'").count() <= 5


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_stores_in_buckets_need_no_shuffle(spark, tmp_path, no_broadcast):
    left = spark.range(3000).select((F.col("id") % 500).alias("k"), F.col("id").alias("v"))
    right = spark.range(400).select((F.col("id") * 2).alias("k"), (F.col("id") % 7).alias("w"))
    for name, df in (("l", left), ("r", right)):
        bucketed.write_buckets(Relation(df, ("k",), name=name), str(tmp_path / name), 6)
    a, b = (bucketed.buckets(spark, str(tmp_path / n)) for n in "lr")
    joined = joins.inner_join(a, b).df
    assert "Exchange" not in plan(joined)
    assert sorted(map(tuple, joined.collect())) == sorted((v % 500, v, v % 500 // 2 % 7) for v in range(3000) if v % 500 % 2 == 0)
    outer, semi = joins.left_outer_join(a, b).df, joins.filter_by_right(a, b).df
    summed = reduction.reduce(a, {"v": F.sum}).df
    assert all("Exchange" not in plan(x) for x in (outer, semi, summed))
    assert outer.count() == 3000 and semi.count() == 1500 and summed.where("k = 7").first().v == sum(range(7, 3000, 500))
    both = bucketed.merged_buckets(a, b)
    assert "Exchange" not in plan(both)
    found = {r.k: (sorted(x.v for x in r.left), [x.w for x in r.right]) for r in both.collect()}
    assert len(found) == 500 + 150 and found[4] == (list(range(4, 3000, 500)), [2]) and found[798] == ([], [0]) and found[7][1] == []


def test_another_session_opens_a_bucketed_store(spark, tmp_path):
    path = str(tmp_path / "s")
    bucketed.write_buckets(Relation(spark.range(50).selectExpr("id AS `a key`", "id * 2 AS v"), ("a key",)), path, 3)
    spark.sql(f"DROP TABLE {bucketed._table_name(path)}")
    again = bucketed.buckets(spark, path)
    assert again.keys == ("a key",) and again.df.agg(F.sum("v")).first()[0] == 2450
    assert "Exchange" not in plan(again.df.groupBy("a key").count())

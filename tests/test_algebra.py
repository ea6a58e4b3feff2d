import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankflow.columns import parse, resolve
from rankflow.operators import filtering, joins, ordering, projection, reduction
from rankflow.plans.expression import evaluate, tokens
from rankflow.relation import Relation
from rankflow.sources import readers, writers


def table(spark, rows, names, keys=None, name="t"):
    return Relation(spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)), tuple(keys or names[:1]), "table", name)


def rows(r):
    return sorted(tuple(x) for x in (r.df if isinstance(r, Relation) else r).collect())


def lines(spark, *text):
    return Relation(spark.createDataFrame([(t,) for t in text], "key string"), ("key",), "line", "f")


def test_column_expressions():
    assert parse("$1 + name") == ["$1", "name"]
    assert resolve("$2+A", ["a", "b"]) == ["b", "a"]
    for bad in ("", "$0", "$x", "a++b"):
        with pytest.raises(ValueError):
            parse(bad)
    with pytest.raises(ValueError):
        resolve("$3", ["a"])


def test_key_whitespace(spark, tmp_path):
    (tmp_path / "in.txt").write_bytes(b"  two   words \nTAB\there\x01x\n\n\x0b\n")
    got = [r.key for r in readers.lines(spark, str(tmp_path / "in.txt")).df.collect()]
    assert got[:2] == ["two words", "TAB\there x"] and set(got[2:]) == {""}
    assert readers.lines(spark, str(tmp_path / "in.txt"), skip_blank=True).df.count() == 2


def test_to_table_count_line(spark):
    r = lines(spark, "a\t1\tx", "b\t2", "", "a\t5")
    t = projection.to_table(r, "$2", "k+n+z")
    assert t.df.columns == ["k", "n", "z"] and t.keys == ("n",)
    assert ("b", "2", "") in rows(t) and len(rows(t)) == 3
    assert projection.to_table(t, "n").keys == ("n",)
    assert projection.to_table(r, "$2").df.columns == ["f.Key.1", "f.Key.2"]
    counts = reduction.reduce(projection.to_count(r, "$1", "$2"))
    assert [(k, int(n)) for k, n in rows(counts)] == [("a", 6), ("b", 2)]
    assert rows(projection.to_line(t, "k+n")) == [("a\t1",), ("a\t5",), ("b\t2",)]


def test_bad_counts(spark):
    bad = table(spark, [("a", "12"), ("b", ""), ("c", "abc"), ("d", "-1"), ("", "4"), ("e", "18446744073709551615")], ["k", "c"])
    got = dict(rows(projection.to_count(bad, "k", "c!")))
    assert {k: int(v) for k, v in got.items()} == {"a": 12, "b": 0, "c": 0, "d": 0, "e": 2**64 - 1}
    with pytest.raises(Exception, match="not a count"):
        projection.to_count(bad, "k", "c").df.collect()


def test_filters(spark):
    t = table(spark, [("ab", "1"), ("abc", "2"), ("b", "3")], ["k", "v"])
    assert rows(filtering.key_query(t, "ab")) == [("ab", "1")]
    assert rows(filtering.key_query(t, "a{98}*")) == [("ab", "1"), ("abc", "2")]
    assert rows(filtering.where(t, "record.V == ^2^ || record.k == ^b^")) == [("abc", "2"), ("b", "3")]
    with pytest.raises(ValueError):
        filtering.where(t, "record.none = 1")

    def last_only(batches):
        seen = None
        for pdf in batches:
            seen = pdf.iloc[-1:] if len(pdf) else seen
        if seen is not None:
            yield pd.DataFrame({"k": seen.k, "v": ["finish"] * len(seen)})

    filtering.register_filter("last", last_only)
    assert rows(filtering.user_filter(t.with_df(t.df.coalesce(1)), "last")) == [("b", "finish")]
    assert rows(filtering.filled_rows(table(spark, [("Filled_1", "x"), ("2", "x"), ("", "y"), ("Filled_3", "y")], ["l", "c"]), "l", "c", "y")) == [("", "y"), ("2", "x"), ("Filled_3", "y")]


def test_joins(spark):
    a = table(spark, [("1", "x"), ("1", "y"), ("2", "z"), ("3", "w")], ["k", "v"], name="a")
    b = table(spark, [("1", "p"), ("1", "q"), ("2", "r"), ("9", "s")], ["k", "v"], name="b")
    inner = joins.inner_join(a, b)
    assert inner.df.columns == ["k", "v", "b:v"]
    assert rows(inner) == [("1", "x", "p"), ("1", "x", "q"), ("1", "y", "p"), ("1", "y", "q"), ("2", "z", "r")]
    assert ("3", "w", "") in rows(joins.left_outer_join(a, b))
    nothing = b.with_df(b.df.where("false"))
    assert rows(joins.left_outer_join(a, nothing)) == [(*r, "") for r in rows(a)]
    assert rows(joins.filter_by_right(a, b)) == [("1", "x"), ("1", "y"), ("2", "z")]
    assert rows(joins.filter_not_right(a, b)) == [("3", "w")]
    with pytest.raises(Exception, match="different numbers"):
        joins.zip_join(a.df, b.df.limit(3)).collect()
    zipped = joins.zip_join(a.df.coalesce(1), b.df.coalesce(1)).orderBy("row_id").collect()
    assert [(r["v"], r["right:v"]) for r in zipped] == [("x", "p"), ("y", "q"), ("z", "r"), ("w", "s")]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from("abcé"), max_size=8), st.lists(st.sampled_from("abcé"), max_size=8))
def test_join_identities(spark, left, right):
    a, b = (table(spark, [(x, str(i)) for i, x in enumerate(xs)], ["k", n]) for xs, n in ((left, "v"), (right, "w")))
    semi, anti = rows(joins.filter_by_right(a, b)), rows(joins.filter_not_right(a, b))
    assert sorted(semi + anti) == rows(a)
    assert sorted({r[:2] for r in rows(joins.inner_join(a, b))}) == semi


def test_order_limit_sample(spark):
    t = table(spark, [(x,) for x in ("a1", "", "é", "b", "Z", "a")], ["k"])
    assert [r.k for r in ordering.sort(t).df.collect()] == ["", "Z", "a", "a1", "b", "é"]
    up = ordering.sort(t)
    assert ordering.sort(up) is up
    assert [r.k for r in ordering.head(ordering.sort(t, "-"), 2).df.collect()] == ["é", "b"]
    assert rows(ordering.random(t, 3)) == rows(ordering.random(t.with_df(t.df.repartition(3)), 3))
    assert len(rows(ordering.random(t, 99))) == 6
    merged = joins.merge("-", t, t)
    assert [r.k for r in merged.df.collect()][:2] == ["é", "é"]


def test_reduce(spark):
    s = Relation(spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 1, "z")], "key string, pos long, value string"), ("key",), "string")
    assert [(r.key, r.value) for r in reduction.reduce(s).df.orderBy("key").collect()] == [("a", "xy"), ("b", "z")]
    m = Relation(spark.createDataFrame([("a", {"x": 1, "y": 2}), ("a", {"y": 3})], "key string, edges map<string,int>"), ("key",), "map")
    assert reduction.reduce(m).df.first().edges == {"x": 1, "y": 5}
    with pytest.raises(ValueError):
        reduction.reduce(lines(spark, "a"))
    assert reduction.about(lines(spark).with_df(lines(spark, "a").df.where("false"))).count() == 0


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(0, 2000, 7).select(F.col("id").alias("k"))
    made = reduction.bloom_filter(keys, "k")
    every = spark.range(2000).select(F.col("id").alias("k"))
    got = {r.k for r in reduction.bloom_filtered(every, "k", made).collect()}
    assert got >= set(range(0, 2000, 7)) and len(got) < 400
    parts = [reduction.bloom_filter(keys.where(c), "k", n_keys=300) for c in ("k < 1000", "k >= 1000")]
    got = {r.k for r in reduction.bloom_filtered(every, "k", reduction.bloom_merged(*parts)).collect()}
    assert got >= set(range(0, 2000, 7)) and len(got) < 400
    with pytest.raises(ValueError):
        reduction.bloom_merged(made, reduction.bloom_filter(keys, "k", n_keys=5000))
    assert reduction.bloom_filter(keys.where("false"), "k") is None and reduction.bloom_filtered(every, "k", None).count() == 0
    assert reduction.bloom_merged(None, made) == made


@pytest.mark.parametrize("advisory", ["1m", "64m"])
def test_numbers_lose_no_rows(spark, advisory):
    """A million rows of over 100 MB in all, behind a shuffle, under adaptive execution."""
    from rankflow.storage import numbered_rows, placed_rows

    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", advisory)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        n = 1_000_000
        df = spark.range(n).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.hash("id")).alias("k"), F.concat(F.md5(F.col("id").cast("string")), F.md5(F.col("id").cast("string")), F.sha2(F.col("id").cast("string"), 256)).alias("wide"))
        got = numbered_rows(df.repartition("wide"), ["k", "wide"])
        facts = got.agg(F.count(F.lit(1)), F.count_distinct("record_no"), F.min("record_no"), F.max("record_no"), F.count_distinct("wide")).first()
        assert tuple(facts) == (n, n, 0, n - 1, n)
        assert got.where("record_no in (0, 400000, 999999)").count() == 3
        pairs = got.select("record_no", "k").join(got.select((F.col("record_no") - 1).alias("record_no"), F.col("k").alias("next")), "record_no")
        assert pairs.where("k > next").count() == 0
        facts = placed_rows(df.repartition("k")).agg(F.count(F.lit(1)), F.count_distinct("_at"), F.max("_at")).first()
        assert tuple(facts) == (n, n, n - 1)
        other = df.select(F.col("k").alias("k2"), F.length("wide").alias("size")).repartition("size")
        zipped = joins.zip_join(df.repartition("wide"), other, (["k"], ["k2"]))
        assert tuple(zipped.agg(F.count(F.lit(1)), F.count_if(F.col("k") != F.col("k2")), F.max("row_id")).first()) == (n, 0, n - 1)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_predicates_leave_quotes_alone(spark):
    t = table(spark, [("a&&b", "1"), ("c==d", "x"), ("e||f^", ""), ("it's", "2"), ("record.k", "3")], ["k", "v"])
    keep = lambda p, **o: [r[0] for r in rows(filtering.where(t, p, **o))]
    assert keep("record.k == 'a&&b'") == ["a&&b"] and keep('record.K == "c==d"') == ["c==d"] and keep("record.k == 'e||f^'") == ["e||f^"]
    assert keep("record.k == ^a&&b^ || record.k == 'record.k'") == ["a&&b", "record.k"]
    assert keep('record.k == "it\'s"') == keep("record.k == 'it''s'") == keep("record.k == 'it\\\'s'") == ["it's"]
    assert keep("!(record.v == '1') && record.v != '2' && record.v != ''") == ["c==d", "record.k"]
    assert keep("cast(record.v as int) >= 2") == ["it's", "record.k"]
    assert keep("6 / (cast(record.v as int) - 1) > 0") == ["it's", "record.k"]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        keep("cast(record.v as int) >= 2", strict=True)
    from pyspark.sql import Observation

    seen = Observation()
    assert len(rows(filtering.where(t, "cast(record.v as int) > 0", failures=seen))) == 3 and seen.get["failed"] == 2
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_keys_join_in_their_types(spark):
    a = Relation(spark.createDataFrame([("a\tb", "c", 1), ("a", "b\tc", 2), (None, "z", 3)], "p string, q string, n int"), ("p", "q"), "table", "a")
    b = Relation(spark.createDataFrame([("a", "b\tc", 9), (None, "z", 8)], "p string, q string, m int"), ("p", "q"), "table", "b")
    assert [r.n for r in joins.inner_join(a, b).df.collect()] == [2]
    one = Relation(spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), ("k",), "table", "a")
    two = Relation(spark.createDataFrame([(1, "p")], "k long, w string"), ("k",), "table", "b")
    text = Relation(spark.createDataFrame([("2", "q")], "k string, w string"), ("k",), "table", "c")
    assert rows(joins.inner_join(one, two)) == [(1, "x", "p")] and rows(joins.inner_join(one, text)) == [(2, "y", "q")]
    plan = joins.inner_join(one, two).df._jdf.queryExecution().optimizedPlan().toString()
    assert "concat_ws" not in plan


def test_concat_merge_and_reduce_by_function(spark):
    import pandas as pd

    a, b = table(spark, [("x", "1"), ("y", "2")], ["k", "v"]), table(spark, [("x", "3")], ["k", "v"])
    assert rows(joins.concat(a, b, source="from")) == [("x", "1", 0), ("x", "3", 1), ("y", "2", 0)]
    assert [tuple(r) for r in joins.merge("+", b, a).df.collect()] == [("x", "3"), ("x", "1"), ("y", "2")]

    def longest(rows, before):
        every = rows if before is None else pd.concat((before, rows))
        return every.assign(n=every.v.str.len()).sort_values(["n", "v"]).tail(1)[["k", "v"]]

    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), F.col("id").cast("string").alias("v")).repartition(6)
    got = {r.k: r.v for r in reduction.reduce_by_function(Relation(df, ("k",)), longest, lambda r: r.assign(v="<" + r.v + ">")).df.collect()}
    assert len(got) == 51 and got["hot"] == "<2997>" and got["k1"] == "<2951>"


def test_filters_from_files_and_own_operators(spark, tmp_path):
    (tmp_path / "long.py").write_text("SCHEMA = 'k string, n long'\n\ndef accept(batches):\n    for b in batches:\n        b = b.assign(n=b.v.str.len())\n        yield b[b.n > 1][['k', 'n']]\n")
    t = table(spark, [("a", "xx"), ("b", "y"), ("c", "zzz")], ["k", "v"])
    assert rows(evaluate(spark, f"t ^ {tmp_path}/long.py ^ Sort(-)", {"t": t})) == [("a", 2), ("c", 3)]
    filtering.register_operator("first_key", lambda r: r.with_df(r.df.orderBy(*r.keys).limit(1)))
    assert rows(evaluate(spark, "t ^ Apply(first_key)", {"t": t})) == [("a", "xx")]
    with pytest.raises(ValueError, match="accept"):
        filtering.load_filter("x = 1", "bad")
    with pytest.raises(ValueError, match="no user operator"):
        evaluate(spark, "t ^ Apply(nothing)", {"t": t})


def test_options_of_tables(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Name  Size\nx   1\r\ny 2\n")
    r = readers.delimited(spark, f"{tmp_path}/a.txt", " ", collapse=True, case="lower")
    assert r.df.columns == ["name", "size"] and rows(r) == [("x", "1"), ("y", "2")]
    (tmp_path / "b.txt").write_text("1;2,3\n4,5\n")
    assert rows(readers.delimited(spark, f"{tmp_path}/b.txt", ";,", header=False)) == [("1", "2", "3"), ("4", "5", "")]
    got = readers.jdbc_options("jdbc:x", "t", "id", 0, 100, 8)
    assert got["numPartitions"] == "8" and got["upperBound"] == "100" and "partitionColumn" not in readers.jdbc_options("jdbc:x", "t")
    t = table(spark, [("a", "1"), ("b", "2")], ["k", "v"])
    asked = spark.createDataFrame([("a",), ("z",)], "key string")
    assert sorted(map(tuple, readers.get_or_missing(t, asked).collect())) == [("a", True, "a", "1"), ("z", False, None, None)]
    assert [r.k for r in readers.get_record_no(t, 1).collect()] == ["b"] and readers.get_record_no(t, 2).count() == 0


def test_shared_folder_is_needed_on_a_cluster(spark):
    from types import SimpleNamespace

    from rankflow import storage

    fake = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master, applicationId=master))
    with pytest.raises(ValueError, match="checkpoint"):
        storage.shared_dir(fake("yarn"))
    assert storage.shared_dir(fake("local[4]")) == storage.shared_dir(fake("local[4]"))
    df, path = storage.stored(spark.range(3).toDF("x"), "gone")
    assert df.count() == 3
    storage.drop(spark, path)
    assert not __import__("os").path.exists(path.removeprefix("file://").removeprefix("file:"))


def test_expression_language(spark, tmp_path):
    (tmp_path / "in.tsv").write_text("name\tcount\nb\t2\na\t1\nb\t5\n")
    assert tokens("a ^ Where(x > 5 ^^ y) ^ 'q>^' > out") == (["a", "Where(x > 5 ^^ y)", "'q>^'"], "out")
    out = evaluate(spark, f"{tmp_path}/in.tsv ^ ToCount(name,count) ^ Reduce ^ Sort(-) > {tmp_path}/out")
    assert [(r.key, int(r["count"])) for r in out.df.collect()] == [("b", 7), ("a", 1)]
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out").collect()) == ["a\t000000000001", "b\t000000000007"]
    (tmp_path / "e.txt").write_text(f"{tmp_path}/in.tsv ^ ToCount(name) ^\nReduce ^ 'a*'")
    assert rows(evaluate(spark, f"@{tmp_path}/e.txt"))[0][0] == "a"
    t = table(spark, [("x", "1")], ["k", "v"])
    assert rows(evaluate(spark, "t ^ t ^ t ^ Concat(3) ^ Where(v > 0) ^ Head(2)", {"t": t})) == [("x", "1")] * 2
    assert evaluate(spark, "null0 ^ Head(4)").df.distinct().count() == 1
    assert evaluate(spark, "null ^ 'a*' ^ Head(6)").df.where("key like 'a%'").count() == 6
    with pytest.raises(ValueError, match="Head"):
        evaluate(spark, "null ^ Sort")
    assert evaluate(spark, "t ^ About", {"t": t}).df.first().num_records == 1
    for bad in ("t ^ t", "t ^ Nope(1)", "InnerJoin", "t ^ Head(x)", "t ^ Where(", "t > a > b", "sql:server/db/t"):
        with pytest.raises(ValueError):
            evaluate(spark, bad, {"t": t})


@pytest.mark.parametrize("end", ["out.csv", "out.tsv", "out.parquet", "out.xml", "records:out.rec", "store:out.store", "out.tsv.gz"])
def test_round_trips(spark, tmp_path, end):
    t = table(spark, [("b", 'say "x", y'), ("a", "é\tz")], ["k", "v"])
    scheme, _, name = end.rpartition(":")
    uri = f"{scheme + ':' if scheme else ''}{tmp_path}/{name}"
    writers.write_uri(t, uri)
    back = readers.open_uri(spark, f"xml:row:{tmp_path}/{name}" if end.endswith(".xml") else uri)
    assert sorted((r.k, r.v) for r in back.df.collect()) == [("a", "é\tz"), ("b", 'say "x", y')]
    writers.write_uri(t, "null")


def test_more_sources(spark, tmp_path):
    for n, text in (("a.txt", "one\n"), ("b.txt", "two\n"), ("c.log", "no\n")):
        (tmp_path / n).write_text(text)
    assert rows(readers.open_uri(spark, f"dir:{tmp_path}\\*.txt")) == [("one",), ("two",)]
    (tmp_path / "list").write_text(f"# files\n{tmp_path}/a.txt\n@{tmp_path}/more\n")
    (tmp_path / "more").write_text(f"{tmp_path}/b.txt\n")
    assert rows(readers.open_uri(spark, f"multi:{tmp_path}/list")) == [("one",), ("two",)]
    (tmp_path / "q.csv").write_text('k,v\n"a, b","line\nbreak ""q"""\n')
    assert rows(readers.open_uri(spark, f"{tmp_path}/q.csv")) == [("a, b", 'line\nbreak "q"')]
    t = table(spark, [(x, x) for x in "dbca"], ["k", "v"])
    assert [(r.record_no, r.k) for r in readers.numbered(t).orderBy("record_no").collect()] == list(enumerate("abcd"))
    assert rows(readers.get_record(t, "c")) == [("c", "c")] and rows(readers.get_prefix(t, "")) == rows(t)


def test_runs_over_a_whole_relation_by_ranges(spark):
    import random

    from rankflow.functions import vectors

    r = random.Random(3)
    values = [v for v in r.choices(["a", "b", None, "a"], k=60) for _ in range(r.randint(1, 40))]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").repartition(5)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        groups = {x.i: x.group_no for x in ordering.contiguous_groups(df, "v", ["i"]).collect()}
        runs = sorted((x.start, x.length, x.value) for x in vectors.run_lengths(df, "v", ["i"]).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    number, want, at = -1, {}, []
    for i, v in enumerate(values):
        if i == 0 or v != values[i - 1]:
            number += 1
            at.append([i, 0, v])
        want[i] = number
        at[-1][1] += 1
    assert groups == want and runs == [tuple(x) for x in at]
    assert ordering.contiguous_groups(df.where("false"), "v", ["i"]).count() == 0


def test_whole_numbers_do_not_wrap_around(spark):
    df = spark.createDataFrame([(2147483647, 9223372036854775807), (1, 1), (None, None)], "x int, y bigint")
    r = Relation(df, ("x",))
    assert filtering.where(r, "record.x + 1 < 0").df.count() == 0 and filtering.where(r, "record.y + 1 < 0").df.count() == 0
    assert filtering.where(r, "record.x + 1 > 2147483647").df.count() == 1 and filtering.where(r, "record.y * 2 > 4").df.count() == 1
    assert "CAST" not in filtering.predicate_sql("record.x == 1 && record.y != 'a+b'", ["x", "y"], {"x": "int", "y": "bigint"})


def test_concat_of_keys_of_different_types(spark):
    numbers = Relation(spark.createDataFrame([(1, 2)], "key int, n int"), ("key",))
    texts = Relation(spark.createDataFrame([("a", 2)], "key string, n bigint"), ("key",))
    assert sorted(tuple(x) for x in joins.concat(numbers, texts).df.collect()) == [("1", 2), ("a", 2)]
    assert [x.key for x in joins.merge("-", numbers, texts).df.collect()] == ["a", "1"]


def test_functions_are_called_by_key_not_by_batch(spark):
    """Few rows of many keys are not folded before the shuffle; a hot key's are."""
    import pandas as pd

    calls = spark.sparkContext.accumulator(0)

    def summed(rows, before):
        calls.add(1)
        every = rows if before is None else pd.concat((before, rows))
        return every.iloc[[0]].assign(n=every["n"].sum())

    df = spark.range(60_000).select(F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id") % 500).alias("k"), F.lit(1).cast("long").alias("n")).repartition(2)
    got = {r.k: r.n for r in reduction.reduce_by_function(Relation(df, ("k",)), summed).df.collect()}
    assert got == {-1: 30_000} | {k: 120 for k in range(1, 500, 2)}
    assert calls.value < 800  # once a key before and after; by batches of 10,000 rows it would be over 1,500

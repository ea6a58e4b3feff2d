"""Ordered lines, quoted tables in splits, store indexes."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from rankflow.relation import Relation
from rankflow.sources import ordered, quoted, readers, store_index, writers


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_lines_of_several_files_in_order(spark, tmp_path, small_splits):
    want = []
    for name, n in (("b", 3000), ("a", 1), ("with space", 700), ("c", 0)):
        (tmp_path / name).write_text("".join(f"{name} {i} {'x' * (i % 50)}\n" for i in range(n)))
    many = tmp_path / "folder"
    many.mkdir()
    for k in range(5):
        (many / f"part-{k}").write_text("".join(f"part {k} {i}\n" for i in range(10 * (5 - k))))
    paths = [str(tmp_path / p) for p in ("b", "a", "folder", "with space", "c", "a")]
    for p in ("b", "a"):
        want += (tmp_path / p).read_text().splitlines()
    for k in range(5):
        want += (many / f"part-{k}").read_text().splitlines()
    want += (tmp_path / "with space").read_text().splitlines() + (tmp_path / "a").read_text().splitlines()
    rows = sorted(ordered.numbered_lines(spark, paths).collect())
    assert [r.line_no for r in rows] == list(range(len(want))) and [r.value for r in rows] == want
    assert ordered.ordered_lines(spark, paths).rdd.getNumPartitions() > 5
    writers.concatenated(spark, paths, str(tmp_path / "out"))
    written = "".join(f.read_text() for f in sorted((tmp_path / "out").glob("part-*")))
    assert written.splitlines() == want
    assert [(r.line_no, r.value) for r in sorted(ordered.copy_lines(spark, paths, 5, 4).collect())] == [(i, want[i]) for i in range(5, 9)]


def test_states_of_line_ends():
    inside = lambda text, start=False, sep=",": quoted.ends_inside(text, sep, start)
    assert not inside("a,b") and inside("a,b", True) and inside('"a') and not inside('"a"') and inside('x,"a""') and not inside('x,"a"""')
    assert not inside('5" pipe,6"') and inside(' "a') and not inside('b",c', True) and inside('b","c', True) and not inside('""') and inside('""', True)
    assert inside('x\t"a', sep="\t") and not inside('\t"a"', sep="\t")
    # First states follow from those of all splits before, whatever their order.
    rows = [("f", 20, False, True, False, False), ("f", 0, True, False, True, False), ("f", 10, True, True, False, True), ("g", 0, False, True, False, False), ("f", 30, False, False, False, True)]
    assert quoted.first_states(rows) == {("f", 0): (False, 0), ("f", 10): (True, 0), ("f", 20): (True, 10), ("f", 30): (True, 10), ("g", 0): (False, 0)}


def _csv(rows, separator=",", end="\n"):
    out = io.StringIO()
    w = csv.writer(out, delimiter=separator, lineterminator=end)
    w.writerows(rows)
    return out.getvalue()


def _reference(spark, path, separator=","):
    """One task a file: Spark's reader with multiLine."""
    return spark.read.options(sep=separator, header=True, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).csv(path)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_line_ends_across_splits(spark, tmp_path, small_splits, end):
    r = random.Random(7)
    items = lambda: r.choice(["plain", "", "with, comma", 'a "quote"', "two\nlines", "many\n\nlines\nof \"text\",\nhere", "é漢", "x" * r.randint(1, 300), "\n".join(["y" * 200] * r.randint(20, 60)) if r.random() < 0.05 else "z"])
    folder = tmp_path / "t"
    folder.mkdir()
    for k in range(3):
        rows = [["id", "name", "long text"]] + [[str(1000 * k + i), items(), items()] for i in range(400)]
        (folder / f"{k}.csv").write_bytes(_csv(rows, end=end).encode())
    records, splits = quoted.quoted_records(spark, str(folder))
    assert len(splits) > 20 and records is not None and records.rdd.getNumPartitions() > 4
    assert any(inside for inside, _ in quoted.first_states(splits).values())
    got = readers.delimited(spark, str(folder), ",").df
    want = _reference(spark, str(folder)).fillna("")
    assert got.columns == want.columns == ["id", "name", "long text"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() == 1200
    typed = readers.delimited(spark, str(folder), ",", schema="id int, name string, t string").df
    assert typed.agg(F.sum("id")).first()[0] == sum(1000 * k + i for k in range(3) for i in range(400))


def test_plain_tables_stay_line_wise(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text(_csv([["k", "v"]] + [[i, f'say "{i}"'] for i in range(2000)]))
    assert quoted.quoted_records(spark, str(tmp_path / "a.csv"))[0] is None
    df = readers.delimited(spark, str(tmp_path / "a.csv"), ",").df
    assert df.rdd.getNumPartitions() > 3 and df.count() == 2000 and df.where("k = '7'").first().v == 'say "7"'
    (tmp_path / "a.tsv").write_text(_csv([["k", "v"]] + [[i, "x" * 20] for i in range(2000)], "\t"))
    df = readers.delimited(spark, str(tmp_path / "a.tsv"), "\t").df
    assert df.rdd.getNumPartitions() > 3 and df.count() == 2000


def test_tables_of_every_kind(spark, tmp_path):
    read = lambda text, **k: (tmp_path / "x.csv").write_bytes(text.encode()) and [tuple(r) for r in quoted.quoted_table(spark, str(tmp_path / "x.csv"), **k).collect()]
    assert read('a,b\n\n"1\n2",3\n') == [("1\n2", "3")]
    assert read('\n\n"a\nb",c\n1,2\n') == [("1", "2")]
    assert read('1,"2\n3"\n4,5', header=False) == [("1", "2\n3"), ("4", "5")]
    assert read('a,a,\n"1\n",2,3\n') == [("1", "2", "3")] or read('a,a,\n"1\n",2,3\n') == [("1\n", "2", "3")]
    assert read('a,b\n"never closed\nto the end') == [("never closed\nto the end", None)]
    assert read('a,b\n5" pipe,"x\ny"\n') == [('5" pipe', "x\ny")]
    (tmp_path / "empty.csv").write_text("")
    assert quoted.quoted_records(spark, str(tmp_path / "empty.csv")) == (None, [])


def test_store_index(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.range(5000).select((F.pmod(F.hash("id"), F.lit(700)) * 3).cast("int").alias("k"), F.col("id").alias("v"), F.lit("x" * 50).alias("w"))
    r = Relation(rows, ("k", "v"))
    writers.write_store(r, path, 9)
    want = sorted((x.k, x.v) for x in rows.collect())
    index = store_index.index_of(spark, path)
    assert index.count() == 9 and store_index.record_count(spark, path) == 5000
    assert spark.read.parquet(path).count() == 5000 and set(spark.read.parquet(path).columns) == {"k", "v", "w"}
    assert sorted((x.record_no, x.k, x.v) for x in store_index.numbered_store(spark, path).collect()) == [(i, *kv) for i, kv in enumerate(want)]
    for n in (0, 1, 2500, 4999):
        found = store_index.record_by_no(spark, path, n)
        assert [(x.record_no, x.k, x.v) for x in found.collect()] == [(n, *want[n])]
        assert len(found.inputFiles()) == 1
    for n in (-1, 5000, 10**12):
        assert store_index.record_by_no(spark, path, n).count() == 0
    for k in (0, 3, 900, 2097):
        places = [i for i, (a, _) in enumerate(want) if a == k]
        assert sorted(x.record_no for x in store_index.records_of_key(spark, path, k).collect()) == places
        assert store_index.record_no(spark, path, k) == (places[0] if places else -1)
        assert len(store_index.records_of_key(spark, path, k).inputFiles()) < 9
    k, v = want[1234]
    assert store_index.record_no(spark, path, k, v) == 1234
    assert store_index.record_no(spark, path, 1) == store_index.record_no(spark, path, 10**6) == -1
    plan = store_index.records_of_key(spark, path, 900)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,900)" in plan
    # An empty store has an index without rows.
    writers.write_store(Relation(rows.where("false"), ("k",)), str(tmp_path / "none"))
    assert store_index.record_count(spark, str(tmp_path / "none")) == 0 and store_index.record_by_no(spark, str(tmp_path / "none"), 0).count() == 0


def test_plain_paths_are_known_by_what_lies_there(spark, tmp_path):
    df = spark.range(20).selectExpr("id AS k", "id * 2 AS v")
    r = Relation(df, ("k",))
    writers.write_store(r, str(tmp_path / "a"), 2)
    writers.write_records(r, str(tmp_path / "b"))
    (tmp_path / "c").write_text("x\ny\n")
    for name, n, columns in (("a", 20, ["k", "v"]), ("b", 20, ["k", "v"]), ("c", 2, ["key"])):
        got = readers.open_uri(spark, str(tmp_path / name))
        assert got.df.count() == n and got.df.columns == columns
    from rankflow.sources import bucketed

    bucketed.write_buckets(r, str(tmp_path / "d"), 2)
    assert readers.open_uri(spark, str(tmp_path / "d")).df.count() == readers.open_uri(spark, f"buckets:{tmp_path}/d").df.count() == 20
    # A missing text file is looked for as a compressed one.
    import gzip

    (tmp_path / "e.tsv.gz").write_bytes(gzip.compress(b"k\tv\n1\t2\n"))
    (tmp_path / "f.gz").write_bytes(gzip.compress(b"one\ntwo\n"))
    assert readers.open_uri(spark, str(tmp_path / "e.tsv")).df.collect()[0][:] == ("1", "2")
    assert readers.open_uri(spark, str(tmp_path / "f")).df.count() == 2


def test_levels_of_compression(spark, tmp_path):
    r = random.Random(1)
    words = ["".join(r.choice("abcdef") for _ in range(5)) for _ in range(300)]
    rel = Relation(spark.createDataFrame([(" ".join(r.choice(words) for _ in range(40)),) for _ in range(3000)], "key string").coalesce(1), ("key",), "line")
    sizes = {}
    for level in (1, 9):
        writers.write_lines(rel, str(tmp_path / f"l{level}"), "gzip", level)
        sizes[level] = sum(f.stat().st_size for f in (tmp_path / f"l{level}").glob("*.gz"))
        assert spark.read.text(str(tmp_path / f"l{level}")).count() == 3000
    assert sizes[9] < sizes[1]
    with pytest.raises(ValueError):
        writers.write_lines(rel, str(tmp_path / "x"), "bzip2", 3)


def test_keys_are_marked_in_the_header(spark, tmp_path):
    r = Relation(spark.createDataFrame([("1", "a", "x"), ("2", "b", "y")], "n string, k string, v string"), ("v", "n"))
    for end, separator in ((".tsv", "\t"), (".csv", ",")):
        writers.write_table(r, str(tmp_path / f"t{end}"), separator, key_marks=True)
        header = next(f for f in (tmp_path / f"t{end}").glob("part-*")).read_text().split("\n")[0]
        assert header == separator.join(("n=Key.2", "k", "v=Key.1"))
        back = readers.open_uri(spark, str(tmp_path / f"t{end}"))
        assert back.keys == ("v", "n") and sorted(map(tuple, back.df.collect())) == [("1", "a", "x"), ("2", "b", "y")]
    assert readers.delimited(spark, str(tmp_path / "t.tsv"), key="k").keys == ("k",)

import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankflow.functions import bits, dates, lookups, segments, text, urls, vectors


def value(spark, column, **named):
    df = spark.createDataFrame([tuple(named.values())], list(named)) if named else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("url", "turned"),
    [
        ("http://www.foo.com:8080/a/b?x=1", "h8080-com.foo.www./a/b?x=1"),
        ("https://a.b", "s-----b.a./"),
        ("http://1.2.3.4/x", "h-----1.2.3.4./x"),
        ("http://one/", None),
        ("http://a..b/", None),
        ("ftp://a.b/", None),
        ("http://a.b?q", "h-----b.a./?q"),
    ],
)
def test_url_reverse(spark, url, turned):
    assert value(spark, urls.reverse(F.col("u")), u=url) == turned


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["http", "https"]), st.lists(st.from_regex(r"[a-z][a-z0-9-]{0,5}", fullmatch=True), min_size=2, max_size=4), st.sampled_from(["", ":80", ":65535"]), st.from_regex(r"/[a-z0-9/?=]{0,8}", fullmatch=True)), min_size=20, max_size=20))
def test_url_reverse_back(made):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    given_urls = [f"{s}://{'.'.join(h)}{p}{r}" for s, h, p, r in made]
    df = spark.createDataFrame([(u,) for u in given_urls], "u string")
    assert [r.b for r in df.select(urls.reverse_back(urls.reverse(F.col("u"))).alias("b")).collect()] == given_urls


def test_url_parts(spark):
    u = F.col("u")
    assert value(spark, urls.domain(u, ["co.uk"]), u="http://a.b.foo.co.uk/x") == "foo.co.uk"
    assert value(spark, urls.domain(u), u="http://a.b.foo.co.uk/x") == "co.uk"
    s = value(spark, urls.segmented(u), u="http://m.www.foo.com/dir/x?y")
    assert (s.domain, s.host_suffix, s.l1_suffix, s.url_suffix) == ("foo.com", "m.www", "dir", "/x?y")
    assert value(spark, urls.first_path(u), u="http://a.b/c/d") == "a.b/c/"
    assert [value(spark, urls.is_home_page(u), u=x) for x in ("http://a.b", "http://a.b/", "http://a.b/x", "http://a.b/?q", "http://a.b/#f")] == [True, True, False, False, False]
    for url, day in (("http://a.b/2011-03-04/x", 20110304), ("http://a.b/2012.12.31", 20121231), ("http://a.b/2011-03.04/", None), ("http://a.b/x2011-03-04", None), ("http://a.b/2011-03-04?x", None), ("http://a.b/2011-03-04/2011-03-05/", None), ("http://a.b/2010-03-04/", None), ("http://a.b/2011-02-32/", None)):
        assert value(spark, urls.url_date(u), u=url) == day, url
    assert value(spark, urls.is_blog_host(u, ("blog", "press")), u="my.wordPress.com")


def test_text(spark):
    c = F.col("c")
    assert [value(spark, text.is_a_number(c), c=x) for x in ("1,234.5", "12", ".", "", "1.2.3", "-1", "1e3", ",")] == [True, True, False, False, False, False, False, False]
    assert [value(spark, text.to_number(c), c=x) for x in ("1,234.5", " 2e3 ", "0xfF", "x", "0x")] == [1234.5, 2000.0, 255.0, None, None]
    assert value(spark, text.count_text(c), c=1234567890123456) == "1234567890123456" and value(spark, text.count_text(c), c=7) == "000000000007"
    for a, b, n in (("abc", "abd", 2), ("", "x", 0), ("ab", "abc", 2), ("abc", "abc", 3), ("x", "y", 0)):
        assert value(spark, text.common_prefix_length(F.col("a"), F.col("b")), a=a, b=b) == n
    assert value(spark, text.floats(c), c="1\tx\t2.5") == [1.0, None, 2.5]
    assert value(spark, text.line_of(text.floats(c)), c="1\t2.5") == "1.0\t2.5"
    assert [value(spark, text.is_config_line(c), c=x) for x in ("a=1", " # c", "", "[s]", ";x")] == [True, False, False, True, False]


def test_dates_and_bits(spark):
    n = F.col("n")
    assert [value(spark, dates.quantize_age(n), n=x) for x in (20, 21, 30, 31, 80, 81, 119, 121, 150)] == [20, 20, 30, 30, 80, 80, 110, 120, 150]
    assert value(spark, dates.day_version(n.cast("date")), n="2009-02-01") == 31 and value(spark, dates.day_version(n.cast("date")), n="2001-01-01") == 0
    assert value(spark, dates.day_of_version(n), n=31) == datetime.date(2009, 2, 1)
    assert value(spark, dates.int_days_between(F.col("a"), F.col("b")), a=20120301, b=20120228) == 2
    assert value(spark, dates.day_of_int(n), n=20121340) is None
    m = F.lit(5).cast("long")
    assert value(spark, bits.names_of(m, ["a", "b", "c"])) == "a|c"
    assert value(spark, bits.set_bit(m, 63)) == 5 - 2**63 and value(spark, bits.clear_bit(m, 0)) == 4
    assert value(spark, bits.has_bit(m, 2)) and not value(spark, bits.has_common(m, F.lit(2).cast("long")))
    assert value(spark, bits.merge_tier(m, F.lit(2).cast("long"), 9)) == 9
    assert value(spark, bits.bit_array(m, 4)) == [1, 0, 1, 0]


def test_segments(spark):
    a, b = F.array(F.lit(1.0), F.lit(3.0)), F.array(F.lit(2.0), F.lit(0.5))
    assert value(spark, segments.add(a, b)) == [3.0, 3.5] and value(spark, segments.largest(a, b)) == [2.0, 3.0]
    assert value(spark, segments.normalized(a)) == [0.25, 0.75]
    assert value(spark, segments.preselected(a, F.lit(2).cast("long"), F.array(F.lit(0.0), F.lit(3.0)))) == [0.0, 3.0]
    assert value(spark, segments.propagated(a, b, F.lit(0.5))) == [1.5, 1.75]
    assert value(spark, segments.sampling_penalty(F.lit(0.005))) == pytest.approx(2.718281828 ** (-2 * 0.5))
    assert value(spark, segments.blend_weight(F.lit(0.5), F.lit(0.001))) == 1.0 and value(spark, segments.blend_weight(F.lit(0.001), F.lit(0.003))) == pytest.approx(0.25)
    assert value(spark, segments.blend_weight(F.lit(0.0), F.lit(0.0))) == pytest.approx(0.5) and value(spark, segments.blend_weight(F.lit(0.004), F.lit(5.0))) == pytest.approx(0.4)
    assert value(spark, segments.rank_64k(F.lit(1.1))) == 65535 and value(spark, segments.rank_64k(F.lit(0.0))) == 0


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(4.0), F.lit(6.0))
    assert value(spark, vectors.dot(a, b)) == 16.0 and value(spark, vectors.distance(a, b)) == 5.0
    df = spark.createDataFrame([(1.0,), (1.0,), (2.0,), (5.0,)], "x double")
    assert sorted(tuple(r) for r in vectors.histogram(df, "x", 4).collect()) == [(0, 1.0, 2.0, 3), (3, 4.0, 5.0, 1)]
    flat = df.where("x = 1")
    assert vectors.histogram(flat, "x", 4).first().n == 2 and {r.rescaled for r in vectors.rescaled(flat, "x", 3.0, 4.0).collect()} == {3.0}
    assert vectors.histogram(df.where("false"), "x", 4).count() == 0


def test_site(spark):
    prefixes = spark.createDataFrame([("www.a.com/x/",), ("b.a.com/",), ("b.a.com/",), (None,)], "prefix string")
    rows = ["http://www.a.com/x/y", "http://b.a.com/x/y", "http://www.a.com/z/y", "http://a.com/x/y", "nonsense", None]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, u string")
    found = {r.i: r.site for r in urls.site(df, "u", prefixes).collect()}
    assert found == {0: "www.a.com/x/", 1: "b.a.com/", 2: "a.com/", 3: "a.com/", 4: None, 5: None}


def test_url_list(spark):
    lines = spark.createDataFrame([(" http://a.b/c ",), ("http://a.b/c",), ("",), ("  ",), ("h-----b.a./",), ("http://bad/",), (None,)], "value string")
    assert sorted(r.url for r in urls.url_list(lines).collect()) == ["h-----b.a./", "h-----b.a./c"]


@pytest.mark.parametrize(
    ("domain", "suffix", "out"),
    [("h-----cc.co.", "x.", True), ("h-----cc.co.", "www.", False), ("H-----com.live.", "cid-12.", True), ("h-----com.live.", "mail.", False), ("h-----com.foo.", "x.", False), (None, "x.", False)],
)
def test_is_excludable(spark, domain, suffix, out):
    df = spark.createDataFrame([(domain, suffix)], "d string, s string")
    assert df.select(urls.is_excludable(F.col("d"), F.col("s")).alias("x")).first().x is out


def test_mapped(spark):
    df = spark.createDataFrame([("html",), (" PS ",), ("odd",), (None,)], "k string")
    assert [r.x for r in df.select(lookups.file_format(F.col("k")).alias("x")).collect()] == ["html", "pdfps", "Unknown", "Unknown"]
    assert df.select(lookups.mapped(F.col("k"), {}, 3).alias("x")).first().x == 3


def test_inherited(spark):
    df = spark.createDataFrame([("s1", "g1"), ("s2", "g1"), ("s3", "g2"), (None, None)], "s string, g string")
    own = spark.createDataFrame([("s1", 1), ("s2", None)], "s string, n int")
    group = spark.createDataFrame([("g1", 2), ("g1", 1)], "g string, n int")
    none = spark.createDataFrame([], "n int")
    got = lookups.inherited(df, "n", [(own, ["s"]), (group, ["g"]), (none, [])], 9)
    assert {r.s: r.n for r in got.collect()} == {"s1": 1, "s2": 2, "s3": 9, None: 9}

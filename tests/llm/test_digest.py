import hashlib
import random

import duckdb
import pytest

from rankflow.llm import digest as m


def naive_code(text):
    """Length steps and the quartile of each bucket, one triplet after another."""
    b = text.encode()
    size = len(b)
    if 0 < size < 3:
        b += b"\0" * (3 - size)
    counted = [0] * 256
    for i in range(len(b) - 2):
        counted[((b[i] + 256 * b[i + 1] + 65536 * b[i + 2]) * 2654435761 % 2**32) >> 24] += 1
    s = sorted(counted)
    code = [sum(c > s[q] for q in (63, 127, 191)) for c in counted]
    power = size.bit_length()
    return (8 * power + int((size / 2**power - 0.5) * 16) if size else 0), code


def naive_likeness(a, b):
    (s, x), (t, y) = naive_code(a), naive_code(b)
    return 1 - min(512, 28 * min(12, abs(s - t)) + sum([0, 1, 2, 6][abs(p - q)] for p, q in zip(x, y, strict=True))) / 512


def naive_digest(text):
    s, c = naive_code(text)
    return f"{s:03x}" + "".join(f"{4 * c[i] + c[i + 1]:x}" for i in range(0, 256, 2))


def brute(ordered):
    out = []
    for i, (doc_id, text) in enumerate(ordered):
        follow = ordered[(i + 1) % len(ordered)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + follow[:cut]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), naive_digest(text), naive_digest(edited), naive_likeness(text, edited), naive_likeness(text, follow)))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def texts(n, seed=1):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéß漢😀") for _ in range(r.randint(1, 6))) for _ in range(60)]
    return [" ".join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 3, 30, 300]))) for _ in range(n)]


@pytest.mark.parametrize("parts", [1, 7])
def test_same_as_brute_force(spark, parts):
    rows = list(enumerate(["", "a", "ab", "abc", "😀", "\0\0", *texts(60)]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    assert got(m.document_digests(df)) == brute(sorted(rows, reverse=True))


def test_every_case(spark):
    schema = "doc_id long, text string"
    empty = spark.createDataFrame([], schema)
    assert m.document_digests(empty).count() == 0 and m.fingerprints(empty).count() == 0
    assert got(m.document_digests(spark.createDataFrame([(3, "one alone")], schema))) == brute([(3, "one alone")])
    assert got(m.document_digests(spark.createDataFrame([(None, None)], schema))) == brute([(None, "")])
    # Null ids come last; repeated rows give a row each; other columns are ignored.
    rows = [(2, "b b b b"), (None, "no id"), (1, None), (5, "five five five"), (1, None)]
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 AS part", "'x' AS fingerprint", "'y' AS end", "2 AS n_chars")
    assert got(m.document_digests(df)) == brute([(5, "five five five"), (2, "b b b b"), (1, ""), (1, ""), (None, "no id")])
    # One id on many rows with different texts: dealt over several ranges, each row once.
    many = spark.createDataFrame([(7, f"text {i} " * 5) for i in range(500)], schema).repartition(5)
    found = m.document_digests(many).collect()
    assert len(found) == 500 and {r.fingerprint for r in found} == {naive_digest(f"text {i} " * 5) for i in range(500)}


def test_long_texts_are_counted_in_pieces():
    long = ("".join(texts(40, 2)) * 40).encode()
    assert len(long) > 100_000
    whole = m.counts([long, b"abc", long[:70_001]])
    old, m._PIECE = m._PIECE, 1000
    try:
        assert (m.counts([long, b"abc", long[:70_001]]) == whole).all()
    finally:
        m._PIECE = old
    assert whole.sum(1).tolist() == [len(long) - 2, 1, 69_999]


def test_edited_texts_are_nearer_than_the_next(spark):
    found = m.document_digests(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("n_chars >= 300").toPandas()
    assert (found.near_edited > 0.6).mean() > 0.9 and (found.near_next > 0.6).mean() < 0.15
    assert (found.near_edited > found.near_next).mean() > 0.95
    assert found[["near_edited", "near_next"]].min().min() >= 0 and found[["near_edited", "near_next"]].max().max() <= 1


def test_likeness_of_pairs(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["some text", "some text", "another one", None])], "doc_id long, text string")
    prints = m.fingerprints(docs)
    pairs = prints.selectExpr("doc_id AS a", "fingerprint AS fa").crossJoin(prints.selectExpr("doc_id AS b", "fingerprint AS fb")).selectExpr("*", "if(a = 3, null, fa) AS f")
    found = {(r.a, r.b): r.likeness for r in m.likeness(pairs, "f", "fb").collect()}
    assert found[0, 1] == 1.0 and found[0, 2] == naive_likeness("some text", "another one") and found[3, 0] is None


def test_against_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = sorted(con.execute(m.digest_sql()).fetchall())
    assert sorted(tuple(r) for r in m.document_digests(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()) == want

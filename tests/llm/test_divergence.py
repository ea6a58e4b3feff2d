import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from rankflow.llm import divergence as m

SCHEMA = "text string, lang string, source string"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=30, ranks=50):
    docs = [(TERM.findall((t or "").translate(SMALL)), lang or "", s or "") for t, lang, s in rows]
    out = []
    for lang in {d[1] for d in docs}:
        df = Counter(t for w, own, _ in docs if own == lang for t in set(w))
        kept = sorted(t for t, n in df.items() if n >= least)
        counted = {s: Counter() for _, own, s in docs if own == lang}
        for w, own, s in docs:
            if own == lang:
                counted[s].update(t for t in w if df[t] >= least)
        every = Counter()
        for c in counted.values():
            every.update(c)
        share = lambda c, t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))  # noqa: E731, B023
        p = {s: [share(c, t) for t in kept] for s, c in counted.items()}
        q = [share(every, t) for t in kept]
        for s in counted:
            pairs = [(sum(abs(a - b) for a, b in zip(p[s], p[o], strict=True)), o) for o in counted if o != s]
            terms = [(a - b, t) for a, b, t in zip(p[s], q, kept, strict=True) if counted[s][t] and a > b]
            for part, found in (("pair", pairs), ("term", terms)):
                order = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(order) if part == "pair" or k < ranks]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def corpus(n=400, sources=9, seed=3):
    r = random.Random(seed)
    vocabulary = ["Word", "word", "Été", "été", "x1y", "don't", "漢字", "a b", "Ünder_score", *(f"t{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))]
    rows = [(" ".join(r.choices(vocabulary, k=r.randint(0, 30))), r.choice(["en", "fr", None]), f"s{min(r.randrange(sources), r.randrange(sources))}") for _ in range(n)]
    return rows + [(None, "en", "only null"), ("", "de", "a"), ("!!!", "de", None), (None, None, None)] + rows[:20]


@pytest.mark.parametrize(("block", "chunk", "segment"), [(32, 1024, 4), (2, 7, 2), (3, 5, 1), (1, 1, 3)])
def test_same_as_brute_force(spark, block, chunk, segment):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(m.divergences(df, block=block, chunk=chunk, segment=segment)) == brute(rows)


def test_other_limits_and_ties(spark):
    rows = [("same words here", "en", s) for s in "abcd"] + [("other", "en", "e")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(m.divergences(df, least_docs=1, ranks=2)) == brute(rows, 1, 2)


def test_every_case(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert m.divergences(df).count() == 0
    assert got(m.divergences(spark.createDataFrame([(None, None, None)], SCHEMA))) == []
    rows = corpus(120, 3)
    clash = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n", "2 AS term", "3 AS total", "'x' AS item", "4 AS value")
    assert got(m.divergences(clash, least_docs=5)) == brute(rows, 5)
    assert len([r for r in brute(rows, 10**6) if r[2] == "pair"]) == len(got(m.divergences(spark.createDataFrame(rows, SCHEMA), least_docs=10**6)))


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(m, "_PIECE", 50)
    r = random.Random(1)
    for _ in range(200):
        text = "".join(r.choice(["a", "B", "é", " ", ".", "漢" * 40, "z" * 120]) for _ in range(r.randint(0, 60)))
        assert [w.decode() for piece in m.words(text.encode()) for w in piece] == TERM.findall(text.translate(SMALL))


def test_shares_are_exact():
    r = random.Random(2)
    for _ in range(500):
        kept, every = r.randint(1, 10**6), r.randint(0, 10 ** r.randint(1, 15))
        n = [r.randint(0, every) for _ in range(5)]
        assert m.shares(np.array(n), every, kept).tolist() == [1 + 10**9 * (x + 5) // (every + 5 * kept) for x in n]


def test_against_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    want = sorted(con.execute(m.divergence_sql()).fetchall())
    assert got(m.divergences(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))) == want

import math
import random

import duckdb
import numpy as np
import pytest

from rankflow.llm import vector_codes as m

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, parts=16, entries=64, rounds=2, scale=256):
    """One number after another, for vectors of any length."""
    kept = [(i, list(v), label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = -(-max(len(v) for _, v, _ in kept) // parts) * parts
    w = width // parts
    whole = [[math.floor(scale * x) for x in v] + [0] * (width - len(v)) for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda r: (kept[r][0] is not None, kept[r][0] or 0, kept[r][1]))[:entries]
    books = [[whole[r][p * w : p * w + w] for r in first] for p in range(parts)]

    def assign():
        out = []
        for v in whole:
            row = []
            for p in range(parts):
                part = v[p * w : p * w + w]
                row.append(min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(books[p])))
            out.append(row)
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [v[p * w : p * w + w] for v, row in zip(whole, found, strict=True) if row[p][1] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = assign()
    errors = [sum(d for d, _ in row) for row in found]
    by_label = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    return sorted(((i, "".join(f"{k:02x}" for _, k in row), e, by_label[label]) for (i, _, label), row, e in zip(kept, found, errors, strict=True)), key=str)


def got(df):
    return sorted((tuple(r[:4]) for r in df.collect()), key=str)


@pytest.mark.parametrize("spread", [3, 40, 1 << 26])
def test_nearest_is_exact_and_takes_the_lower_index_of_ties(spread):
    r = np.random.default_rng(spread)
    for k in (1, 2, 7, 64):
        points, entries = r.integers(-spread, spread + 1, (3000, 4)), r.integers(-spread, spread + 1, (k, 4))
        entries[k // 2] = entries[0]  # a repeated entry is never taken twice
        found, distance = m.nearest(points, entries)
        every = ((points[:, None] - entries[None]) ** 2).sum(2)
        assert (found == every.argmin(1)).all() and (distance == every.min(1)).all()


def test_same_as_brute_force(spark):
    r = random.Random(5)
    rows = [(i, [r.choice([-1, 0, 1]) * r.random() for _ in range(32)], r.choice([None, 1, 2])) for i in range(150)]
    rows += [(200 + i, rows[i][1], 1) for i in range(20)]  # copies
    r.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(m.vector_codes(df, entries=16)) == brute(rows, entries=16)


def test_every_case(spark):
    r = random.Random(6)
    v = lambda n: [r.uniform(-2, 2) for _ in range(n)]
    rows = [(None, v(5), None), (None, v(5), 3), (1, None, 3), (2, [0.5, None], 3), (3, [float("nan"), 1.0], 3), (4, [float("inf")], 3), (5, [], 3), (6, v(3), None), (6, v(5), 9), (7, [-0.001], 3), (8, [0.0] * 5, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, parts=4, entries=3, rounds=3)
    assert got(m.vector_codes(df, parts=4, entries=3, rounds=3)) == want and len(want) == 7
    clash = df.selectExpr("*", "'x' AS code", "1 AS error", "2 AS part", "3 AS n")
    assert got(m.vector_codes(clash, parts=4, entries=3, rounds=3)) == want
    assert m.vector_codes(df.where("false")).count() == 0 and m.vector_codes(df.where("vec_id = 1")).count() == 0
    assert got(m.vector_codes(df.where("vec_id = 5"))) == [(5, "00" * 16, 0, 0)]
    # Beyond the bound, components count as the bound; no distance exceeds a long.
    far = spark.createDataFrame([(i, [1e300 * (-1) ** i, 3e38] * 32, None) for i in range(4)], SCHEMA)
    assert all(x.error >= 0 for x in m.vector_codes(far, entries=1).collect())
    assert m.vector_codes(far).agg({"error": "max"}).first()[0] == 0
    with pytest.raises(ValueError):
        m.vector_codes(df, entries=257)


def test_decoding_is_near(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(8, 16))
    rows = [(i, (base[i % 8] + r.normal(size=16) * 0.01).tolist(), None) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    books = m.learn(df, parts=4, entries=8)
    back = {x.vec_id: np.array(x.embedding) for x in m.decoded(m.encode(df, books), books).collect()}
    assert max(np.abs(back[i] - np.array(v)).max() for i, v, _ in rows) < 0.1


def test_against_sql(spark):
    embeddings = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet'")
    want = sorted(con.execute(m.vector_codes_sql()).fetchall())
    assert sorted(tuple(r) for r in m.vector_codes(embeddings).collect()) == want

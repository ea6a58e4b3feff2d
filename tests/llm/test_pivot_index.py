import numpy as np
import pytest
from pyspark.sql import functions as F

from rankflow.llm import pivot_index as m


def brute(rows, threshold=0.95):
    rows = sorted(set((i, None if v is None else tuple(v)) for i, v in rows), key=lambda x: x[0])
    units = [m._unit(None if v is None else list(v)) for _, v in rows]
    n = len(rows)
    near = [[j for j in range(n) if j != i and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold] for i in range(n)]
    root = [r[0] for r in rows]
    for _ in range(n):
        new = [min([root[i], *(root[j] for j in near[i])]) for i in range(n)]
        if new == root:
            break
        root = new
    return sorted((rows[i][0], len(near[i]), root[i], rows[i][0] == root[i]) for i in range(n))


def planted(n=1500, dim=64, seed=0, noise=0.035):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, dim))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    out = list(base)
    for size in (2, 3, 5, 40, 120):
        c = base[r.integers(n)]
        out += [c + r.normal(size=dim) * noise * r.random() for _ in range(size)]
    out += [base[7] * 3.0] * 4
    ids = r.permutation(len(out))
    return [(int(i), [float(np.float32(x)) for x in v]) for i, v in zip(ids, out, strict=True)]


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("block", [2048, 40, 7])
def test_recall_against_brute_force(spark, block):
    rows = planted()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).repartition(3)
    mine, want = got(m.near_vectors(df, block=block)), brute(rows)
    assert [x[0] for x in mine] == [x[0] for x in want]
    assert all(a[1] <= b[1] for a, b in zip(mine, want, strict=True))  # nothing below the threshold
    found, there = (sum(x[1] for x in xs) for xs in (mine, want))
    assert found >= 0.98 * there
    assert sum(a[2] == b[2] for a, b in zip(mine, want, strict=True)) >= 0.98 * len(want)


@pytest.mark.parametrize("noise", [0.025, 0.035])
def test_recall_with_a_third_in_one_group(spark, noise):
    """20,000 rows, a third of them around one vector at a fixed noise."""
    r = np.random.default_rng(1)
    n, dim = 20_000, 64
    x = r.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[: n // 3] = x[0] + r.normal(size=(n // 3, dim)) * noise
    x = x[r.permutation(n)].astype(np.float32).astype(np.float64)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)
    mine = np.array([k.n_links for k in m.near_vectors(df).orderBy("vec_id").select("n_links").collect()])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = np.concatenate([(x[i : i + 1000] @ x.T >= 0.95).sum(1) - 1 for i in range(0, n, 1000)])
    print("recall", noise, mine.sum() / want.sum(), "rows without any", ((mine == 0) & (want > 0)).sum())
    assert (mine <= want).all() and mine.sum() >= 0.98 * want.sum()
    assert ((mine == 0) & (want > 0)).sum() == 0


def test_ties_at_the_pivots(spark):
    """Vectors of two values only: many are equally near to many pivots, and most cosines are alike."""
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.choice([-1.0, 1.0], 12)]) for i in range(500)]
    rows += [(1000 + i, [x * 2 for x in rows[i][1]]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    mine, want = got(m.near_vectors(df, block=64)), brute(rows)
    assert mine == want


def test_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    assert got(m.near_vectors(df)) == brute([(r.vec_id, r.embedding) for r in df.collect()])


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (10, [1.0, 0.0, 0.0]), (11, [1e-30, 1e-32]), (12, [1.0, 0.0]), (None, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit("x"))
    out = {r.vec_id: tuple(r)[1:] for r in m.near_vectors(df).collect()}
    assert len(out) == 13 and m.near_vectors(df).count() == 14  # a repeated row gives a row
    for i in (1, 2, 11, 12):
        assert out[i] == (3, 1, i == 1)
    for i in (3, 4, 5, 6, 7, 8, 9, 10):
        assert out[i] == (0, i, True)
    assert out[None] == (0, None, True)
    assert m.near_vectors(df.where(F.lit(False))).count() == 0

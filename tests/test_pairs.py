"""Tiled pairs and exact order statistics, against listing and sorting."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankflow.ltr import boost, findstep, medians, metrics, pairwise


def listed(rows, cut=None):
    """Sums by row over the listed pairs: rows of (id, query, label, score)."""
    sums = {r[0]: [0.0, 0.0] for r in rows}
    by_query = {}
    for r in rows:
        by_query.setdefault(r[1], []).append(r)
    for own in by_query.values():
        order = {r[0]: k for k, r in enumerate(sorted(own, key=lambda r: (-r[3], r[2], r[0])))}
        weight = lambda r: 1 / math.log(order[r[0]] + 2) if order[r[0]] < (cut or 0) else 0.0  # noqa: E731, B023
        for a in own:
            for b in own:
                if a[2] > b[2]:
                    p = 1 / (1 + math.exp(2 * (a[3] - b[3])))
                    size = 1.0 if cut is None else abs((a[2] - b[2]) * (weight(a) - weight(b)))
                    for r, s in ((a, 1), (b, -1)):
                        sums[r[0]][0] += s * 2 * p * size
                        sums[r[0]][1] += 4 * p * (1 - p) * size
    return sums


def queries(seed, sizes=(1, 2, 3, 17, 60)):
    r = random.Random(seed)
    rows = []
    for q, n in enumerate(sizes):
        rows += [(len(rows) + i, q, float(r.choice([0, 0, 0, 1, 2])), round(r.uniform(-2, 2), 1)) for i in range(n)]
    rows += [(len(rows) + i, 99, 1.0, 0.5) for i in range(8)]  # one label: no pairs
    return rows


@pytest.mark.parametrize("tile", [1, 7, 16, 1024])
def test_gradients_are_those_of_all_pairs(spark, tile):
    rows = queries(tile)
    df = spark.createDataFrame(rows, "_id long, q int, _y double, _f double").repartition(3)
    got = {r[0]: (r[1], r[2]) for r in pairwise.gradients(pairwise.placed(df, "q", [("_y", True), ("_id", False)]), "q", tile).collect()}
    for i, want in listed(rows).items():
        assert got.get(i, (0.0, 0.0)) == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize(("tile", "cut"), [(4, 3), (4, 9), (1024, 5), (8, 100)])
def test_only_pairs_that_touch_the_cut(spark, tile, cut):
    rows = queries(cut)
    df = spark.createDataFrame(rows, "_id long, q int, _y double, _f double").repartition(3)
    ranked = pairwise.placed(df, "q", [("_f", True), ("_y", False), ("_id", False)])
    ranked = ranked.withColumn("_g", F.col("_y")).withColumn("_d", F.when(F.col("_place") < cut, 1 / F.log(F.col("_place") + 2)).otherwise(0.0)).withColumn("_best", F.lit(1.0))
    got = {r[0]: (r[1], r[2]) for r in pairwise.gradients(ranked, "q", tile, cut).collect()}
    for i, want in listed(rows, cut).items():
        assert got.get(i, (0.0, 0.0)) == pytest.approx(want, abs=1e-9)
    sent = pairwise.tiles(ranked, "q", "_y", tile, cut)
    assert sent.where(F.col("_left") * tile >= cut).count() == 0


def test_places_without_a_window(spark, monkeypatch):
    rows = queries(3)
    df = spark.createDataFrame(rows, "_id long, q int, _y double, _f double").repartition(5)
    order = [("_f", True), ("_y", False), ("_id", False)]
    by_window = {r._id: r._place for r in pairwise.placed(df, "q", order).collect()}
    monkeypatch.setattr(pairwise, "ONE_TASK", 5)
    ranged = pairwise.placed(df, "q", order)
    assert {r._id: r._place for r in ranged.collect()} == by_window and set(ranged.columns) == {*df.columns, "_place"}


def test_one_query_of_many_rows(spark):
    """A query of 20,000 rows: 200 million pairs, of which no task lists any."""
    n = 20_000
    r = np.random.default_rng(1)
    y, f = (r.random(n) < 0.02).astype(float), np.round(r.normal(size=n), 3)
    df = spark.createDataFrame(list(zip(range(n), [1] * n, y.tolist(), f.tolist(), strict=True)), "_id long, q int, _y double, _f double")
    got = pairwise.gradients(pairwise.placed(df, "q", [("_y", True), ("_id", False)]), "q").toPandas().set_index("_id")
    high, low = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    p = 1 / (1 + np.exp(2 * (f[high][:, None] - f[low][None, :])))
    assert np.allclose(got.r[high], 2 * p.sum(1)) and np.allclose(got.r[low], -2 * p.sum(0)) and np.allclose(got.w[low], (4 * p * (1 - p)).sum(0))
    cost = np.log1p(np.exp(-2 * (f[high][:, None] - f[low][None, :]))).mean()
    assert metrics.cross_entropy(df, "q", "_y", "_f").first().entropy == pytest.approx(cost)


def test_cross_entropy_is_that_of_the_listed_pairs(spark):
    rows = queries(8)
    df = spark.createDataFrame(rows, "_id long, q int, y double, s double")
    want = {r.q: r.e for r in metrics.pairs(df, "q", "y", "s").groupBy("q").agg(F.avg(metrics.pair_cost(F.col("hi"), F.col("lo"))).alias("e")).collect()}
    got = {r.q: r.entropy for r in metrics.cross_entropy(df, "q", "y", "s").collect()}
    assert got.keys() == want.keys() and all(got[q] == pytest.approx(want[q]) for q in want)


def test_order_statistics_equal_sorting(spark):
    r = random.Random(9)
    groups = {
        "spread": [r.gauss(0, 1) for _ in range(999)],
        "even": [r.uniform(-1e-3, 1e5) for _ in range(1000)],
        "one": [4.25],
        "two": [-3.0, 8.0],
        "hot": [1.5] * 700 + [r.random() for _ in range(300)],
        "zero": [0.0, -0.0, 0.0, 1e-320, -1e-320],
        "wide": [s * 10.0**e for e in range(-300, 301, 7) for s in (-1, 1)],
        "near": [1.0 + k * 2**-52 for k in range(101)],
        "huge": [1.7e308, -1.7e308, 1.6e308, float("inf"), float("-inf")],
        None: [2.0, 1.0, 7.0],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("spread", None), ("spread", float("nan")), ("none", None)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = medians.order_statistics(df, F.col("g"), F.col("v"), lambda n: [0, n // 3, n // 2, n - 1])
    for g, vs in groups.items():
        s = sorted(vs)
        assert got[g] == [s[0], s[len(s) // 3], s[len(s) // 2], s[-1]], g
    assert "none" not in got
    assert medians.medians(df, F.col("g"), F.col("v"))["even"] == np.median(groups["even"])
    assert medians.upper_middles(df, F.col("g"), F.col("v"))["two"] == 8.0


@pytest.mark.parametrize("step", ["line", "median", "average"])
def test_steps_of_pair_leaves(spark, step):
    rows = queries(4, (20, 20, 20))
    df = spark.createDataFrame([(q, y, float(i % 7), float(y * 2 + i % 3)) for i, q, y, _ in rows], "q int, y double, a double, b double")
    s = boost.Settings(loss="ranknet", trees=1, leaves=2, least=2, step=step, bins=0)
    model = boost.train(df, ["a", "b"], "y", s, group="q")
    tree = model.trees[0][0]
    numbered = df.withColumn("_id", F.monotonically_increasing_id()).select("_id", "q", F.col("y").alias("_y"), F.lit(0.0).alias("_f"), "a", "b")
    sums = pairwise.gradients(pairwise.placed(numbered, "q", [("_y", True), ("_id", False)]), "q")
    own = numbered.join(sums, "_id", "left").fillna(0.0).select(tree.leaf().alias("leaf"), "r", "w").toPandas()
    for leaf, x in own.groupby("leaf"):
        v = sorted(x.r)
        k = len(v) // 2
        want = {"line": x.r.sum() / x.w.sum(), "average": x.r.mean(), "median": (v[k] + v[min(k + 1, len(v) - 1)]) / 2}[step]
        assert tree.nodes[leaf].value == pytest.approx(want * s.rate / 2)
    with pytest.raises(ValueError):
        boost.train(df, ["a"], "y", boost.Settings(loss="ranknet", step="no"), group="q")


def test_steps_of_all_leaves_against_a_grid(spark):
    r = random.Random(11)
    rows = [(q, float(r.choice([0, 0, 1, 2, 3])), round(r.gauss(0, 1), 3), r.randrange(4), round(r.gauss(0, 1), 3)) for q in range(25) for _ in range(r.randint(1, 9))]
    df = spark.createDataFrame(rows, "q int, y double, s double, leaf int, step double").repartition(3)
    got = {x.leaf: x for x in findstep.best_steps(df, "q", "y", "s", "leaf", "step", 0.0, 3.0, 4).collect()}
    queries = {}
    for x in rows:
        queries.setdefault(x[0], []).append(x)
    mixed = [v for v in queries.values() if len({x[1] for x in v}) > 1]

    def mean(leaf, w):
        total = 0.0
        for own in mixed:
            gain = lambda y: [0.0, 3.0, 7.0, 15.0, 31.0][int(y)]
            order = sorted(own, key=lambda x: (-(x[2] + (w * x[4] if x[3] == leaf else 0.0)), x[1]))[:4]
            best = sum(gain(y) / math.log(2 + k) for k, y in enumerate(sorted((x[1] for x in own), reverse=True)[:4]))
            total += sum(gain(x[1]) / math.log(2 + k) for k, x in enumerate(order)) / best
        return total / len(mixed)

    assert set(got) == set(range(4))
    for leaf, x in got.items():
        grid = max(mean(leaf, k * 3 / 600) for k in range(601))
        assert mean(leaf, x.weight) >= grid - 1e-9 and x.gain == pytest.approx(mean(leaf, x.weight) - mean(leaf, 0.0), abs=1e-9)


def test_searched_leaves_do_not_lose(spark):
    rows = queries(6, (20,) * 8)
    df = spark.createDataFrame([(q, y, float(i % 7), float(y * 2 + i % 3)) for i, q, y, _ in rows], "q int, y double, a double, b double")
    ndcg = {}
    for step in ("line", "search"):
        model = boost.train(df, ["a", "b"], "y", boost.Settings(loss="lambda", trees=2, leaves=3, least=2, step=step, bins=0, cut=5), group="q")
        ndcg[step] = metrics.ndcg(model.predict(df), "q", "y", "score", 5).agg(F.avg("ndcg")).first()[0]
    assert ndcg["search"] >= 0.8 and ndcg["search"] >= ndcg["line"] - 0.05


def test_queries_of_one_tile_take_one_shuffle(spark, monkeypatch):
    monkeypatch.setattr(pairwise, "TASK_ROWS", 10)
    rows = queries(5)
    df = spark.createDataFrame(rows, "_id long, q int, _y double, _f double").repartition(3)
    own = pairwise.dealt(df, "q")
    assert own.rdd.getNumPartitions() == -(-len(rows) // 10)
    sums = pairwise.gradients(pairwise.placed(own, "q", [("_y", True), ("_id", False)], 60), "q", largest=60)
    assert {"_id", "r", "w"} == set(sums.columns) and sums._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {r[0]: (r[1], r[2]) for r in sums.collect()}
    for i, want in listed(rows).items():
        assert got.get(i, (0.0, 0.0)) == pytest.approx(want, abs=1e-9)
    for made in (metrics.pair_error(df, "q", "_y", "_f"), metrics.ndcgs(df, "q", "_y", "_f", 3, ("pessimistic", "mean", "optimistic"))):
        assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1

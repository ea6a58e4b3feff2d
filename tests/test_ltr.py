import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankflow.ltr import boost, data, findstep, metrics, model_io, quantize, transforms
from rankflow.streaming import windows


@pytest.fixture(scope="module")
def ranked(spark):
    r = random.Random(1)
    rows = [(q, r.randint(0, 4), float(r.randint(0, 5)), i) for q in range(30) for i in range(r.randint(1, 9))]
    rows += [(100, 0, 1.0, 0), (100, 0, 2.0, 1), (101, 2, 1.0, 0), (101, 2, 1.0, 1)]
    return spark.createDataFrame(rows, "q int, label int, score double, tie int")


def test_ndcg_bounds(ranked):
    by = {t: {r.q: r.dcg for r in metrics.dcg(ranked, "q", "label", "score", 3, t).collect()} for t in ("optimistic", "pessimistic", "mean")}
    best = {r.q: r.dcg for r in metrics.extreme_dcg(ranked, "q", "label", 3).collect()}
    worst = {r.q: r.dcg for r in metrics.extreme_dcg(ranked, "q", "label", 3, best=False).collect()}
    for q in best:
        assert worst[q] - 1e-9 <= by["pessimistic"][q] <= by["optimistic"][q] + 1e-9 <= best[q] + 2e-9
        assert by["pessimistic"][q] - 1e-9 <= by["mean"][q] <= by["optimistic"][q] + 1e-9
    got = {r.q for r in metrics.ndcg(ranked, "q", "label", "score", 3).collect()}
    assert not got & {100, 101}
    filled = {r.q: r.ndcg for r in metrics.ndcg(ranked, "q", "label", "score", 3, empty=1.0).collect()}
    assert filled[100] == filled[101] == 1.0


def test_pair_errors_match_pairs(ranked):
    pairs = metrics.pairs(ranked, "q", "label", "score").groupBy("q").agg(F.count(F.lit(1)).alias("pairs"), F.sum((F.col("lo") >= F.col("hi")).cast("long")).alias("errors"))
    want = sorted(tuple(r) for r in pairs.collect())
    assert sorted(tuple(r)[:3] for r in metrics.pair_error(ranked, "q", "label", "score").collect()) == want


def test_pair_cost(spark):
    got = spark.range(1).select(metrics.pair_cost(F.lit(1.0), F.lit(0.5)), metrics.pair_cost(F.lit(-900.0), F.lit(900.0))).first()
    assert got[0] == pytest.approx(-math.log(1 / (1 + math.exp(-1.0)))) and got[1] == pytest.approx(3600)


def test_labels_groups_alignment(spark):
    names = ["Perfect", "EXCELLENT", "bad", "", None, "Relevant", "HighlyRelevant", "2.5", "what"]
    df = spark.createDataFrame([(n,) for n in names], "t string")
    assert [r.x for r in df.select(data.label_of(F.col("t")).alias("x")).collect()] == [4, 3, 0, -1, -1, 1, 2, 2.5, 0]
    a = spark.createDataFrame([(1, 2.0)], "A int, f double")
    b = spark.createDataFrame([(5.0, 7)], "F double, extra int")
    assert sorted(tuple(r) for r in data.aligned(a, b).collect()) == [(0, 5.0), (1, 2.0)]


def test_gap_bins_and_codes(spark):
    assert quantize.gap_bins(np.array([0.0, 1e-9, 1.0, 2.0])) == [0.0, 1.0, 2.0]
    few = quantize.gap_bins(np.arange(1000) / 1000, most=10)
    assert len(few) <= 10
    starts = [0.0, 1.0, 2.5]
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 0.9, 1.0, 2.4, 9.0)], "v double")
    assert [r.c for r in df.select(quantize.encode(F.col("v"), starts).alias("c")).collect()] == [quantize.code_of(starts, x) for x in (-1.0, 0.0, 0.9, 1.0, 2.4, 9.0)]
    assert [quantize.decode(starts, k) for k in range(3)] == [0.5, 1.75, 2.5]
    rules = quantize.equal_or_less_bins([(0.0, 50), (1.0, 10), (2.0, 10), (3.0, 20)], 5)
    assert rules[0] == ("eq", 0.0) and rules[-1][0] == "gt"
    got = [r.c for r in df.select(quantize.rule_code(F.col("v"), rules).alias("c")).collect()]
    assert got[1] == 0 and None not in got


def plain_gaps(values, most, gap=1e-8):
    while True:
        starts = []
        for v in values:
            if not starts or v - starts[-1] >= gap:
                starts.append(v)
        if len(starts) <= most:
            return starts
        gap *= 2


def test_gap_bins_in_one_pass(spark):
    r = np.random.default_rng(0)
    for values, most in ((np.sort(r.random(3000)), 100), (np.sort(r.lognormal(0, 4, 2000)), 40), (np.arange(50.0), 50), (np.arange(50.0), 7), (np.array([-1e300, 0.0, 1e300]), 1), (np.array([3.0]), 5)):
        want = plain_gaps(values.tolist(), most)
        assert quantize.gap_bins(values, most) == want
        bins = quantize.GapBins(most)
        for part in np.array_split(values, 9):
            bins.add(part)
        assert bins.starts() == want
    rows = [(f, float(v)) for f in ("a", "b", "c") for v in r.random(500)] + [("d", 1.0), ("e", None)]
    got = {x.feature: x.starts for x in quantize.codebook(spark.createDataFrame(rows * 2, "feature string, value double"), 37).collect()}
    assert got == {f: plain_gaps(sorted({v for g, v in rows if g == f}), 37) for f in "abcd"}


def test_codes_of_many_bins(spark):
    starts = sorted(set(np.random.default_rng(1).normal(size=5000).tolist()))
    values = [-99.0, 99.0, starts[0], starts[-1], *starts[::171], *np.random.default_rng(2).normal(size=300).tolist()]
    df = spark.createDataFrame([(x,) for x in values] + [(None,)], "v double")
    got = [x.c for x in df.coalesce(1).select(quantize.encode(F.col("v"), starts).alias("c")).collect()]
    assert got == [quantize.code_of(starts, x) for x in values] + [None]


def test_own_loss_gap_bins_trim_and_classes(spark):
    df = friedman(spark, 300)
    boost.register_loss("half_l2", boost.Loss(lambda y, f: (y - f) / 2, lambda y, f: F.lit(0.5), lambda n, r, w: r / max(w, 1e-9)))
    model = boost.train(df, ["a", "b", "c"], "y", boost.Settings(loss="half_l2", trees=3, leaves=4, rate=1.0, bins=0), valid=df)
    assert model.history[-1]["rmse"] < 0.6
    model = boost.train(df, ["a", "b", "c"], "cls", boost.Settings(loss="logistic", classes=3, trees=3, leaves=4, rate=0.5, trim=0.1, trim_from=1), valid=df)
    assert model.history[-1]["error"] < 0.3
    back = model_io.from_ini(model_io.to_ini(model))
    assert [len(t) for t in back.trees] == [3, 3, 3]
    want, got = ([tuple(r) for r in x.predict(df).select("score", "score_1", "score_2").orderBy("id").collect()] for x in (model, back))
    assert want == got
    table = model_io.from_table(model_io.to_table(model, spark))
    assert table.base == model.base and len(table.trees) == 3
    pair = boost.train(df, ["a", "b", "c"], "cls", boost.Settings(loss="lambda", trees=2, leaves=4, label_share=0.3), group="q", valid=df)
    assert pair.history[-1]["ndcg"] > 0.8


def test_a_tree_is_grown_best_first(spark):
    """Against a plain best-first search over the same bins."""
    df = friedman(spark, 150)
    model = boost.train(df, ["a", "b", "c"], "y", boost.Settings(trees=1, leaves=5, rate=1.0, bins=0))
    pdf = df.toPandas()
    tree = model.trees[0][0]
    books = boost._books(df, ["a", "b", "c"], 0)
    y = pdf.y.to_numpy() - model.base
    codes = {f: np.array([quantize.code_of(books[f], x) for x in pdf[f]]) for f in "abc"}

    def best(on):
        top = (1e-12, None, None)
        for f in "abc":
            code = codes[f]
            for c in range(len(books[f]) - 1):
                left = on & (code <= c)
                right = on & ~left
                if min(left.sum(), right.sum()) >= 15 and (g := y[left].sum() ** 2 / left.sum() + y[right].sum() ** 2 / right.sum() - y[on].sum() ** 2 / on.sum()) > top[0] + 1e-9:
                    top = (g, f, c)
        return top

    leaves, order = {0: np.ones(len(pdf), bool)}, []
    while len(leaves) < 5:
        at = max(leaves, key=lambda i: best(leaves[i])[0])
        _, f, c = best(leaves[at])
        on = leaves.pop(at)
        left = codes[f] <= c
        k = 2 * len(order) + 1
        order.append((at, f, k, k + 1))
        leaves[k], leaves[k + 1] = on & left, on & ~left
    assert [(i, n.feature, n.left, n.right) for i, n in enumerate(tree.nodes) if n.feature] == sorted(order)
    for i, on in leaves.items():
        assert tree.nodes[i].value == pytest.approx(y[on].mean())


def friedman(spark, n=600):
    r = np.random.default_rng(0)
    x = r.random((n, 3))
    y = 3 * (x[:, 0] > 0.5) + 2 * x[:, 1] + 0.1 * r.normal(size=n)
    return spark.createDataFrame([(*map(float, row), float(t), i, i % 20, int(t > 2.5), min(2, int(t / 2))) for i, (row, t) in enumerate(zip(x, y, strict=True))], "a double, b double, c double, y double, id int, q int, bin int, cls int")


def test_first_tree_matches_brute_force(spark):
    df = friedman(spark, 200)
    model = boost.train(df, ["a", "b", "c"], "y", boost.Settings(trees=1, leaves=2, rate=1.0, bins=200))
    root = model.trees[0][0].nodes[0]
    pdf = df.toPandas()
    best = max(((pdf.y[pdf[f] <= t].sum() ** 2 / (pdf[f] <= t).sum() + pdf.y[pdf[f] > t].sum() ** 2 / (pdf[f] > t).sum(), f, t) for f in "abc" for t in pdf[f] if 15 <= (pdf[f] <= t).sum() <= len(pdf) - 15), key=lambda x: x[0])
    assert root.feature == best[1] and abs(root.threshold - best[2]) < 0.05
    left = pdf[pdf[root.feature] <= root.threshold]
    assert model.base + model.trees[0][0].nodes[root.left].value == pytest.approx(left.y.mean(), abs=1e-6)


@pytest.mark.parametrize(("loss", "label", "extra"), [("l2", "y", {}), ("l1", "y", {}), ("logistic", "bin", {}), ("logistic", "cls", {"classes": 3}), ("ranknet", "cls", {}), ("lambda", "cls", {}), ("lambda_raw", "cls", {})])
def test_losses_improve(spark, loss, label, extra):
    df = friedman(spark, 300)
    model = boost.train(df, ["a", "b", "c"], label, boost.Settings(loss=loss, trees=4, leaves=4, rate=0.5, **extra), group="q", valid=df)
    key = next(k for k in model.history[0] if k != "iteration")
    first, last = model.history[0][key], model.history[-1][key]
    assert last >= first if key == "ndcg" else last <= first
    assert max(model.importance(), key=model.importance().get) in ("a", "b") and model.importance()["c"] < 0.7


def test_model_files(spark):
    df = friedman(spark, 200)
    model = boost.train(df, ["a", "b", "c"], "y", boost.Settings(trees=2, leaves=4))
    want = [r.score for r in model.predict(df).orderBy("id").collect()]
    for back in (model_io.from_table(model_io.to_table(model, spark)), model_io.from_ini(model_io.to_ini(model))):
        assert [r.score for r in back.predict(df).orderBy("id").collect()] == pytest.approx(want)
    assert model_io.to_xml(model).count("<tree ") == 2
    lacking = model.predict(df.drop("a")).first()
    assert lacking.score is not None


def test_step_search_matches_grid(spark):
    r = random.Random(5)
    sizes = (12, 12, 7, 150, 12, 3)
    rows = [(q, (y := r.choices(range(5), (0.3704, 0.2855, 0.2714, 0.0523, 0.0204))[0]), y + r.random() * 10, y + r.random() * 20) for q in range(6) for _ in range(sizes[q])]
    df = spark.createDataFrame(rows, "q int, label int, score double, step double")
    best = findstep.best_step(df, "q", "label", "score", "step", 0.0, 3.0, 5).first()
    groups = {}
    for q, y, a, b in rows:
        groups.setdefault(q, []).append((y, a, b))
    groups = {q: np.array(v) for q, v in groups.items() if len({x[0] for x in v}) > 1}

    def one(v, w):
        gains = np.array(metrics.GAINS)[v[:, 0].astype(int)]
        order = sorted(range(len(v)), key=lambda i: (-(v[i, 1] + w * v[i, 2]), v[i, 0]))[:5]
        parts = lambda g: sum(x / np.log(2 + i) for i, x in enumerate(g))
        return parts(gains[order]) / parts(sorted(gains, reverse=True)[:5]) if gains.max() > 0 else 0.0

    mean = lambda w: np.mean([one(v, w) for v in groups.values()])
    grid = max(mean(w) for w in np.linspace(0, 3, 3001))
    assert best.ndcg >= grid - 1e-9 and mean(best.weight) == pytest.approx(best.ndcg)


def test_large_queries_give_the_same_events():
    r = np.random.default_rng(2)
    for n, cut in ((200, 5), (300, 1), (90, 90), (70, 200)):
        y, a, b = r.integers(0, 5, n).astype(float), r.normal(size=n).round(2), r.normal(size=n).round(2)
        w, c = findstep._large_events(y, a, b, 0.0, 3.0, cut)
        w2, c2 = findstep._batch_events(y[None], a[None], b[None], 0.0, 3.0, cut)
        grid = np.linspace(0.0005, 2.9995, 700)
        one, two = ((np.where(x[None, :] < grid[:, None], z, 0)).sum(1) for x, z in ((w, c), (w2, c2)))
        assert np.allclose(one, two)


def test_networks(spark):
    x = [F.lit(1.0), F.lit(2.0)]
    out = transforms.network(x, [([[1.0, -1.0], [0.5, 0.5]], [0.0, 1.0], "tanh"), ([[2.0, 1.0]], [0.1], "linear")])
    assert spark.range(1).select(out[0]).first()[0] == pytest.approx(2 * math.tanh(-1) + math.tanh(2.5) + 0.1)
    assert spark.range(1).select(transforms.softmax_mean([F.lit(0.0), F.lit(0.0)], [1.0, 3.0])).first()[0] == pytest.approx(2.0)


def test_streams(spark, tmp_path):
    src = spark.createDataFrame([("a", "2024-01-01 00:10:00", 1), ("a", "2024-01-01 00:40:00", 2), ("b", "2024-01-01 01:10:00", 3)], "k string, ts string, n int").withColumn("ts", F.col("ts").cast("timestamp"))
    src.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in")
    out = windows.windowed(stream, "ts", ["k"], "1 hour", value="n")
    q = out.writeStream.outputMode("update").format("memory").queryName("w").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    want = sorted((r.k, r.n, r.total) for r in windows.windowed(src, "ts", ["k"], "1 hour", value="n").collect())
    assert sorted((r.k, r.n, r.total) for r in spark.sql("select * from w").collect()) == want == [("a", 2, 3), ("b", 1, 3)]
    q = windows.running_counts(stream, "k", "n").writeStream.outputMode("update").format("memory").queryName("rc").option("checkpointLocation", f"{tmp_path}/c2").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.sql("select * from rc").collect()) == [("a", 3), ("b", 3)]
    assert [tuple(r)[0::3] for r in windows.sessions(src, "ts", "k", "45 minutes").orderBy("k").collect()] == [("a", 2), ("b", 1)]


def test_own_learner_and_measure(spark):
    df = friedman(spark, 120)
    seen = []

    def stump(coded, features, books, s, response, weight, label, score, allowed=None):
        seen.append(score)
        left, right = (coded.where(c).agg(F.avg(response)).first()[0] for c in ("a <= 0.5", "a > 0.5"))
        return boost.Tree([boost.Node("a", 0.5, 1, 2), boost.Node(value=left), boost.Node(value=right)])

    model = boost.train(df, ["a"], "y", boost.Settings(trees=2), valid=df, learner=stump, measure=lambda x: {"worst": x.agg(F.max(F.abs(F.col("y") - F.col("score")))).first()[0]})
    assert seen == ["_f0", "_f0"] and [set(h) for h in model.history] == [{"iteration", "worst"}] * 2


def test_boost_samples(spark):
    df = spark.range(600).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"), (F.col("id") % 7 * 2.0).alias("y"), (F.col("id") % 50).alias("q"))
    s = boost.Settings(trees=6, leaves=4, rate=0.5, row_share=0.6, feature_share=0.5, seed=3)
    first, again = (boost.train(df, ["a", "b"], "y", s, group="q", valid=df) for _ in range(2))
    assert first.history == again.history
    assert first.history[-1]["rmse"] < first.history[0]["rmse"] < 4.1
    used = [{n.feature for n in t[0].nodes if n.feature} for t in first.trees]
    assert all(len(u) <= 1 for u in used) and set().union(*used) >= {"a"}


def test_scores_and_history_files(spark, tmp_path):
    from rankflow.sources import writers

    df = spark.createDataFrame([("q1", 3, 0.5)], "q string, y int, s double")
    writers.write_scores(df, f"{tmp_path}/scores", "q", "y", "s")
    got = spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/scores")
    assert got.columns == ["m:QueryId", "m:Rating", "Score"] and tuple(got.first()) == ("q1", "3", "0.5")
    writers.write_history(spark, [{"iteration": 1, "rmse": 2.0}, {"iteration": 2, "rmse": 1.5, "ndcg": 0.5}], f"{tmp_path}/history")
    got = spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/history")
    assert [tuple(r) for r in got.collect()] == [("1", None, "2.0"), ("2", "0.5", "1.5")]

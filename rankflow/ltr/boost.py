"""Gradient-boosted regression trees: histograms by Spark, trees on the driver, scores as expressions.

A tree grows best first. One pass over the rows counts the children of all leaves that may be split next, only the smaller
child of each: the other is what is left of its parent. So a tree takes as many passes as it has levels, not splits. Rows
never leave the executors; the driver holds nodes, codebooks and histograms of (leaf, feature, bin). Scores are columns that
are written to the shared folder every few trees, so plans stay short.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankflow.ltr import findstep, medians, pairwise
from rankflow.ltr import metrics as M
from rankflow.ltr.quantize import codebook, decode, encode, gap_bins
from rankflow.storage import drop, stored


@dataclass
class Node:
    feature: str | None = None
    threshold: float = 0.0
    left: int = -1
    right: int = -1
    value: float = 0.0
    gain: float = 0.0


@dataclass
class Tree:
    nodes: list[Node] = field(default_factory=lambda: [Node()])

    def column(self, available: list[str] | None = None) -> Column:
        """The tree as one expression; a feature that is not there is 0. `<=` goes left."""

        def walk(i: int) -> Column:
            n = self.nodes[i]
            if n.feature is None:
                return F.lit(float(n.value))
            value = F.coalesce(F.col(f"`{n.feature}`").cast("double"), F.lit(0.0)) if available is None or n.feature in available else F.lit(0.0)
            return F.when(value <= n.threshold, walk(n.left)).otherwise(walk(n.right))

        return walk(0)

    def leaf(self) -> Column:
        """The number of the leaf that a row falls into."""

        def walk(i: int) -> Column:
            n = self.nodes[i]
            return F.lit(i) if n.feature is None else F.when(F.coalesce(F.col(f"`{n.feature}`").cast("double"), F.lit(0.0)) <= n.threshold, walk(n.left)).otherwise(walk(n.right))

        return walk(0)


@dataclass
class Ensemble:
    trees: list[list[Tree]] = field(default_factory=list)  # by iteration, then class
    features: list[str] = field(default_factory=list)
    base: float = 0.0
    history: list[dict[str, float]] = field(default_factory=list)

    def score(self, columns: list[str] | None = None, upto: int | None = None, k: int = 0) -> Column:
        out = F.lit(self.base)
        for trees in self.trees[:upto]:
            out = out + trees[k].column(columns)
        return out

    def predict(self, df: DataFrame, upto: int | None = None, out: str = "score") -> DataFrame:
        """Scores, by parts of 25 trees so that expressions stay small."""
        upto = len(self.trees) if upto is None else upto
        columns = df.columns
        for k in range(max([1, *map(len, self.trees)])):
            name = out if k == 0 else f"{out}_{k}"
            df = df.withColumn(name, F.lit(self.base))
            for lo in range(0, upto, 25):
                part = F.lit(0.0)
                for trees in self.trees[lo : min(lo + 25, upto)]:
                    part = part + trees[k].column(columns)
                df = df.withColumn(name, F.col(name) + part)
        return df

    def importance(self) -> dict[str, float]:
        """Square roots of the mean gains, the largest put to 1."""
        sums: dict[str, float] = dict.fromkeys(self.features, 0.0)
        for trees in self.trees:
            for t in trees:
                for n in t.nodes:
                    if n.feature is not None:
                        sums[n.feature] += n.gain
        n = max(1, len(self.trees))
        roots = {f: math.sqrt(max(0.0, s / n)) for f, s in sums.items()}
        top = max([*roots.values(), 0.0]) or 1.0
        return {f: r / top for f, r in sorted(roots.items(), key=lambda x: -x[1])}


#: lambda weighs pairs by the change of NDCG, lambda_raw by that of a DCG whose gains are the labels.
PAIR_LOSSES = ("ranknet", "lambda", "lambda_raw")
LOSSES = ("l2", "l1", "logistic", *PAIR_LOSSES)


@dataclass(frozen=True)
class Loss:
    """A loss of the user's own: what trees fit and the curvature, from (label, score), and a leaf's value from sums."""

    response: Callable[[Column, Column], Column]
    weight: Callable[[Column, Column], Column]
    leaf: Callable[[float, float, float], float]  # (rows, sum of responses, sum of weights) -> value before the rate


_OWN: dict[str, Loss] = {}


def register_loss(name: str, loss: Loss) -> None:
    if name in LOSSES:
        raise ValueError(f"{name} is built in")
    _OWN[name] = loss


@dataclass
class Settings:
    loss: str = "l2"  # one of LOSSES, or registered
    trees: int = 10
    leaves: int = 8
    rate: float = 0.2
    least: int = 15
    bins: int = 64  # of each feature, by quantiles; 0: gap bins over all distinct values, 65,535 at most
    classes: int = 2
    clamp: float = 5.0
    cut: int = 10
    refresh: int = 4
    step: str = "line"  # a leaf's value for pair losses: one Newton step, the median or average of responses, or ("search") as far along its Newton step, up to twice, as NDCG at the cut gains most
    row_share: float = 1.0  # of the rows, for each tree; of the queries where there is a group
    feature_share: float = 1.0  # of the features, for each tree
    seed: int = 0
    label_share: float = 0.0  # of the label's own residual in what pair losses fit
    trim: float = 0.0  # share of the sum of weights whose lightest rows are left out, for logistic losses
    trim_from: int = 30  # iterations before any are


def _responses(df: DataFrame, s: Settings, label: str, group: str | None, largest: int | None = None) -> DataFrame:
    """Columns _r0.. (what trees fit) and _w0.. (curvatures), from _f0.. ."""
    y, f = F.col(label).cast("double"), F.col("_f0")
    if s.loss in _OWN:
        own = _OWN[s.loss]
        return df.withColumn("_r0", own.response(y, f)).withColumn("_w0", own.weight(y, f))
    if s.loss == "l2":
        return df.withColumn("_r0", y - f).withColumn("_w0", F.lit(1.0))
    if s.loss == "l1":
        return df.withColumn("_r0", F.signum(y - f)).withColumn("_w0", F.lit(1.0))
    if s.loss == "logistic":
        if s.classes == 2:
            p = 1 / (1 + F.exp(-f))
            return df.withColumn("_r0", F.when(y > 0, 1.0).otherwise(0.0) - p).withColumn("_w0", p * (1 - p))
        top = F.greatest(*[F.col(f"_f{k}") for k in range(s.classes)])
        whole = sum((F.exp(F.col(f"_f{k}") - top) for k in range(s.classes)), F.lit(0.0))
        for k in range(s.classes):
            p = F.exp(F.col(f"_f{k}") - top) / whole
            df = df.withColumn(f"_r{k}", F.when(y == k, 1.0).otherwise(0.0) - p).withColumn(f"_w{k}", p * (1 - p))
        return df
    # Pairs of a query, tile by tile: gradients are summed up per row before they come back.
    slim = df.select(group, "_id", y.alias("_y"), f.alias("_f"))
    if s.loss == "ranknet":
        sums = pairwise.gradients(pairwise.placed(slim, group, [("_y", True), ("_id", False)], largest), group)
    else:
        ranked = pairwise.placed(slim, group, [("_f", True), ("_y", False), ("_id", False)], largest)
        gains = M.gain(F.col("_y")) if s.loss == "lambda" else F.col("_y")
        ranked = ranked.withColumn("_g", gains.cast("double")).withColumn("_d", F.when(F.col("_place") < s.cut, M.discount(F.col("_place"))).otherwise(0.0))
        if s.loss == "lambda":
            ranked = ranked.join(M.extreme_dcg(slim, group, "_y", s.cut).withColumnRenamed("dcg", "_best"), group)
        else:
            ranked = ranked.withColumn("_best", F.lit(1.0))
        sums = pairwise.gradients(ranked, group, lead=s.cut)  # pairs of two rows beyond the cut change nothing
    sums = sums.select("_id", F.col("r").alias("_r0"), F.col("w").alias("_w0"))
    out = df.join(sums, "_id", "left").fillna(0.0, ["_r0", "_w0"])
    if s.label_share:
        out = out.withColumn("_r0", (1 - s.label_share) * F.col("_r0") + s.label_share * (y - f)).withColumn("_w0", (1 - s.label_share) * F.col("_w0") + s.label_share)
    return out


def _leaf_value(s: Settings, n: float, r: float, w: float, middle: float | None) -> float:
    if s.loss in _OWN:
        v = _OWN[s.loss].leaf(n, r, w)
    elif s.loss == "l2":
        v = r / max(n, 1)
    elif s.loss == "l1":
        v = middle if middle and r else 0.0
    elif s.loss == "logistic":
        v = r / max(w, 1e-12) * (s.classes - 1) / s.classes if s.classes > 2 else r / max(w, 1e-12)
    elif s.step in ("line", "search"):
        v = r / max(w, 1e-12) / 2
    else:
        return s.rate / 2 * ((middle or 0.0) if s.step == "median" else r / max(n, 1))
    return max(-s.clamp, min(s.clamp, v * s.rate))


def _histograms(features: list[int]):
    """Batches of (node, codes, response) -> (node, feature, bin, n, total), one row for each that occurs in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            node, codes, response = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy()
            if not len(node):
                continue
            codes = codes.flatten().to_numpy().reshape(len(node), -1)
            for k in np.unique(node):
                own = node == k
                for f in features:
                    bins = codes[own, f]
                    n, total = np.bincount(bins), np.bincount(bins, response[own])
                    if (k, f) in held:
                        old, sums = held[k, f]
                        if len(old) > len(n):
                            n, total = np.pad(n, (0, len(old) - len(n))), np.pad(total, (0, len(old) - len(total)))
                        n[: len(old)] += old
                        total[: len(old)] += sums
                    held[k, f] = n, total
        for (k, f), (n, total) in held.items():
            on = np.flatnonzero(n)
            size = len(on)
            columns = [pa.array(np.full(size, k, np.int32)), pa.array(np.full(size, f, np.int32)), pa.array(on.astype(np.int32)), pa.array(n[on].astype(np.int64)), pa.array(total[on].astype(np.float64))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "feature", "bin", "n", "total"])

    return run


Histogram = dict[int, tuple[np.ndarray, np.ndarray]]  # by feature: rows and sums of responses by bin


def _best(h: Histogram, least: int) -> tuple[float, int, int] | None:
    """(gain, feature, bin) of the best split: rows up to the bin go left; ties go to the smaller feature, then bin."""
    best = None
    for f in sorted(h):
        n, t = h[f]
        left_n, left = np.cumsum(n)[:-1], np.cumsum(t)[:-1]
        whole_n, whole = n.sum(), t.sum()
        ok = np.flatnonzero((n[:-1] > 0) & (left_n >= least) & (whole_n - left_n >= least))
        if not len(ok):
            continue
        gain = left[ok] ** 2 / left_n[ok] + (whole - left[ok]) ** 2 / (whole_n - left_n[ok]) - whole**2 / whole_n
        i = int(np.argmax(gain))
        if gain[i] > 1e-12 and (best is None or gain[i] > best[0]):
            best = float(gain[i]), f, int(ok[i])
    return best


def _threshold(starts: list[float], code: int, midway: bool) -> float:
    """Where a split after a bin parts raw values: midway to the next bin's start, or right before it."""
    return decode(starts, code) if midway else float(np.nextafter(starts[code + 1], -np.inf))


def grow(coded: DataFrame, features: list[str], books: dict[str, list[float]], s: Settings, response: str, weight: str, label: str, score: str, allowed: list[int] | None = None) -> Tree:
    """A tree over rows with codes: `codes` is an array with the bin of each feature. allowed: the features' numbers to split by, if not all."""
    listed = list(range(len(features))) if allowed is None else allowed
    trial = Tree()  # all splits made so far, of which the tree takes the best first
    cuts: dict[int, tuple[int, int]] = {}  # a split node of it -> feature and code
    parent: dict[int, int] = {}
    sums: dict[int, Histogram] = {}
    totals: dict[int, tuple[int, float]] = {}
    found: dict[int, tuple[float, int, int] | None] = {}

    def leaf(i: int = 0) -> Column:
        if i not in cuts:
            return F.lit(i)
        f, code = cuts[i]
        return F.when(F.get("codes", F.lit(f)) <= code, leaf(trial.nodes[i].left)).otherwise(leaf(trial.nodes[i].right))

    def count(ids: list[int]) -> None:
        rows = coded.select(leaf().cast("int").alias("node"), "codes", F.col(response).cast("double").alias("response"))
        rows = rows.where(F.col("node").isin(ids)) if cuts else rows
        made = rows.mapInArrow(_histograms(listed), "node int, feature int, bin int, n long, total double")
        for i in ids:
            sums[i] = {f: (np.zeros(len(books[features[f]]), np.int64), np.zeros(len(books[features[f]]))) for f in listed}
        for x in made.groupBy("node", "feature", "bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():  # leaves x features x bins
            sums[x.node][x.feature][0][x.bin], sums[x.node][x.feature][1][x.bin] = x.n, x.total
        for i in ids:
            found[i] = _best(sums[i], s.least)

    def divide(i: int) -> None:
        """Split a leaf of the trial tree; its histogram says what goes left and right."""
        gain, f, code = found[i]
        at, node = len(trial.nodes), trial.nodes[i]
        node.feature, node.threshold, node.left, node.right, node.gain = features[f], _threshold(books[features[f]], code, not s.bins), at, at + 1, gain
        trial.nodes += [Node(), Node()]
        cuts[i], parent[at], parent[at + 1] = (f, code), i, i
        n, t = sums[i][f]
        totals[at] = int(n[: code + 1].sum()), float(t[: code + 1].sum())
        totals[at + 1] = int(n[code + 1 :].sum()), float(t[code + 1 :].sum())

    def count_children(ids: list[int]) -> None:
        """One pass counts the smaller child of each; the other is what is left of the parent."""
        pairs = [sorted((trial.nodes[i].left, trial.nodes[i].right), key=lambda j: (totals[j][0], j)) for i in ids]
        count([small for small, _ in pairs])
        for i, (small, other) in zip(ids, pairs, strict=True):
            sums[other] = {f: (n - sums[small][f][0], t - sums[small][f][1]) for f, (n, t) in sums[i].items()}
            found[other] = _best(sums[other], s.least)

    count([0])
    whole = next(iter(sums[0].values()), (np.zeros(1, np.int64), np.zeros(1)))
    totals[0] = int(whole[0].sum()), float(whole[1].sum())
    tree, leaves = Tree(), {0: 0}  # leaf of the tree -> its node in the trial tree
    while len(tree.nodes) < 2 * s.leaves - 1:
        if lacking := {parent[j] for j in leaves.values() if j not in sums}:
            for j in leaves.values():  # what may be split next is counted in the same pass
                if found.get(j) and j not in cuts:
                    divide(j)
                    lacking.add(j)
            count_children(sorted(lacking))
        open_leaves = [i for i in leaves if found[leaves[i]]]
        if not open_leaves:
            break
        at = max(open_leaves, key=lambda i: (found[leaves[i]][0], -i))
        if leaves[at] not in cuts:
            divide(leaves[at])
        own = trial.nodes[leaves[at]]
        k, node = len(tree.nodes), tree.nodes[at]
        node.feature, node.threshold, node.left, node.right, node.gain = own.feature, own.threshold, k, k + 1, own.gain
        tree.nodes += [Node(), Node()]
        del leaves[at]
        leaves[k], leaves[k + 1] = own.left, own.right
    if s.loss == "l2":  # the histograms hold all that its leaves need
        for i, j in leaves.items():
            tree.nodes[i].value = _leaf_value(s, *totals[j], 0.0, None)
        return tree
    middle: dict[object, float] = {}
    if s.loss == "l1":
        middle = medians.medians(coded, tree.leaf(), F.col(label).cast("double") - F.col(score))
    elif s.loss in PAIR_LOSSES and s.step == "median":
        middle = medians.upper_middles(coded, tree.leaf(), F.col(response))
    asked = coded.groupBy(tree.leaf().alias("leaf")).agg(F.count(F.lit(1)).alias("n"), F.sum(response).alias("r"), F.sum(weight).alias("w"))
    for x in asked.collect():  # leaves
        tree.nodes[x.leaf].value = _leaf_value(s, x.n, x.r, x.w, middle.get(x.leaf))
    return tree


def _trimmed(rows: DataFrame, s: Settings, k: int, iteration: int) -> DataFrame:
    """Rows without the lightest ones, whose weights sum up to a share of all; by a histogram of weights, 4,096 bins wide at most."""
    if not s.trim or iteration < s.trim_from or s.loss != "logistic":
        return rows
    w = F.col(f"_w{k}")
    at = F.least(F.floor(w * (4 * 4096)), F.lit(4096)).cast("int")  # weights are p (1 - p), 1/4 at most
    bins = sorted((x.b, x.w, x.n) for x in rows.groupBy(at.alias("b")).agg(F.sum(w).alias("w"), F.count(F.lit(1)).alias("n")).collect())
    goal, most, seen, dropped, limit = s.trim * sum(x[1] for x in bins), 0.8 * sum(x[2] for x in bins), 0.0, 0, -1
    for b, weight, n in bins:
        if seen + weight > goal or dropped + n > most:
            break
        seen, dropped, limit = seen + weight, dropped + n, b
    return rows.where(at > limit)


def train(df: DataFrame, features: list[str], label: str, settings: Settings, group: str | None = None, valid: DataFrame | None = None, learner: Callable[..., Tree] | None = None, measure: Callable[[DataFrame], dict[str, float]] | None = None) -> Ensemble:
    """Fit an ensemble. group: the query column, for pair losses. valid: rows whose error is kept in history.

    learner: a weak learner of the user's own, with grow()'s arguments; measure: what history keeps of the scored valid rows.
    """
    learner = learner or grow
    s = settings
    if s.loss in PAIR_LOSSES and group is None:
        raise ValueError("pair losses need a group")
    if s.loss not in LOSSES and s.loss not in _OWN:
        raise ValueError(f"unknown loss: {s.loss}")
    model = Ensemble(features=list(features))
    books = _books(df, features, s.bins)
    codes = F.array(*[encode(F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)), books[f]).cast("int") for f in features])
    if s.loss == "l2":
        model.base = float(df.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0)
    elif s.loss == "l1":
        model.base = medians.medians(df, F.lit(0), F.col(label)).get(0, 0.0)
    if s.step not in ("line", "median", "average", "search"):
        raise ValueError(f"unknown step: {s.step}")
    largest = None if group is None or s.loss not in PAIR_LOSSES else df.groupBy(group).count().agg(F.max("count")).first()[0] or 0
    many = s.classes if s.loss == "logistic" and s.classes > 2 else 1
    rows = df.withColumn("codes", codes).withColumn("_id", F.monotonically_increasing_id())
    rows, path = stored(rows.select(*df.columns, "codes", "_id", *[F.lit(model.base).alias(f"_f{k}") for k in range(many)]), "boost")
    for i in range(s.trees):
        work = _responses(_share(rows, s, i, group), s, label, group, largest).persist()
        trees = [learner(_trimmed(work, s, k, i), features, books, s, f"_r{k}", f"_w{k}", label, f"_f{k}", _allowed(len(features), s, i)) for k in range(many)]
        if s.step == "search" and s.loss in PAIR_LOSSES:
            _search_leaves(work, trees[0], s, group, label)
        work.unpersist()
        model.trees.append(trees)
        rows = rows.withColumns({f"_f{k}": F.col(f"_f{k}") + t.column() for k, t in enumerate(trees)})
        if i % s.refresh == s.refresh - 1:  # lineage is cut through the shared folder, from which lost executors' rows are read again
            before = path
            rows, path = stored(rows, "boost")
            drop(df.sparkSession, before)
        if valid is not None:
            model.history.append({"iteration": i + 1} | (measure(model.predict(valid)) if measure else _measured(model, valid, label, s, group)))
    return model


def _search_leaves(rows: DataFrame, tree: Tree, s: Settings, group: str, label: str) -> None:
    """Scale each leaf's value by the weight, up to 2, at which NDCG is best along it; leaves that can't gain keep theirs."""
    moved = rows.select(group, label, "_f0", tree.leaf().alias("_leaf"), tree.column().alias("_step"))
    for r in findstep.best_steps(moved, group, label, "_f0", "_leaf", "_step", 0.0, 2.0, s.cut).collect():  # leaves
        if r.gain > 1e-9:
            tree.nodes[r.leaf].value *= r.weight


def _books(df: DataFrame, features: list[str], bins: int) -> dict[str, list[float]]:
    """Where each feature's bins start: at quantiles of its rows, or (bins: 0) by gaps over all its distinct values."""
    number = lambda f: F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0))
    if bins:
        shares = [i / bins for i in range(bins + 1)]
        cuts = df.select(*[F.percentile_approx(number(f), shares, 10_000).alias(f) for f in features]).first()
        return {f: gap_bins(np.unique(np.array(cuts[f] or [0.0]))) for f in features}
    long = df.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), number(f).alias("value")) for f in features])))
    found = {r.feature: list(r.starts) for r in codebook(long).collect()}  # codebooks
    return {f: found.get(f, [0.0]) for f in features}


def _share(rows: DataFrame, s: Settings, iteration: int, group: str | None) -> DataFrame:
    """The rows (whole queries, if there is a group) that an iteration's trees are fitted to."""
    if s.row_share >= 1:
        return rows
    drawn = F.pmod(F.xxhash64(F.lit(s.seed), F.lit(iteration), F.col(group or "_id")), F.lit(1 << 30)) / float(1 << 30)
    return rows.where(drawn < s.row_share)


def _allowed(features: int, s: Settings, iteration: int) -> list[int] | None:
    if s.feature_share >= 1:
        return None
    drawn = np.random.default_rng([s.seed, iteration]).permutation(features)
    return sorted(drawn[: max(1, round(features * s.feature_share))].tolist())


def _measured(model: Ensemble, valid: DataFrame, label: str, s: Settings, group: str | None) -> dict[str, float]:
    scored = model.predict(valid)
    if s.loss in PAIR_LOSSES:
        got = M.ndcg(scored, group, label, "score", s.cut).agg(F.avg("ndcg")).first()[0]
        return {"ndcg": float(got or 0.0)}
    if s.loss == "logistic" and s.classes == 2:
        return {"error": float(scored.agg(F.avg(F.when((F.col("score") > 0) == (F.col(label) > 0), 0.0).otherwise(1.0))).first()[0] or 0.0)}
    if s.loss == "logistic":
        scores = F.array(*[F.col("score" if k == 0 else f"score_{k}") for k in range(s.classes)])
        return {"error": float(scored.agg(F.avg(F.when(M.argmax(scores) == F.col(label), 0.0).otherwise(1.0))).first()[0] or 0.0)}
    return {"rmse": float(M.regression_error(scored, label, "score").first().rmse or 0.0)}

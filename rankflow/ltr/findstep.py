"""How far to go along a second score: the weight of it that gives the best mean NDCG.

Where two rows of a query change places is known exactly. Crossings become events (weight, change of the query's
measure), and a running sum over all events finds the best stretch. Queries are worked off apart from each other; only the
events, summed up by weight, meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankflow.ltr.metrics import GAINS
from rankflow.storage import ranged


def _batch_events(y: np.ndarray, a: np.ndarray, b: np.ndarray, low: float, high: float, cut: int) -> tuple[np.ndarray, np.ndarray]:
    """Events of queries of one size: rows are queries. Equal scores put low labels first."""
    m, n = y.shape
    first = np.argsort(y, axis=1, kind="stable")
    y, a, b = (np.take_along_axis(x, first, 1) for x in (y, a, b))
    gains = np.array(GAINS)[np.clip(y.astype(int), 0, len(GAINS) - 1)]
    discounts = 1 / np.log(2 + np.arange(min(cut, n)))
    best = -np.sort(-gains, axis=1)[:, : len(discounts)] @ discounts
    i, j = np.triu_indices(n, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = (a[:, i] - a[:, j]) / (b[:, j] - b[:, i])
    at = np.sort(np.where((at > low) & (at < high), at, high), axis=1)
    at = at[:, : int((at < high).sum(1).max(initial=0))]  # columns that are `high` in every query say nothing
    edges = np.concatenate((np.full((m, 1), low), at, np.full((m, 1), high)), 1)
    middle = (edges[:, :-1] + edges[:, 1:]) / 2
    values = np.empty_like(middle)
    step = max(1, (1 << 20) // max(1, m * n))
    for lo in range(0, middle.shape[1], step):
        scores = a[:, None, :] + middle[:, lo : lo + step, None] * b[:, None, :]
        order = np.argsort(-scores, axis=2, kind="stable")[:, :, : len(discounts)]
        values[:, lo : lo + step] = np.take_along_axis(np.broadcast_to(gains[:, None, :], scores.shape), order, 2) @ discounts
    values = np.where(best[:, None] > 0, values / np.where(best > 0, best, 1)[:, None], 0.0)
    change = np.diff(values, axis=1, prepend=0.0)
    keep = (np.abs(change) > 1e-15) & (edges[:, :-1] < high)
    keep[:, 0] = True
    return edges[:, :-1][keep], change[keep]


#: From so many rows on, a query's rows are narrowed down before their crossings are listed.
LARGE, HALVINGS = 64, 20


def _stretches(y: np.ndarray, a: np.ndarray, b: np.ndarray, low: float, high: float, cut: int, halvings: int = HALVINGS) -> tuple[np.ndarray, np.ndarray]:
    """(where stretches start, unscaled DCG in each) of one large query.

    A row can be among the first `cut` somewhere in a stretch only if its greatest score there reaches the cut-th greatest
    of all rows' least scores there. Scores are linear, so both are at the ends. What is left of a narrow stretch is few
    rows, and only their crossings matter; a stretch with many is halved, if that leaves fewer.
    """

    def leading(lo: float, hi: float) -> np.ndarray:
        if len(y) <= cut:
            return np.ones(len(y), bool)
        ends = np.stack((a + lo * b, a + hi * b))
        return ends.max(0) >= np.partition(ends.min(0), len(y) - cut)[len(y) - cut]

    keep = leading(low, high)
    y, a, b = y[keep], a[keep], b[keep]
    if len(y) > LARGE and halvings:
        middle = (low + high) / 2
        halves = [(low, middle), (middle, high)]
        kept = [leading(*side) for side in halves]
        if sum(int(k.sum()) for k in kept) < 1.7 * len(y):
            parts = [_stretches(y[k], a[k], b[k], *side, cut, halvings - 1) for side, k in zip(halves, kept, strict=True)]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    first = np.argsort(y, kind="stable")
    y, a, b = y[first], a[first], b[first]
    gains = np.array(GAINS)[np.clip(y.astype(int), 0, len(GAINS) - 1)]
    discounts = 1 / np.log(2 + np.arange(min(cut, len(y))))
    i, j = np.triu_indices(len(y), 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = (a[i] - a[j]) / (b[j] - b[i])
    edges = np.concatenate(([low], np.unique(at[(at > low) & (at < high)]), [high]))
    middle = (edges[:-1] + edges[1:]) / 2
    values, step = np.empty(len(middle)), max(1, (1 << 20) // len(y))
    for lo in range(0, len(middle), step):
        order = np.argsort(-(a + middle[lo : lo + step, None] * b), axis=1, kind="stable")[:, : len(discounts)]
        values[lo : lo + step] = gains[order] @ discounts
    return edges[:-1], values


def _large_events(y: np.ndarray, a: np.ndarray, b: np.ndarray, low: float, high: float, cut: int) -> tuple[np.ndarray, np.ndarray]:
    gains = -np.sort(-np.array(GAINS)[np.clip(y.astype(int), 0, len(GAINS) - 1)])[:cut]
    best = gains @ (1 / np.log(2 + np.arange(len(gains))))
    at, values = _stretches(y, a, b, low, high, cut)
    change = np.diff(values / best if best > 0 else values * 0, prepend=0.0)
    keep = np.abs(change) > 1e-15
    keep[0] = True
    return at[keep], change[keep]


def _events(low: float, high: float, cut: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0)
            flat = rows.flatten()
            y, a, b = (flat.field(k).to_numpy(zero_copy_only=False).astype(float) for k in range(3))
            sizes = rows.value_lengths().to_numpy()
            starts = np.cumsum(sizes) - sizes
            for n in np.unique(sizes):
                own = starts[sizes == n]
                most = max(1, (1 << 21) // int(n * n))  # queries whose crossings are held at once
                for at in own[:, None] + np.arange(n) if n > LARGE else ():
                    weights, changes = _large_events(y[at], a[at], b[at], low, high, cut)
                    yield pa.RecordBatch.from_arrays([pa.array(weights), pa.array(changes)], ["weight", "change"])
                for lo in range(0, len(own), most) if n <= LARGE else ():
                    at = own[lo : lo + most, None] + np.arange(n)
                    weights, changes = _batch_events(y[at], a[at], b[at], low, high, cut)
                    into, back = np.unique(weights, return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array(into), pa.array(np.bincount(back, changes, len(into)))], ["weight", "change"])

    return run


def best_step(df: DataFrame, group: str, label: str, score: str, step: str, low: float = 0.0, high: float = 1.0, cut: int = 10) -> DataFrame:
    """One row: weight (midway in the best stretch) and the mean NDCG there. Queries whose labels are all equal do not count."""
    slim = df.select(F.col(group).alias("g"), F.col(label).cast("double").alias("label"), F.col(score).cast("double").alias("score"), F.col(step).cast("double").alias("step"))
    queries = slim.groupBy("g").agg(F.collect_list(F.struct("label", "score", "step")).alias("rows"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    events = queries.select("rows").mapInArrow(_events(low, high, cut), "weight double, change double").groupBy("weight").agg(F.sum("change").alias("change"))
    # Running sums in ranges of weights, set off by the sums of the ranges before.
    parts = ranged(events, ["weight"])
    sums = parts.groupBy("_part").agg(F.sum("change").alias("s"), F.min("weight").alias("first"))
    w = Window.orderBy("_part")
    starts = sums.select("_part", F.coalesce(F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"), F.lead("first").over(w).alias("after"))
    own = Window.partitionBy("_part").orderBy("_own")
    run = parts.join(starts, "_part").select("weight", (F.col("before") + F.sum("change").over(own.rowsBetween(Window.unboundedPreceding, 0))).alias("total"), F.coalesce(F.lead("weight").over(own), "after", F.lit(high)).alias("end"))
    n = slim.groupBy("g").agg((F.min("label") != F.max("label")).alias("mixed")).where("mixed").agg(F.count(F.lit(1)).alias("n"))
    best = run.agg(F.max_by(F.struct("weight", "end", "total"), F.struct(F.round("total", 9).alias("t"), (-F.col("weight")).alias("w"))).alias("b"))
    return best.crossJoin(F.broadcast(n)).where("n > 0").select(((F.col("b.weight") + F.col("b.end")) / 2).alias("weight"), (F.col("b.total") / F.col("n")).alias("ndcg"))


def _events_by_leaf(low: float, high: float, cut: int):
    """Batches of (leaf, rows of a query with that leaf's step) -> (leaf, weight, change)."""
    inner = _events(low, high, cut)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = batch.column(0).to_numpy()
            for leaf in np.unique(leaves):
                own = batch.filter(pa.array(leaves == leaf)).select(["rows"])
                for made in inner(iter([own])):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(made.num_rows, leaf, np.int32)), *made.columns], ["leaf", "weight", "change"])

    return run


def best_steps(df: DataFrame, group: str, label: str, score: str, leaf: str, step: str, low: float = 0.0, high: float = 2.0, cut: int = 10) -> DataFrame:
    """(leaf, weight, gain): how far to go along each leaf's own step, the other leaves at rest, and what mean NDCG gains by it over `low`.

    All leaves in one pass: a query is worked off once for each leaf that it has rows in, with the step of these rows alone. Queries
    whose labels are all equal do not count. A leaf that changes nothing goes half way, like any other stretch without a change.
    """
    slim = df.select(F.col(group).alias("g"), F.col(leaf).cast("int").alias("leaf"), F.col(label).cast("double").alias("label"), F.col(score).cast("double").alias("score"), F.col(step).cast("double").alias("step"))
    rows = F.collect_list(F.struct("label", "score", "leaf", "step"))
    queries = slim.groupBy("g").agg(rows.alias("rows"), F.collect_set("leaf").alias("leaves"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    own = queries.select(F.explode("leaves").alias("leaf"), "rows")
    own = own.select("leaf", F.transform("rows", lambda r: F.struct(r["label"].alias("label"), r["score"].alias("score"), F.when(r["leaf"] == F.col("leaf"), r["step"]).otherwise(0.0).alias("step"))).alias("rows"))
    events = own.mapInArrow(_events_by_leaf(low, high, cut), "leaf int, weight double, change double").groupBy("leaf", "weight").agg(F.sum("change").alias("change"))
    # Running sums of each leaf in ranges of weights, set off by the sums of the ranges before.
    parts = ranged(events, ["leaf", "weight"])
    sums = parts.groupBy("_part", "leaf").agg(F.sum("change").alias("s"), F.min("weight").alias("first"))
    w = Window.partitionBy("leaf").orderBy("_part")
    starts = sums.select("_part", "leaf", F.coalesce(F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"), F.lead("first").over(w).alias("after"))
    inside = Window.partitionBy("_part", "leaf").orderBy("_own")
    total = F.col("before") + F.sum("change").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    run = parts.join(starts, ["_part", "leaf"]).select("leaf", "weight", total.alias("total"), F.coalesce(F.lead("weight").over(inside), "after", F.lit(high)).alias("end"))
    n = slim.groupBy("g").agg((F.min("label") != F.max("label")).alias("mixed")).where("mixed").agg(F.count(F.lit(1)).alias("n"))
    best = run.groupBy("leaf").agg(F.max_by(F.struct("weight", "end", "total"), F.struct(F.round("total", 9).alias("t"), (-F.col("weight")).alias("w"))).alias("b"), F.min_by("total", "weight").alias("at_low"))
    return best.crossJoin(F.broadcast(n)).select("leaf", ((F.col("b.weight") + F.col("b.end")) / 2).alias("weight"), ((F.col("b.total") - F.col("at_low")) / F.col("n")).alias("gain"))


def blended(df: DataFrame, scores: dict[str, float], out: str = "score") -> DataFrame:
    """A linear combination of scores."""
    return df.withColumn(out, sum((F.col(c) * w for c, w in scores.items()), F.lit(0.0)))

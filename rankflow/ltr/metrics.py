"""Ranking and prediction metrics, as windows and aggregates. Frames hold (group, label, score[, tie])."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankflow.ltr import pairwise

#: Gains of the labels 0 to 4.
GAINS = (0.0, 3.0, 7.0, 15.0, 31.0)


def gain(label: Column, gains: tuple[float, ...] = GAINS) -> Column:
    table = F.array(*[F.lit(g) for g in gains])
    at = F.least(F.greatest(label.cast("int"), F.lit(0)), F.lit(len(gains) - 1))
    return F.get(table, at)


def discount(rank0: Column) -> Column:
    return 1.0 / F.log(2.0 + rank0)


def _ordered(group: str, label: str, score: str, ties: str):
    """Equal scores: optimistic puts high labels first, pessimistic low ones."""
    by_label = F.col(label).desc() if ties == "optimistic" else F.col(label).asc()
    return Window.partitionBy(group).orderBy(F.col(score).desc(), by_label)


def _gains_by_rank(label: str, rank: str, cut: int, gains: Column | None = None) -> Column:
    value = gain(F.col(label)) if gains is None else gains
    return F.sum(F.when(F.col(rank) < cut, value * discount(F.col(rank))).otherwise(0.0))


def _placed(df: DataFrame, group: str, label: str, score: str, ties: str) -> tuple[DataFrame, Column | None]:
    """df with _r, places from 0, and what a row gains if that is not its own label's gain. Both windows share the group's shuffle."""
    kind = "pessimistic" if ties == "mean" else ties
    ranked = df.withColumn("_r", F.row_number().over(_ordered(group, label, score, kind)) - 1)
    if ties != "mean":
        return ranked, None
    return ranked.withColumn("_mean", F.avg(gain(F.col(label))).over(Window.partitionBy(group, score))), F.col("_mean")


def best_dcg(df: DataFrame, group: str, label: str, cut: int, name: str) -> DataFrame:
    """df with `name`, its query's DCG in the best order: by windows, so that rows dealt by group stay where they are."""
    ranked = df.withColumn("_b", F.row_number().over(Window.partitionBy(group).orderBy(F.col(label).desc())) - 1)
    own = F.when(F.col("_b") < cut, gain(F.col(label)) * discount(F.col("_b"))).otherwise(0.0)
    return ranked.withColumn(name, F.sum(own).over(Window.partitionBy(group))).drop("_b")


def dcg(df: DataFrame, group: str, label: str, score: str, cut: int, ties: str = "pessimistic") -> DataFrame:
    """(group, dcg) at a cut. ties: optimistic, pessimistic, or mean (a block of equal scores shares its mean gain)."""
    ranked, gains = _placed(pairwise.dealt(df, group), group, label, score, ties)
    return ranked.groupBy(group).agg(_gains_by_rank(label, "_r", cut, gains).alias("dcg"))


def extreme_dcg(df: DataFrame, group: str, label: str, cut: int, best: bool = True, offset: int = 0) -> DataFrame:
    """(group, dcg) of the best or the worst order, whose first row has the place `offset`; the cut counts all places."""
    w = Window.partitionBy(group).orderBy(F.col(label).desc() if best else F.col(label).asc())
    ranked = pairwise.dealt(df, group).withColumn("_r", F.row_number().over(w) - 1 + offset)
    return ranked.groupBy(group).agg(_gains_by_rank(label, "_r", cut).alias("dcg"))


def ndcg(df: DataFrame, group: str, label: str, score: str, cut: int, ties: str = "pessimistic", empty: float | None = None, rule: str = "labels") -> DataFrame:
    """(group, ndcg). Degenerate queries (rule labels: all labels equal; rule gain: no gain) are left out, or get the score `empty`."""
    return ndcgs(df, group, label, score, cut, (ties,), empty, rule).withColumnRenamed(f"ndcg_{ties}", "ndcg")


def ndcgs(df: DataFrame, group: str, label: str, score: str, cut: int, kinds: tuple[str, ...], empty: float | None = None, rule: str = "labels") -> DataFrame:
    """(group, ndcg_<kind> for each rule of ties).

    One shuffle by group: its orders by score and by label are windows over it, and one aggregate takes all.
    """
    ranked = pairwise.dealt(df, group).withColumn("_b", F.row_number().over(Window.partitionBy(group).orderBy(F.col(label).desc())) - 1)
    sums = []
    for ties in kinds:
        ranked, gains = _placed(ranked, group, label, score, ties)
        ranked = ranked.withColumnRenamed("_r", f"_r_{ties}")
        sums.append(_gains_by_rank(label, f"_r_{ties}", cut, gains).alias(f"_dcg_{ties}"))
    both = ranked.groupBy(group).agg(*sums, _gains_by_rank(label, "_b", cut).alias("_best"), (F.min(label) == F.max(label)).alias("_flat"))
    flat = F.col("_flat") if rule == "labels" else F.col("_best") <= 0
    both = both.where(~flat) if empty is None else both

    def value(ties: str) -> Column:
        share = F.try_divide(f"_dcg_{ties}", "_best")
        return F.coalesce(share if empty is None else F.when(flat, F.lit(empty)).otherwise(share), F.lit(0.0)).alias(f"ndcg_{ties}")

    return both.select(group, *map(value, kinds))


def mean_measures(df: DataFrame, group: str, label: str, score: str, cut: int, empty: float | None = None) -> DataFrame:
    """One row: the means over queries of cross entropy and pair error (of queries with pairs), and of NDCG by tie rule."""
    pair = pair_error(df, group, label, score).select(group, "error").join(cross_entropy(df, group, label, score), group)
    out = pair.agg(F.avg("entropy").alias("cross_entropy"), F.avg("error").alias("pair_error"))
    kinds = ("pessimistic", "mean", "optimistic")
    means = ndcgs(df, group, label, score, cut, kinds, empty).agg(*[F.avg(f"ndcg_{ties}").alias(f"ndcg_{ties}") for ties in kinds])
    return out.crossJoin(F.broadcast(means))  # one row each


def class_measures(df: DataFrame, group: str, label: str, probabilities: str, cut: int, empty: float | None = None) -> DataFrame:
    """One row for a classifier of grades: mean NDCG of its expected labels by tie rule, and its share of wrong classes."""
    scored = df.select(group, label, expected_label(F.col(probabilities)).alias("_score"), argmax(F.col(probabilities)).alias("_class"))
    out = class_error(scored, label, "_class").select(F.col("error").alias("class_error"))
    kinds = ("pessimistic", "mean", "optimistic")
    means = ndcgs(scored, group, label, "_score", cut, kinds, empty).agg(*[F.avg(f"ndcg_{ties}").alias(f"ndcg_{ties}") for ties in kinds])
    return out.crossJoin(F.broadcast(means))  # one row each


def reciprocal_rank(df: DataFrame, group: str, label: str, score: str, tie: str) -> DataFrame:
    """(group, rr): one over the place of the first row with a label, 0 if there is none."""
    ranked = pairwise.dealt(df, group).withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(tie))))
    return ranked.groupBy(group).agg(F.coalesce(1.0 / F.min(F.when(F.col(label) > 0, F.col("_r"))), F.lit(0.0)).alias("rr"))


def pairs(df: DataFrame, group: str, label: str, score: str) -> DataFrame:
    """(group, hi, lo): the scores of all pairs with different labels, the higher label first. Quadratic in a query's rows."""
    a = df.select(group, F.col(label).alias("_la"), F.col(score).alias("hi"))
    b = df.select(group, F.col(label).alias("_lb"), F.col(score).alias("lo"))
    return a.join(b, group).where("_la > _lb").select(group, "hi", "lo")


def pair_error(df: DataFrame, group: str, label: str, score: str) -> DataFrame:
    """(group, pairs, errors, error): counted without listing pairs.

    For each row, the rows of lower labels with scores from its own on up are counted by running sums over the scores,
    one for each label, so a query costs rows times labels. One shuffle by group serves all steps.
    """
    tally = pairwise.dealt(df, group).groupBy(group, score, label).agg(F.count(F.lit(1)).alias("_n"))
    labels = tally.withColumn("_labels", F.collect_set(label).over(Window.partitionBy(group)))
    wide = labels.withColumn("_low", F.explode("_labels")).where(F.col("_low") <= F.col(label))
    mine = wide.select(group, "_low", F.col(score).alias("_s"), F.when(F.col("_low") < F.col(label), F.col("_n")).otherwise(0).alias("_n"), F.when(F.col("_low") == F.col(label), F.col("_n")).otherwise(0).alias("_m"))
    per_label = Window.partitionBy(group, "_low")
    above = per_label.orderBy(F.col("_s").desc()).rangeBetween(Window.unboundedPreceding, 0)
    counted = mine.withColumn("_above", F.sum("_m").over(above)).withColumn("_all", F.sum("_m").over(per_label))
    out = counted.groupBy(group).agg(F.sum(F.col("_n") * F.col("_all")).alias("pairs"), F.sum(F.col("_n") * F.col("_above")).alias("errors"))
    return out.where("pairs > 0").select(group, "pairs", "errors", (F.col("errors") / F.col("pairs")).alias("error"))


def pair_cost(hi: Column, lo: Column) -> Column:
    """Cross entropy of a pair: ln(1 + exp(-2 d)), without overflow."""
    d = 2.0 * (hi - lo)
    return F.greatest(-d, F.lit(0.0)) + F.log1p(F.exp(-F.abs(d)))


def cross_entropy(df: DataFrame, group: str, label: str, score: str) -> DataFrame:
    """(group, entropy): the mean cost of a query's pairs, summed tile by tile (see pairwise); queries without pairs are left out."""
    found = pairwise.costs(df, group, F.col(label), F.col(score)).where("pairs > 0")
    return found.select(group, (F.col("cost") / F.col("pairs")).alias("entropy"))


def argmax(probabilities: Column) -> Column:
    """The first place of the greatest."""
    return F.array_position(probabilities, F.array_max(probabilities)) - 1


def class_error(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """One row, error: the share of wrong classes; labels up to 0 are right with class 0."""
    right = (F.col(label) == F.col(predicted)) | ((F.col(label) <= 0) & (F.col(predicted) == 0))
    return df.agg(F.avg(F.when(right, 0.0).otherwise(1.0)).alias("error"))


def expected_label(probabilities: Column) -> Column:
    return F.aggregate(F.transform(probabilities, lambda p, j: p * j), F.lit(0.0), lambda s, x: s + x)


def confusion(df: DataFrame, label: str, probability: str, at: float = 0.5) -> DataFrame:
    """One row: tp, fp, fn, tn, precision, recall, error."""
    yes, true = F.col(probability) >= at, F.col(label) > 0
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    out = df.agg(n(yes & true).alias("tp"), n(yes & ~true).alias("fp"), n(~yes & true).alias("fn"), n(~yes & ~true).alias("tn"))
    return out.select("*", F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"), F.try_divide(F.col("fp") + F.col("fn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("error"))


def regression_error(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: rmse, mae."""
    d = F.col(label) - F.col(score)
    return df.agg(F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"))


def best_iteration(history: DataFrame, metric: str, higher: bool) -> DataFrame:
    """One row: the iteration with the best value, and that."""
    pick, extreme = (F.max_by, F.max) if higher else (F.min_by, F.min)
    return history.agg(pick("iteration", metric).alias("iteration"), extreme(metric).alias("value"))

"""Binning of features, and histograms over bins."""

from __future__ import annotations

import bisect
import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankflow.ltr.gap_ranges import ranged_starts, start_rows
from rankflow.storage import numbered_rows


def dense_codes(df: DataFrame, value: str, out: str = "code") -> DataFrame:
    """Each distinct value's place among all, from 0. Distinct values, not rows, are numbered."""
    distinct = df.select(F.col(value).alias("_v")).distinct()
    codes = numbered_rows(distinct, ["_v"], out)
    return df.join(codes, F.col(value).eqNullSafe(F.col("_v"))).drop("_v")


class GapBins:
    """Where bins start over values that come in ascending order: a value opens one if it is a gap beyond the last start.

    The gap is the first of 1e-8, 2e-8, 4e-8 ... under which there are at most `most` starts. All gaps that may still be it
    are followed at once, so one pass is enough and memory is bounded, whatever the number of values.
    """

    def __init__(self, most: int = 65_535, gap: float = 1e-8):
        self.most, self.first = most, None
        self.going: list[tuple[float, list[float]]] = [(gap, [])]

    def add(self, values: np.ndarray) -> None:
        if not len(values):
            return
        if self.first is None:
            self.first = float(values[0])
            self.going[0][1].append(self.first)
        # A gap wider than all values so far has one start, so gaps need not be followed before values spread beyond them.
        while self.going[-1][0] <= float(values[-1]) - self.first:
            self.going.append((self.going[-1][0] * 2, [self.first]))
        self.going = [(gap, starts) for gap, starts in self.going if self._follow(gap, starts, values)]

    def _follow(self, gap: float, starts: list[float], values: np.ndarray) -> bool:
        at = int(np.searchsorted(values, starts[-1] + gap))
        while at < len(values):
            if values[at] - starts[-1] < gap:  # the sum was rounded
                at += 1
                continue
            starts.append(float(values[at]))
            if len(starts) > self.most:
                return False
            at = max(at + 1, int(np.searchsorted(values, starts[-1] + gap)))
        return True

    def starts(self) -> list[float]:
        return self.going[0][1]


def gap_bins(values: np.ndarray, most: int = 65_535, gap: float = 1e-8) -> list[float]:
    """The starts over sorted values."""
    bins = GapBins(most, gap)
    bins.add(np.asarray(values, np.float64))
    return bins.starts()


def codebook(long: DataFrame, most: int = 65_535) -> DataFrame:
    """(feature, value) -> (feature, starts): gap bins of each feature over all its distinct values.

    Distinct values are taken before they meet, and lie in ranges: no task holds all of a feature's (see gap_ranges).
    """
    return ranged_starts(_distinct(long), most)


def _distinct(long: DataFrame) -> DataFrame:
    return long.where(F.col("value").isNotNull()).select("feature", F.col("value").cast("double").alias("value")).where(~F.isnan("value")).distinct()


def bin_starts(long: DataFrame, most: int | None = None) -> DataFrame:
    """(feature, value) -> (feature, start): the same, a row for each bin; without `most` as many bins as there are values 1e-8 apart."""
    return start_rows(_distinct(long), most)


#: From so many bins on, codes are found by levels of arrays; up to it, by nested conditions.
NESTED, FAN = 64, 16


def encode(value: Column, starts: list[float]) -> Column:
    """The last bin that starts at or before the value, 0 at least; by halving, or by levels of FAN starts each."""

    def within(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value >= starts[mid], within(mid, hi)).otherwise(within(lo, mid))

    if len(starts) <= NESTED:
        return within(0, max(1, len(starts)))
    levels = [list(starts)]
    while len(levels[0]) > FAN:
        levels.insert(0, levels[0][::FAN])
    text = F.lit(";".join(",".join(map(repr, level)) for level in levels))
    table = F.split(text, ";").cast("array<string>")
    arrays = F.transform(table, lambda t: F.split(t, ",").cast("array<double>"))  # constant, folded once
    step = lambda at, level: at * FAN + F.greatest(F.size(F.filter(F.slice(level, at * FAN + 1, FAN), lambda s: s <= value)) - 1, F.lit(0))
    return F.when(value.isNotNull(), F.aggregate(arrays, F.lit(0), step))


def decode(starts: list[float], code: float) -> float:
    """The threshold that parts a bin from the next: midway between their starts, the ends held."""
    i = min(max(int(code), 0), len(starts) - 1)
    return (starts[i] + starts[i + 1]) / 2 if i + 1 < len(starts) else starts[i]


def code_of(starts: list[float], value: float) -> int:
    return max(0, bisect.bisect_right(starts, value) - 1)


def equal_or_less_bins(counts: list[tuple[float, int]], bins: int) -> list[tuple[str, float]]:
    """Rules over sorted (value, rows): ('eq', v) for values with over a quarter of the rows, ('le', v) for runs of about rows/bins, ('gt', v) last."""
    total = sum(n for _, n in counts)
    heavy = [v for v, n in counts if 4 * n > total]
    rest = [(v, n) for v, n in counts if 4 * n <= total]
    rules, size, held = [("eq", v) for v in heavy], max(1, total // max(1, bins)), 0
    for i, (v, n) in enumerate(rest):
        held += n
        if held >= size and i + 1 < len(rest):
            rules.append(("le", v))
            held = 0
    if rest:
        before = [v for k, v in rules if k == "le"]
        rules.append(("gt", before[-1] if before else float("-inf")))
    return rules


def rule_code(value: Column, rules: list[tuple[str, float]]) -> Column:
    """The first rule that a value meets: equalities first, then the limits upward."""
    out = None
    for i, (kind, v) in enumerate(rules):
        cond = value == v if kind == "eq" else value <= v if kind == "le" else value > v
        out = F.when(cond, i) if out is None else out.when(cond, i)
    return out if out is not None else F.lit(None).cast("int")


def split_histogram(long: DataFrame, node: str = "node") -> DataFrame:
    """(node, feature, bin, response) -> (node, feature, bin, n, total)."""
    return long.groupBy(node, "feature", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("response").alias("total"))


def best_splits(histogram: DataFrame, least: int, node: str = "node") -> DataFrame:
    """(node, feature, bin, gain): the best split of each node: rows up to the bin go left.

    gain = left²/n + right²/n - all²/n, both sides of `least` rows or more; ties go to the smaller feature, then bin.
    """
    w = Window.partitionBy(node, "feature")
    run = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = histogram.select(node, "feature", "bin", F.sum("n").over(run).alias("nl"), F.sum("total").over(run).alias("sl"), F.sum("n").over(w).alias("na"), F.sum("total").over(w).alias("sa"))
    nr, sr = F.col("na") - F.col("nl"), F.col("sa") - F.col("sl")
    gains = sums.where((F.col("nl") >= least) & (nr >= least)).select(node, "feature", "bin", (F.col("sl") * F.col("sl") / F.col("nl") + sr * sr / nr - F.col("sa") * F.col("sa") / F.col("na")).alias("gain"))
    best = F.max_by(F.struct("feature", "bin", "gain"), F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b")))
    return gains.groupBy(node).agg(best.alias("s")).select(node, "s.feature", "s.bin", "s.gain")

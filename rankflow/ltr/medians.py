"""Exact medians, and other order statistics, of many groups at once, by histograms that are refined.

The first pass counts each group's values by sign and binary exponent; the bin that holds a wanted place becomes an interval, as
narrow as the values in it. Each further pass counts the values of all intervals in BINS equal bins, until the smallest and the
greatest value of an interval are one. Within an exponent that takes seven passes at most, two or three as a rule. A pass's counts are at most
intervals x BINS rows, whatever the number of values; a value that half of all rows share costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 256


def _exponent(v: Column) -> Column:
    """A whole number that never falls as v grows: by sign and power of two."""
    power = F.greatest(F.floor(F.log2(F.abs(v))), F.lit(-1100)) + 1200
    return F.when(v == 0, F.lit(0)).when(F.abs(v) == float("inf"), F.signum(v) * 4000).otherwise(F.signum(v) * power).cast("int")


def order_statistics(df: DataFrame, group: Column, value: Column, places: Callable[[int], list[int]]) -> dict[object, list[float]]:
    """For each group, the values at places(number of its values) in ascending order, from 0. Null and NaN are left out.

    The groups are few enough for the driver: leaves of a tree, features, classes.
    """
    rows = df.select(group.alias("g"), value.cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    counted = ["n", "low", "high"]
    count = [F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")]
    bins: dict[object, list[tuple]] = {}
    for r in rows.groupBy("g", _exponent(F.col("v")).alias("bin")).agg(*count).collect():  # groups x exponents
        bins.setdefault(r.g, []).append((r.bin, *(r[c] for c in counted)))
    out: dict[object, list[float]] = {}
    open_: dict[tuple, list[tuple[int, int]]] = {}  # (group, low, high) -> (which of its places, place within)

    def step_in(g: object, found: list[tuple], wanted: list[tuple[int, int]]) -> None:
        for which, place in wanted:
            for _, n, low, high in sorted(found):
                if place < n:
                    if low == high:
                        out[g][which] = low
                    else:
                        open_.setdefault((g, low, high), []).append((which, place))
                    break
                place -= n

    for g, found in bins.items():
        wanted = list(enumerate(places(sum(f[1] for f in found))))
        out[g] = [0.0] * len(wanted)
        step_in(g, found, wanted)
    while open_:
        intervals, open_ = list(open_.items()), {}
        kind = rows.schema["g"].dataType.simpleString()
        table = df.sparkSession.createDataFrame([(i, g, low, high) for i, ((g, low, high), _) in enumerate(intervals)], f"i int, h {kind}, lo double, hi double")
        # A row for each interval, of groups that the driver holds.
        inside = rows.join(F.broadcast(table), F.col("g").eqNullSafe(F.col("h")) & F.col("v").between(F.col("lo"), F.col("hi")))
        at = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1)).cast("int")
        by: dict[int, list[tuple]] = {}
        for r in inside.groupBy("i", at.alias("bin")).agg(*count).collect():  # intervals x bins
            by.setdefault(r.i, []).append((r.bin, *(r[c] for c in counted)))
        for i, ((g, _, _), wanted) in enumerate(intervals):
            step_in(g, by[i], wanted)
    return out


def middle(n: int) -> list[int]:
    return [(n - 1) // 2, n // 2]


def medians(df: DataFrame, group: Column, value: Column) -> dict[object, float]:
    """The middle value of each group, or the mean of the two middle ones."""
    return {g: low if low == high else low / 2 + high / 2 for g, (low, high) in order_statistics(df, group, value, middle).items()}


def upper_middles(df: DataFrame, group: Column, value: Column) -> dict[object, float]:
    """For each group of n values, the mean of those at n // 2 and after it (of the last alone, where there is none after it)."""
    found = order_statistics(df, group, value, lambda n: [n // 2, min(n // 2 + 1, n - 1)])
    return {g: low if low == high else low / 2 + high / 2 for g, (low, high) in found.items()}

"""Scores of segments: arrays of doubles, one place for each segment, and what is done with them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))


def largest(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.greatest(x, y))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))


def normalized(a: Column) -> Column:
    """Shares of the total; zeros where the total is zero."""
    return F.transform(a, lambda x: F.when(total(a) != 0, x / total(a)).otherwise(0.0))


def masked(a: Column, mask: Column) -> Column:
    """Scores where the mask's bit of their place is set, else 0."""
    return F.transform(a, lambda x, i: F.when(F.call_function("shiftright", mask, i).bitwiseAND(F.lit(1)) != 0, x).otherwise(0.0))


def cut_off(a: Column, cutoffs: Column) -> Column:
    """Scores that reach their place's cutoff, else 0."""
    return F.zip_with(a, cutoffs, lambda x, c: F.when(x >= c, x).otherwise(0.0))


def preselected(a: Column, mask: Column, cutoffs: Column) -> Column:
    return cut_off(masked(a, mask), cutoffs)


def propagated(own: Column, inherited: Column, weight: Column) -> Column:
    """Own scores blended with inherited ones by the weight of the own."""
    return F.zip_with(own, inherited, lambda x, y: weight * x + (1 - weight) * y)


def sampling_penalty(share: Column, least: float = 0.01, power: float = 2.0) -> Column:
    """1 above the least share, below it exp(-power * (1 - share / least))."""
    return F.when(share > least, 1.0).otherwise(F.exp(-power * (1 - share / least)))


def blend_weight(share: Column, prior: Column, least: float = 0.01) -> Column:
    """1 from the least share on; below it share / min(prior + share, least), both held within [least * 1e-6, least]; least is 1e-6 or more."""
    floor = max(least, 1e-6)
    held = lambda c: F.greatest(F.least(c, F.lit(floor)), F.lit(floor * 1e-6))
    return F.when(share >= least, 1.0).otherwise(held(share) / F.least(held(prior) + held(share), F.lit(floor)))


def rank_64k(score: Column) -> Column:
    """A score as 0 to 65,535 by its double logarithm."""
    value = F.log(F.log(score + F.lit(2.718281828459045))) * 65535 / F.log(F.log(F.lit(1.1 + 2.718281828459045)))
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(65535.0), value))).cast("int")

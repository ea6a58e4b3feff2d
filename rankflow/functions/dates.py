"""Days and ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: day 0.
DAY_ZERO = "2009-01-01"


def day_version(day: Column) -> Column:
    """Days since day 0, never below 0."""
    return F.greatest(F.datediff(day, F.lit(DAY_ZERO).cast("date")), F.lit(0))


def day_of_version(version: Column) -> Column:
    return F.date_add(F.lit(DAY_ZERO).cast("date"), version.cast("int"))


def quantize_age(age: Column) -> Column:
    """Ages in days as multiples of a step that grows with the age. Up to 20: 1, 30: 2, 80: 5, 120: 10, then 15."""
    a = age.cast("long")
    step = F.when(a <= 20, 1).when(a <= 30, 2).when(a <= 80, 5).when(a <= 120, 10).otherwise(15).cast("long")
    return F.floor(a / step).cast("long") * step


def day_of_int(n: Column) -> Column:
    """The date of yyyymmdd; null for what is none."""
    s = n.cast("string")
    return F.when(s.rlike("^[0-9]{8}$"), F.try_to_date(s, "yyyyMMdd"))


def int_days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(day_of_int(later), day_of_int(earlier))

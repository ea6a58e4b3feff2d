"""64-bit masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))


def set_bit(mask: Column, n: int) -> Column:
    return mask.bitwiseOR(F.lit(_signed(1 << n)))


def clear_bit(mask: Column, n: int) -> Column:
    return mask.bitwiseAND(F.lit(_signed(~(1 << n) & (2**64 - 1))))


def has_bit(mask: Column, n: int) -> Column:
    return mask.bitwiseAND(F.lit(_signed(1 << n))) != 0


def has_common(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b) != 0


def names_of(mask: Column, names: list[str]) -> Column:
    """The names of the bits that are set, by their place."""
    parts = [F.when(has_bit(mask, i), F.lit(n)) for i, n in enumerate(names)]
    return F.array_join(F.array_compact(F.array(*parts)), "|")


def either(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def without(a: Column, b: Column) -> Column:
    """The bits of a that b lacks."""
    return a.bitwiseAND(F.bitwise_not(b))


def merge_tier(a: Column, b: Column, undecided: int = 0) -> Column:
    """The bits that both have; undecided where they have none in common."""
    both = a.bitwiseAND(b)
    return F.when(both != 0, both).otherwise(F.lit(undecided).cast("long"))


def bit_array(mask: Column, size: int) -> Column:
    """0 or 1 for each of the lowest bits."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.call_function("shiftright", mask, i).bitwiseAND(F.lit(1)).cast("int"))


def _signed(n: int) -> int:
    return n - 2**64 if n >= 2**63 else n

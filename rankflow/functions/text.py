"""Scalar functions over text. All take and return Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_key(c: Column) -> Column:
    """Blanks (all controls up to CR but TAB) are collapsed to one and trimmed; TAB stays."""
    return F.trim(F.regexp_replace(c, r"[\x00-\x08\x0A-\x0D\x20]+", " "))


def is_a_number(c: Column) -> Column:
    """Digits, commas and at most one point; no sign or exponent; at least one digit."""
    return c.rlike(r"^(?=.*[0-9])[0-9,]*\.?[0-9,]*$")


def to_number(c: Column) -> Column:
    """Decimal numbers with commas and exponents, or 0x and hexadecimal digits; null for anything else."""
    plain = F.trim(F.regexp_replace(c, ",", ""))
    hexadecimal = plain.rlike("^0[xX][0-9a-fA-F]{1,15}$")
    # conv only sees what is hexadecimal
    return F.when(hexadecimal, F.conv(F.when(hexadecimal, F.substring(plain, 3, 15)), 16, 10).cast("double")).otherwise(plain.try_cast("double"))


def common_prefix_length(a: Column, b: Column) -> Column:
    """Characters that two strings share from the start."""
    places = F.sequence(F.lit(1), F.greatest(F.least(F.length(a), F.length(b)), F.lit(1)))
    differs = F.filter(places, lambda i: (F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))) | (i > F.least(F.length(a), F.length(b))))
    return F.coalesce(F.get(differs, F.lit(0)) - 1, F.least(F.length(a), F.length(b)))


def count_text(c: Column) -> Column:
    """At least twelve digits, so that text order is number order; longer numbers stay whole."""
    return F.format_string("%012d", c.cast("long"))


#: The weights of a key's bytes by place, repeated sixteen times; later bytes do not count.
HASH_WEIGHTS = (61, 59, 53, 47, 43, 41, 37, 31, 29, 23, 17, 13, 11, 7, 3, 1)


def key_hash(c: Column) -> Column:
    """The 32-bit hash of a key's UTF-8 bytes by which stores deal keys to buckets: (hash + byte * weight) * 5 for each byte."""
    raw = F.hex(F.substring(F.encode(c, "UTF-8"), 1, 16 * len(HASH_WEIGHTS)))
    places = F.when(F.length(raw) > 0, F.sequence(F.lit(0), (F.length(raw) / 2 - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    weights = F.array(*map(F.lit, HASH_WEIGHTS))
    byte = lambda i: F.conv(F.substring(raw, i * 2 + 1, F.lit(2)), 16, 10).cast("long")
    step = lambda h, i: F.pmod((h + byte(i) * F.get(weights, i % len(HASH_WEIGHTS))) * 5, F.lit(1 << 32))
    return F.aggregate(places, F.lit(0).cast("long"), step)


def to_hex(c: Column) -> Column:
    return F.hex(c)


def from_hex(c: Column) -> Column:
    return F.try_to_binary(c, F.lit("hex"))


def floats(line: Column, separator: str = "\t") -> Column:
    """A delimited line as an array of doubles; null for what is no number."""
    return F.transform(F.split(line, separator, -1), lambda x: x.try_cast("double"))


def line_of(values: Column, separator: str = "\t") -> Column:
    return F.array_join(F.transform(values, lambda x: x.cast("string")), separator, "")


def is_config_line(line: Column, flat: bool = False) -> Column:
    """Lines that a settings file means: not blank, no # or ; comment; the flat form has no [sections] either."""
    return ~F.trim(line).rlike(r"^$|^[#;\[]" if flat else "^$|^[#;]")

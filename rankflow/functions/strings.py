"""Methods of text values. Places count from 0; a place beyond the text is its end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def contains(c: Column, what: str) -> Column:
    return _text(c).contains(what)


def starts_with(c: Column, what: str) -> Column:
    return _text(c).startswith(what)


def ends_with(c: Column, what: str) -> Column:
    return _text(c).endswith(what)


def index_of(c: Column, what: str, start: int = 0) -> Column:
    """The first place of a text at or after `start`, -1 if there is none."""
    return F.locate(what, _text(c), start + 1) - 1


def insert(c: Column, place: int, what: str) -> Column:
    return F.concat(F.substring(_text(c), 1, place), F.lit(what), F.substring(_text(c), F.lit(place + 1), F.length(_text(c))))


def remove(c: Column, place: int, count: int | None = None) -> Column:
    """Without `count` characters from a place on, or all from there on."""
    head = F.substring(_text(c), 1, place)
    return head if count is None else F.concat(head, F.substring(_text(c), F.lit(place + count + 1), F.length(_text(c))))


def substring(c: Column, place: int, count: int | None = None) -> Column:
    return F.substring(_text(c), F.lit(place + 1), F.length(_text(c)) if count is None else F.lit(count))


def pad_left(c: Column, width: int, sign: str = " ") -> Column:
    """At least so wide; longer texts stay whole."""
    return F.lpad(_text(c), F.greatest(F.length(_text(c)), F.lit(width)), F.lit(sign))


def pad_right(c: Column, width: int, sign: str = " ") -> Column:
    return F.rpad(_text(c), F.greatest(F.length(_text(c)), F.lit(width)), F.lit(sign))


def replace(c: Column, what: str, by: str) -> Column:
    return F.replace(_text(c), F.lit(what), F.lit(by))


def split(c: Column, marks: str) -> Column:
    """Parts between any of the marks, empty ones too."""
    return F.split(_text(c), "[" + "".join("\\" + m for m in marks) + "]", -1)


def trim(c: Column, signs: str = " \t\r\n") -> Column:
    return F.btrim(_text(c), F.lit(signs))


def normalize(c: Column) -> Column:
    """In lower case, trimmed, white space as single blanks."""
    return F.lower(F.trim(F.regexp_replace(_text(c), r"\s+", " ")))


def join(separator: str, *parts: Column) -> Column:
    return F.array_join(F.array(*map(_text, parts)), separator)


def checksums(c: Column) -> Column:
    """crc32 and SHA prefixes of a value's bytes."""
    return F.struct(F.crc32(c).alias("crc32"), F.md5(c).alias("md5"), F.sha1(c).alias("sha1"), F.sha2(c, 256).alias("sha256"))

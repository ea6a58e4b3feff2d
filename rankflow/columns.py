"""Column expressions: names or $n (1-based), joined by +."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(text: str) -> list[str]:
    """'$1+name' -> ['$1', 'name']; ValueError for anything else."""
    parts = [p.strip() for p in text.split("+")]
    if not parts or any(not p or re.fullmatch(r"\$0*|\$.*\D.*", p) for p in parts):
        raise ValueError(f"not a column expression: {text!r}")
    return parts


def is_positional(text: str) -> bool:
    return "$" in text


def resolve(text: str, available: list[str]) -> list[str]:
    """The columns that an expression names; names match whatever their case."""
    by_name = {c.lower(): c for c in available}
    out = []
    for part in parse(text):
        if part[0] == "$":
            n = int(part[1:])
            if n > len(available):
                raise ValueError(f"{part}: there are {len(available)} columns")
            out.append(available[n - 1])
        elif part.lower() in by_name:
            out.append(by_name[part.lower()])
        else:
            raise ValueError(f"no column {part!r} in {available}")
    return out


def text_of(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def joined(names: list[str]) -> Column:
    return text_of(names[0]) if len(names) == 1 else F.concat_ws("\t", *[text_of(n) for n in names])


def field(line: Column, n: int, separator: str = "\t") -> Column:
    """The n-th field (from 1) of a delimited line, '' where the line is shorter."""
    return F.coalesce(F.get(F.split(line, re.escape(separator), -1), F.lit(n - 1)), F.lit(""))

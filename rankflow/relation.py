"""The value that the algebra's operators pass on: a DataFrame with key columns. Relations never change."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a relation's rows are: bare keys, keyed counts, keyed strings, keyed edge maps, or tables.
KINDS = ("line", "count", "string", "map", "table")


@dataclass(frozen=True)
class Relation:
    df: DataFrame
    keys: tuple[str, ...] = ("key",)
    kind: str = "table"
    name: str = "source"
    ordering: str | None = None  # '+', '-' or unknown

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind of relation: {self.kind}")
        if missing := [k for k in self.keys if k not in self.df.columns]:
            raise ValueError(f"key columns {missing} are not in {self.df.columns}")

    def key(self) -> Column:
        """The key as one string: key columns joined by TAB, missing ones as ''."""
        parts = [F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("")) for k in self.keys]
        return parts[0] if len(parts) == 1 else F.concat_ws("\t", *parts)

    def with_df(self, df: DataFrame, **changes) -> Relation:
        return replace(self, df=df, **changes)

    def columns(self) -> list[str]:
        return self.df.columns

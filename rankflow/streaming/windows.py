"""The algebra over streams: windowed counts with watermarks, and running reductions. The same functions serve batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(df: DataFrame, time: str, keys: list[str], size: str, slide: str | None = None, late: str = "10 minutes", value: str | None = None) -> DataFrame:
    """(start, keys, n[, total]) of tumbling or sliding windows; rows later than the watermark are dropped from streams."""
    stamped = df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    sums = [F.count(F.lit(1)).alias("n")] + ([F.sum(value).alias("total")] if value else [])
    out = stamped.groupBy(F.window(time, size, slide or size), *keys).agg(*sums)
    return out.select(F.col("window.start").alias("start"), *[c for c in out.columns if c != "window"])


def sessions(df: DataFrame, time: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """(key, start, finish, n): runs of rows without a gap."""
    stamped = df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    out = stamped.groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("finish"), "n")


def running_counts(df: DataFrame, key: str, amount: str) -> DataFrame:
    """A stream's reduction by key: each trigger gives the new sums of the keys that it saw."""

    def fold(k: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total = state.get[0] if state.exists else 0
        total += int(sum(r[amount].sum() for r in rows))
        state.update((total,))
        yield pd.DataFrame({"key": [str(k[0])], "count": [total]})

    return df.groupBy(key).applyInPandasWithState(fold, "key string, count long", "total long", "update", GroupStateTimeout.NoTimeout)

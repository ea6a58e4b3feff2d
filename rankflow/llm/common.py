"""What the training-data operators share: sizes, ids, small numpy helpers. Tables in the shared folder are rankflow.storage's."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.storage import drop, materialize, new_path, shared_dir, stored

__all__ = ["NULL_ID", "buckets_for", "drop", "id_and_text", "id_back", "input_bytes", "materialize", "new_path", "ranges", "shared_dir", "stored"]

#: A missing doc_id takes part under this id and comes back as null.
NULL_ID = -(2**63)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of df's size; only used to choose numbers of buckets."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def buckets_for(df: DataFrame, mb: float, least: int = 8) -> int:
    """So many buckets that each holds about mb megabytes of df."""
    return int(min(1_000_000, max(least, -(-min(input_bytes(df), 2**60) // int(mb * 1e6)))))


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id (never null, see NULL_ID) and text ('' for null), whatever other columns there are."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def id_back(column: str = "doc_id"):
    """The doc_id as it came: null for NULL_ID."""
    return F.when(F.col(column) != NULL_ID, F.col(column)).alias(column)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (lengths[0] of them), then the same for the next."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)

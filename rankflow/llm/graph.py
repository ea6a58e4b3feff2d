"""Connected components of links between documents, by alternating large and small stars.

Where there are no more than ONE_TASK links (rows of two ids, a bound that is counted, not estimated), one task finds the components of
them all, which saves the rounds' joins; the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.llm.common import drop, stored

#: Links that one task may hold: 16 bytes each.
ONE_TASK = 200_000


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    a, b = (np.concatenate([h[k] for h in held]) if held else np.zeros(0, np.int64) for k in (0, 1))
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(a):  # roots only fall: the smaller root of each link's ends, then the roots' own
        old = root.copy()
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, old[a], least)
        np.minimum.at(root, old[b], least)
        while (root != (up := root[root])).any():
            root = up
        if (old == root).all():
            break
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(nodes[root], pa.int64())], ["node", "component"])


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long) -> (node, component): the smallest node reachable. Nodes without a link to another are left out.

    Rounds join on the node with AQE free to split hubs; each round is written to the shared folder, and the one before is
    deleted. Rounds grow with the logarithm of the longest chain.

    Defined cases: a link with a null end links nothing; a link of a node with itself, and repeated links, change nothing;
    no links give an empty result; other columns are ignored.
    """
    spark = links.sparkSession
    edges, path = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = _mark(edges)
    if mark[0] <= ONE_TASK:
        return edges.coalesce(1).mapInArrow(_in_one_task, "node long, component long")
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))  # here b < a
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges, new = stored(small.unionAll(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "links")
        drop(spark, path)
        path, now = new, _mark(edges)
        if now == mark:
            return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        mark = now


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.hash("b", "a"))).first())

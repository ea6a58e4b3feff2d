"""Sums over the pairs of a query's rows, for queries of any size.

A query's rows are placed by an order and cut into tiles. Two tiles are a task's piece of work: it takes their rows' labels and
scores as vectors, works off all their pairs in pieces, and gives one sum per row (or per query), never a pair. A row is so sent
once for each tile of its query, not once for each row. Tiles that hold one label between them have no pairs and are not paired;
where only pairs that touch the first places count, one side is of the first tiles, so work is linear in the query.

Places within queries come from a window where the largest query is measured to have no more rows than ONE_TASK, else from ranges over all rows
that are written once; then no query is held by one task anywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankflow.storage import numbered_rows

#: Rows of a tile, and of one query that a window may place.
TILE, ONE_TASK = 1024, 100_000
#: Pairs that a task works off at once.
PAIRS = 1 << 19
#: Rows that a task sorts by group, or so: its memory does not grow with the input.
TASK_ROWS = 250_000


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df dealt by columns to tasks of about TASK_ROWS rows: windows and aggregates by these need no other shuffle, and none holds more than its share (or one group)."""
    return df.repartition(max(1, -(-df.count() // TASK_ROWS)), *[F.col(f"`{c}`") for c in by])


def largest_group(df: DataFrame, group: str) -> int:
    return df.groupBy(group).count().agg(F.max("count")).first()[0] or 0


def placed(df: DataFrame, group: str, order: list[tuple[str, bool]], largest: int | None = None, name: str = "_place") -> DataFrame:
    """df with each row's place in its group from 0, by (column, descending). largest: rows of the largest group, if they are known."""
    if largest is None:
        largest = largest_group(df, group)
    if largest <= ONE_TASK:
        by = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_first() for c, down in order]
        return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*by)) - 1)
    # Ranges sort upwards: what is to fall is negated.
    turned = df.withColumns({f"_by{i}": -F.col(c) if down else F.col(c) for i, (c, down) in enumerate(order)})
    rows = numbered_rows(turned, [group, *[f"_by{i}" for i in range(len(order))]], "_all").drop(*[f"_by{i}" for i in range(len(order))])
    first = rows.groupBy(group).agg(F.min("_all").alias("_first"))
    return rows.join(first, group).withColumn(name, F.col("_all") - F.col("_first")).drop("_all", "_first")


def tiles(rows: DataFrame, group: str, label: str, tile: int = TILE, lead: int | None = None) -> DataFrame:
    """rows (with _place) once for each pair of tiles that they are in: _left, _right, _tile. lead: only pairs with one of the first so many places."""
    own = rows.withColumn("_tile", F.expr(f"cast(_place div {tile} as int)"))
    stats = own.groupBy(group, "_tile").agg(F.min(label).alias("_lo"), F.max(label).alias("_hi"))
    a = stats.select(F.col(group).alias("_tg"), F.col("_tile").alias("_left"), F.col("_lo").alias("_lo1"), F.col("_hi").alias("_hi1"))
    if lead is not None:
        a = a.where(F.col("_left") * tile < lead)
    b = stats.select(F.col(group).alias("_th"), F.col("_tile").alias("_right"), F.col("_lo").alias("_lo2"), F.col("_hi").alias("_hi2"))
    both = a.join(b, F.col("_tg").eqNullSafe(F.col("_th")) & (F.col("_left") <= F.col("_right")) & (F.greatest("_hi1", "_hi2") > F.least("_lo1", "_lo2")))
    ends = both.select("_tg", "_left", "_right", F.explode(F.array_distinct(F.array("_left", "_right"))).alias("_end"))
    return own.join(ends, F.col(group).eqNullSafe(F.col("_tg")) & (F.col("_tile") == F.col("_end"))).drop("_tg", "_end")


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (lengths[0] of them), then the same for the next."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)


def _pairs_of(starts: np.ndarray, sizes: np.ndarray, lefts: np.ndarray, same: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, b) of all pairs of some groups of rows, at most about PAIRS at once: a of the left tile, b of the right one, or behind a in the same."""
    rows = _ranges(starts, lefts)
    ends = np.repeat(starts + sizes, lefts)
    first = np.where(np.repeat(same, lefts), rows + 1, np.repeat(starts + lefts, lefts))
    number = ends - first
    at = np.cumsum(number)
    low = 0
    while low < len(rows):
        high = max(low + 1, int(np.searchsorted(at, (at[low - 1] if low else 0) + PAIRS, "right")))
        yield np.repeat(rows[low:high], number[low:high]), _ranges(first[low:high], number[low:high])
        low = high


def _worked(columns: list[str], kernel: Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]], named: bool):
    """Rows sorted by tile pair -> what the kernel adds up. Tile pairs of small queries are worked off together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def result(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
            n = table.num_rows
            sizes = np.diff(np.append(starts, n))
            left, right, tile = (table.column(c).to_numpy() for c in ("_left", "_right", "_tile"))
            lefts, same = np.add.reduceat((tile == left).astype(np.int64), starts), (left == right)[starts]
            values = {c: table.column(c).to_numpy() for c in columns}
            of = np.repeat(np.arange(len(starts)), sizes)
            sums: list[np.ndarray] | None = None
            for a, b in _pairs_of(starts, sizes, lefts, same):
                made = kernel(values, a, b, of)
                sums = made if sums is None else [x + y for x, y in zip(sums, made, strict=True)]
            names = table.column("_group").take(pa.array(starts)) if named else table.column("_id")
            return pa.RecordBatch.from_arrays([names.combine_chunks(), *[pa.array(x) for x in sums or []]], ["_group" if named else "_id", *OUT[named]])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
            one, two = table.column("_key1").to_numpy(), table.column("_key2").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]))
            last = int(starts[-1])  # a tile pair that may go on
            held = table.slice(last)
            if last:
                yield result(table.slice(0, last).combine_chunks(), starts[:-1])
        if held is not None:
            yield result(held.combine_chunks(), np.zeros(1, np.int64))

    return run


#: What is summed up by row, and by query.
OUT = {False: ("r", "w"), True: ("pairs", "cost")}


def _one_tile(rows: DataFrame, group: str) -> DataFrame:
    """The same where every query is one tile: a pair of tiles is a query with two labels, whose rows a window brings together, if they are not yet."""
    whole = Window.partitionBy(group)
    labels = rows.withColumns({"_lo": F.min("_y").over(whole), "_hi": F.max("_y").over(whole)})
    return labels.where("_lo < _hi").withColumns({c: F.lit(0) for c in ("_left", "_right", "_tile")}).drop("_lo", "_hi")


def _sent(rows: DataFrame, group: str, columns: list[str], tile: int, lead: int | None, named: bool, single: bool) -> DataFrame:
    """Rows once for each pair of tiles, those of a pair side by side in one task. Pairs are told by two hashes of query and tiles."""
    sent = _one_tile(rows, group) if single else tiles(rows, group, "_y", tile, lead)
    key = [F.xxhash64(group, "_left", "_right").alias("_key1"), F.xxhash64(F.lit(1), group, "_left", "_right").alias("_key2")]
    own = [F.col(group).alias("_group")] if named else []
    sent = sent.select(*key, "_left", "_right", "_tile", *own, *columns)
    return (sent if single else sent.repartition("_key1", "_key2")).sortWithinPartitions("_key1", "_key2", "_tile")


def _gradients(v: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, of: np.ndarray) -> list[np.ndarray]:
    sign = np.sign(v["_y"][a] - v["_y"][b])
    on = sign != 0
    a, b, sign = a[on], b[on], sign[on]
    p = 1 / (1 + np.exp(np.minimum(2 * sign * (v["_f"][a] - v["_f"][b]), 700)))
    g, h = 2 * p * sign, 4 * p * (1 - p)
    if "_g" in v:
        size = np.abs((v["_g"][a] - v["_g"][b]) * (v["_d"][a] - v["_d"][b])) / np.maximum(v["_best"][a], 1e-12)
        g, h = g * size, h * size
    n = len(of)
    return [np.bincount(a, g, n) - np.bincount(b, g, n), np.bincount(a, h, n) + np.bincount(b, h, n)]


def gradients(rows: DataFrame, group: str, tile: int = TILE, lead: int | None = None, largest: int | None = None) -> DataFrame:
    """(_id, r, w): sums of gradients and curvatures of the pair cost ln(1 + exp(-2 d)), over the pairs of rows with different labels.

    rows: group, _id, _y, _f, _place; with _g, _d, _best a pair weighs |differences of gain and discount| over the query's best.
    largest: rows of the largest query at most, if known; where they fit into a tile, no row is sent twice.
    """
    single = largest is not None and largest <= tile
    columns = [c for c in ("_id", "_y", "_f", "_g", "_d", "_best") if c in rows.columns]
    sent = _sent(rows.select(group, "_place", *columns), group, columns, tile, lead, False, single)
    made = sent.mapInArrow(_worked(columns, _gradients, False), "_id long, r double, w double")
    return made if single else made.groupBy("_id").agg(F.sum("r").alias("r"), F.sum("w").alias("w"))


def _costs(v: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, of: np.ndarray) -> list[np.ndarray]:
    sign = np.sign(v["_y"][a] - v["_y"][b])
    on = sign != 0
    a, b = a[on], b[on]
    d = 2 * sign[on] * (v["_f"][a] - v["_f"][b])
    n = int(of[-1]) + 1
    return [np.bincount(of[a], minlength=n).astype(np.int64), np.bincount(of[a], np.maximum(-d, 0) + np.log1p(np.exp(-np.abs(d))), n)]


def costs(df: DataFrame, group: str, label: Column, score: Column, tile: int = TILE) -> DataFrame:
    """(group, pairs, cost): the number of a query's pairs with different labels, and the sum of ln(1 + exp(-2 d)) over them."""
    slim = df.select(F.col(group), label.cast("double").alias("_y"), score.cast("double").alias("_f"))
    slim = slim.where(F.col("_y").isNotNull() & F.col("_f").isNotNull())
    largest = largest_group(slim, group)
    single = largest <= tile
    rows = dealt(slim, group) if single else placed(slim, group, [("_y", True), ("_f", True)], largest)
    made = _sent(rows, group, ["_y", "_f"], tile, None, True, single).mapInArrow(_worked(["_y", "_f"], _costs, True), f"_group {rows.schema[group].dataType.simpleString()}, pairs long, cost double")
    if single:
        return made.withColumnRenamed("_group", group)
    return made.groupBy(F.col("_group").alias(group)).agg(F.sum("pairs").alias("pairs"), F.sum("cost").alias("cost"))

"""Compression of vectors to codes: a codebook for each part, nearest entries found by annular norm pruning.

Components become whole numbers, floor(scale * x); a vector is cut into equal parts, and each part is named by the nearest
entry of its position's codebook. A codebook starts as that part of the vectors with the smallest ids; each round assigns
every part and replaces each entry by the floored mean of its parts. All distances and means are exact integers.

Nearest entries: a codebook's entries are sorted by norm. By the triangle inequality an entry nearer than the best so far
has a norm within that distance of the part's own, so binary searches give the interval of entries that may still be nearer or
tie. It is worked off outwards from the entry of the closest norm, in windows that double; each window's best narrows the
interval, and whatever stays in it is evaluated exactly, both ends included. No other entry is looked at.

A round is one pass over the vectors: a task sums its own parts by entry, and at most parts x entries rows of a task are
shuffled and summed again, so hot entries don't matter. Only codebooks reach the driver, parts x entries rows of bounded
width. The codes of all vectors are written once for the sums by label; these are joined back by a shuffle that adaptive execution
turns into a broadcast where they are measured to be small, or splits where one label holds much of the rows.

Defined cases: null vectors and those with null, NaN or infinite components are dropped; a null vec_id is the smallest id; rows that
repeat an id start the codebooks in the order of their vectors; fewer rows than entries give fewer entries; equal
distances go to the lower index; vectors shorter than the longest one, or of a length that the parts don't divide, are read as if zeros
followed (an empty one is all zeros); scaled components beyond +-2^30 / sqrt(length) (at 64 components, 2^27) count as that bound, so that
no distance exceeds a long; null labels are one label; a label's sum beyond a long is null; an empty table gives an
empty result; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from rankflow.llm.common import materialize, ranges

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Numbers that one step of the search holds at most.
_STEP = 1 << 21


@dataclass(frozen=True)
class Codebooks:
    """entries: parts x entries x part width, whole numbers; width: components of a whole vector, padding included; scale: their unit."""

    entries: np.ndarray
    width: int
    scale: int = SCALE

    def sha256(self) -> str:
        """Of all components in decimal by part, entry and position, parted by commas; lowercase hex."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _usable(name: str = "embedding"):
    return F.col(name).isNotNull() & ~F.exists(name, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))


def _base(vectors: DataFrame, label: str | None) -> DataFrame:
    """vec_id, label and embedding of the usable rows."""
    of_label = F.col(f"`{label}`") if label else F.lit(None).cast("int")
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), of_label.alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return base.where(_usable())


def whole_numbers(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """A list column's components times scale, floored: rows x width, zeros after the end of a vector."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    bound = (1 << 30) // (math.isqrt(max(width, 1) - 1) + 1)
    with np.errstate(over="ignore"):
        numbers = np.clip(np.floor(values * float(scale)), -bound, bound).astype(np.int64)
    if (sizes == width).all():
        return numbers.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = numbers
    return out


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each point's nearest entry (the lower index of equal ones) and the squared distance."""
    step = max(1, _STEP // max(1, entries.size))
    found = [_nearest(points[at : at + step], entries) for at in range(0, len(points), step)] or [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norms = np.sqrt((entries * entries).sum(1))
    order = np.argsort(norms, kind="stable")
    norms, entries = norms[order], entries[order]
    own = np.sqrt((points * points).sum(1))
    above = np.clip(np.searchsorted(norms, own), 0, len(norms) - 1)
    below = np.maximum(above - 1, 0)
    low = np.where(np.abs(own - norms[below]) < np.abs(norms[above] - own), below, above)
    high = low + 1
    best, chosen = ((points - entries[low]) ** 2).sum(1), order[low]
    open_, step = np.arange(len(points)), 1
    while len(open_):
        reach = np.sqrt(best[open_])
        reach += 1e-9 * (own[open_] + reach) + 1e-9  # more than the rounding of both roots: nothing that ties is left out
        first, stop = np.searchsorted(norms, own[open_] - reach, "left"), np.searchsorted(norms, own[open_] + reach, "right")
        start = np.minimum(np.maximum(first, low[open_] - step), low[open_])
        end = np.maximum(np.minimum(stop, high[open_] + step), high[open_])
        sizes = end - start
        at = ranges(start, sizes)
        distance = ((points[np.repeat(open_, sizes)] - entries[at]) ** 2).sum(1)
        cuts = np.cumsum(sizes) - sizes
        least = np.minimum.reduceat(distance, cuts)
        best[open_] = least
        chosen[open_] = np.minimum.reduceat(np.where(distance == np.repeat(least, sizes), order[at], len(order)), cuts)
        low[open_], high[open_] = start, end
        open_ = open_[(start > first) | (end < stop)]
        step *= 2
    return chosen, best


def _assigned(column: pa.Array, books: Codebooks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows x parts: codes and squared distances; and the parts themselves, rows x parts x width."""
    parts = len(books.entries)
    cut = whole_numbers(column, books.width, books.scale).reshape(len(column), parts, books.width // parts)
    codes, errors = np.zeros((len(column), parts), np.int64), np.zeros((len(column), parts), np.int64)
    for p in range(parts):
        codes[:, p], errors[:, p] = nearest(cut[:, p], books.entries[p])
    return codes, errors, cut


def _summed(books: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.entries.shape
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            codes, _, cut = _assigned(batch.column(0), books)
            for p in range(parts):
                np.add.at(sums[p], codes[:, p], cut[:, p])
                counts[p] += np.bincount(codes[:, p], minlength=entries)
        p, e = np.nonzero(counts)
        lists = pa.array(sums[p, e].tolist(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), lists], ["part", "entry", "n", "sums"])

    return run


def learn(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks of all usable vectors; None where there are none."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hexadecimal digits: 1 to 256 entries")
    base = _base(vectors, None)
    longest = base.agg(F.max(F.size("embedding")).alias("n")).first().n
    if longest is None:
        return None
    width = -(-longest // parts) * parts
    smallest = base.orderBy(F.col("vec_id").asc_nulls_first(), "embedding").limit(entries).collect()  # at most `entries` rows
    start = pa.array([r.embedding for r in smallest], pa.list_(pa.float64()))
    first = whole_numbers(start, width, scale).reshape(len(smallest), parts, width // parts)
    books = Codebooks(first.transpose(1, 0, 2).copy(), width, scale)
    for _ in range(rounds):
        own = base.select("embedding").mapInArrow(_summed(books), "part int, entry int, n long, sums array<long>")
        whole = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(width // parts)]
        new = books.entries.copy()
        for r in own.groupBy("part", "entry").agg(F.sum("n").alias("n"), *whole).collect():  # at most parts x entries rows
            new[r.part, r.entry] = [int(s) // r.n for s in r[3:]]
        books = Codebooks(new, width, scale)
    return books


def encode(vectors: DataFrame, books: Codebooks, label: str | None = "label") -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error (squared distance) of each usable vector."""
    base = _base(vectors, label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors, _ = _assigned(batch.column(2), books)
            texts = [row.tobytes().hex() for row in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(errors.sum(1))], ["vec_id", "label", "code", "error"])

    schema = StructType([*base.schema.fields[:2], StructField("code", StringType()), StructField("error", LongType())])
    return base.mapInArrow(run, schema)


def decoded(coded: DataFrame, books: Codebooks) -> DataFrame:
    """coded with embedding: the vector that a code stands for, entries taken at the middle of their whole numbers."""
    table = ((books.entries + 0.5) / books.scale).astype(np.float64)
    places = np.arange(len(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("code")
            raw = "".join(batch.column(at).to_pylist())
            codes = np.frombuffer(bytes.fromhex(raw), np.uint8).reshape(batch.num_rows, len(table))
            rows = table[places, codes].reshape(batch.num_rows, -1)
            yield batch.append_column("embedding", pa.array(list(rows), pa.list_(pa.float64())))

    return coded.mapInArrow(run, StructType([*coded.schema.fields, *coded.sparkSession.createDataFrame([], "embedding array<double>").schema.fields]))


def vector_codes(vectors: DataFrame, label: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """One row per usable vector: vec_id, code, error, label_error, codebooks_sha256."""
    books = learn(vectors, parts, entries, rounds, scale)
    if books is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = materialize(encode(vectors, books, label), "codes")
    totals = coded.groupBy("label").agg(F.try_sum("error").alias("label_error"))
    joined = coded.alias("c").join(totals.alias("t"), F.col("c.label").eqNullSafe(F.col("t.label")))
    return joined.select("c.vec_id", "c.code", "c.error", "t.label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def vector_codes_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same in DuckDB's SQL, for vectors of one length that the parts divide."""
    steps = [
        f"""WITH v AS (SELECT vec_id, label, embedding FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, label, part, list_transform(embedding[part * len(embedding) // {parts} + 1 : (part + 1) * len(embedding) // {parts}],
  lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS c FROM v, range({parts}) AS t(part)),
b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, c FROM p QUALIFY entry < {entries})"""
    ]
    for k in range(rounds + 1):
        steps.append(
            f"""d{k} AS (SELECT p.vec_id, p.label, p.part, any_value(p.c) AS c,
  min(struct_pack(d := list_sum(list_transform(range(1, len(p.c) + 1), lambda i: (p.c[i] - b.c[i]) * (p.c[i] - b.c[i])))::BIGINT, e := b.entry)) AS best
 FROM p JOIN b{k} b USING (part) GROUP BY ALL)"""
        )
        if k < rounds:
            steps.append(
                f"""m{k} AS (SELECT part, best.e AS entry, i, sum(c[i])::BIGINT AS s, count(*) AS n FROM d{k}, (SELECT unnest(range(1, (SELECT max(len(c)) FROM p) + 1)) AS i) GROUP BY ALL),
n{k} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM m{k} GROUP BY ALL),
b{k + 1} AS (SELECT part, entry, coalesce(n{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN n{k} USING (part, entry))"""
            )
    steps.append(
        f"""h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds}),
o AS (SELECT vec_id, label, string_agg(lpad(lower(to_hex(best.e)), 2, '0'), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM d{rounds} GROUP BY vec_id, label)"""
    )
    return ",\n".join(steps) + "\nSELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM o, h"

"""Tables of delimited text whose quoted items may hold line ends, read in splits.

A line end parts records unless it lies inside of quotes, which only all text before it tells. Each split of a file is
therefore read twice. The first pass finds, for both states at its beginning (inside of quotes or not), the state at its end: a row for each split,
from which the driver, who plans the splits anyway, derives every split's first state in order. The second pass reads the
splits with those states: records that lie in one split are passed on as they are; of one that crosses splits, each
split gives its fragment, and the fragments of a record are joined by a shuffle of these alone. Records become columns in the
JVM. Where the first pass finds no quoted line end at all, Spark's own line-wise reader does the rest.

The splits of both passes must be the same. They depend on the number of cores that Spark sees when it plans, so this number is pinned
(spark.sql.files.minPartitionNum) unless the session sets it; a split that the first pass has not seen is an error.

Quotes count where an item begins; inside of an item that does not begin with one they are text. A quote inside of a quoted item is doubled.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_PIN = "spark.sql.files.minPartitionNum"


def ends_inside(line: str, separator: str, inside: bool) -> bool:
    """Whether the end of a line lies inside of quotes, where its beginning does or begins an item."""
    at = 0
    while True:
        if inside:
            k = line.find('"', at)
            if k < 0:
                return True
            if line.startswith('"', k + 1):
                at = k + 2
                continue
            inside, at = False, k + 1
        else:
            while at < len(line) and line[at] in " \t" and line[at] != separator:
                at += 1
            if line.startswith('"', at):
                inside, at = True, at + 1
                continue
        k = line.find(separator, at)
        if k < 0:
            return False
        at = k + 1


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Array]]:
    """(file, start of the split, its lines or some of them), in order."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        file, start, value = batch.columns
        new = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(start[1:], start[:-1])) if n > 1 else pa.array([], pa.bool_())
        cuts = [0, *(np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield file[a].as_py(), start[a].as_py(), value[a:b]


def _quoted(lines: pa.Array) -> list[int]:
    """Which lines hold a quote: no others change the state."""
    return np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False)).tolist()


def _summarized(separator: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # By split: the states at its end from both states at its beginning; whether a line end lies inside of quotes from outside;
        # whether a record begins in it from inside.
        found: dict[tuple[str, int], list[bool]] = {}
        for file, start, lines in _runs(batches):
            own = found.setdefault((file, start), [False, True, False, False])
            for i in _quoted(lines):
                line = lines[i].as_py()
                own[0], own[1] = ends_inside(line, separator, own[0]), ends_inside(line, separator, own[1])
                own[2] |= own[0]
                own[3] |= not own[1]
        rows = [(f, s, *own) for (f, s), own in found.items()]
        yield pa.RecordBatch.from_pylist([dict(zip(_SUMMARY.names, r, strict=True)) for r in rows], schema=_SUMMARY)

    return run


_SUMMARY = pa.schema([("file", pa.string()), ("start", pa.int64()), ("if_out", pa.bool_()), ("if_in", pa.bool_()), ("crosses", pa.bool_()), ("begins", pa.bool_())])


def first_states(rows: list[tuple]) -> dict[tuple[str, int], tuple[bool, int]]:
    """For each split: whether it begins inside of quotes, and the start of the split in which that record begins."""
    out = {}
    inside, owner, last = False, 0, None
    for file, start, if_out, if_in, _, begins in sorted(rows, key=lambda r: r[:2]):
        if file != last:
            inside, owner, last = False, start, file
        out[file, start] = inside, owner
        if not inside or begins:
            owner = start
        inside = if_in if inside else if_out
    return out


_RECORDS = "file string, owner long, start long, first boolean, value string"
_RECORD_TYPES = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())


def _records(separator: str, states: dict[tuple[str, int], tuple[bool, int]], fragments: bool):
    """Records that lie in one split; or, with fragments, the parts of all others. first: a file's first record that is not blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, inside, owner, unseen, held, out = ("", 0), False, 0, False, [], []

        def is_first(value: str) -> bool:
            nonlocal unseen
            if not unseen or not value.strip():
                return False
            unseen = False
            return True

        def close() -> None:
            """What is held: a whole record, or a part of one."""
            if held:
                value = "\n".join(held)
                first = owner == split[1] and is_first(value)
                if (not inside and owner == split[1]) != fragments:
                    out.append((split[0], owner, split[1], first, value))
                held.clear()

        def batch() -> pa.RecordBatch:
            rows = list(zip(*out, strict=True)) or [[]] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, _RECORD_TYPES, strict=True)], ["file", "owner", "start", "first", "value"])

        for file, start, lines in _runs(batches):
            if split != (file, start):
                close()
                split, unseen = (file, start), start == 0
                if split not in states:
                    raise ValueError(f"{file} was split differently at {start} in two passes: set {_PIN}")
                inside, owner = states[split]
            marks = _quoted(lines)
            if not marks and not inside:  # records of their own, all of them
                close()
                owner = start
                if not fragments:
                    n = len(lines)
                    first = [unseen and is_first(lines[i].as_py()) for i in range(n)] if unseen else [False] * n
                    yield pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array([start] * n, pa.int64()), pa.array([start] * n, pa.int64()), pa.array(first, pa.bool_()), lines], ["file", "owner", "start", "first", "value"])
                continue
            marked = set(marks)
            for i, line in enumerate(lines.to_pylist()):
                if not inside:
                    close()
                    owner = start
                held.append(line)
                if i in marked:
                    inside = ends_inside(line, separator, inside)
            if len(out) > 10_000:
                yield batch()
        close()
        yield batch()

    return run


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def quoted_records(spark: SparkSession, path: str | list[str], separator: str = ",") -> tuple[DataFrame | None, list[tuple]]:
    """(file, start, first, value): each record as text, and what the first pass found; None for the records where no line end is quoted."""
    if spark.conf.get(_PIN, None) is None:
        spark.conf.set(_PIN, str(spark.sparkContext.defaultParallelism))
    lines = _lines(spark, path)
    rows = [tuple(r) for r in lines.mapInArrow(_summarized(separator), "file string, start long, if_out boolean, if_in boolean, crosses boolean, begins boolean").collect()]  # a row a split
    states = first_states(rows)
    # A split whose end lies inside of quotes parts a record, or is the end of a file that never closes them.
    parted = any(if_in if states[file, start][0] else if_out for file, start, if_out, if_in, *_ in rows)
    if not parted and not any(r[4] for r in rows):
        return None, rows
    whole = lines.mapInArrow(_records(separator, states, False), _RECORDS).select("file", "start", "first", "value")
    if parted:
        parts = lines.mapInArrow(_records(separator, states, True), _RECORDS)
        pieces = F.array_sort(F.collect_list(F.struct("start", "value")))  # the parts of one record
        joined = parts.groupBy("file", "owner").agg(F.bool_or("first").alias("first"), F.array_join(F.transform(pieces, lambda x: x["value"]), "\n").alias("value"))
        whole = whole.unionByName(joined.select("file", F.col("owner").alias("start"), "first", "value"))
    return whole, rows


def _options(separator: str) -> dict[str, str]:
    return {"sep": separator, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}


def _first_record(spark: SparkSession, path: str | list[str], separator: str) -> str | None:
    """The first record of the first file that has any text."""
    files = sorted(spark.read.text(path).inputFiles())
    for f in files:
        taken: list[str] = []
        n = 8
        while True:
            rows = [r.value for r in spark.read.option("lineSep", "\n").text(f).limit(n).collect()]  # a few lines of a file's beginning
            inside, taken = False, []
            for line in rows:
                if not taken and not line.strip():
                    continue
                taken.append(line)
                inside = ends_inside(line, separator, inside)
                if not inside:
                    break
            if (taken and not inside) or len(rows) < n:
                break
            n *= 4
        if taken:
            return "\n".join(taken)
    return None


def _names(header: str, separator: str) -> list[str]:
    found = [c.strip() for c in next(csv.reader([header.rstrip("\r")] if "\n" not in header else header.splitlines(keepends=True), delimiter=separator, skipinitialspace=True))]
    low = [c.lower() for c in found]
    return [f"_c{i}" if not c else f"{c}{i}" if low.count(c.lower()) > 1 else c for i, c in enumerate(found)]


def quoted_table(spark: SparkSession, path: str | list[str], separator: str = ",", header: bool = True, schema: StructType | str | None = None) -> DataFrame:
    """The table's rows; all columns are text unless a schema is given. Blank lines are left out, and missing items null.

    header: each file's first record that is not blank holds names; those of the first file count.
    """
    records, _ = quoted_records(spark, path, separator)
    if records is None:
        reader = spark.read.options(**_options(separator)).option("header", header).option("enforceSchema", True)
        return (reader.schema(schema) if schema is not None else reader).csv(path)
    first = _first_record(spark, path, separator)
    if schema is None:
        names = _names(first or "", separator)
        if not header:
            names = [f"_c{i}" for i in range(len(names))]
        wanted = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    else:
        wanted = schema if isinstance(schema, str) else ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
    text: Column = F.regexp_replace("value", "\r$", "")
    rows = records.where(F.trim(text) != "")
    if header:
        rows = rows.where(~F.col("first"))
    return rows.select(F.from_csv(text, wanted, _options(separator)).alias("r")).select("r.*")

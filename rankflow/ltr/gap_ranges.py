"""Gap bins of features whose values are too many for one task: range by range, and composed.

Distinct values are written once in ranges. For one gap, what a range adds depends only on the bin that is open when it begins: on its
first value that lies a gap beyond that bin's start. From there on the starts follow. So a range is a step function from the start
before it to (number of starts, last start), of which only the values up to a gap beyond its first one can be the first, and those
that run into the same starts count together. Where values are evenly spaced few do, so functions stay in tables: tasks compose those of
FAN neighbours, then of FAN such blocks, and so on, and go back down the same way to learn where each range begins. A composed function
has no more steps than its first range, or as many ranges as a gap covers, has values. The driver holds a row a range.

The gap is the first of 1e-8, 2e-8, 4e-8 ... under which a feature has at most `most` starts. Every range counts the starts that it would
have by itself under each gap: more than those, or fewer by more than one, a range never has, so only gaps whose sum is within the number
of ranges of the limit need their functions to tell, up to one that fits so often into all values at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.storage import drop, ranged, stored

GAP = 1e-8
#: Ranges, or blocks of them, whose functions meet in one task.
FAN = 4

#: A function: last entries, starts and last starts of its steps (see function).
Steps = tuple[np.ndarray, np.ndarray, np.ndarray]


def opens(values: np.ndarray, start: float, gap: float, at: int = 0) -> int:
    """The place of the first value, from `at` on, that opens a bin after the one that begins at start."""
    at = max(at, int(np.searchsorted(values, start + gap)))
    while at < len(values) and values[at] - start < gap:  # the sum was rounded
        at += 1
    return at


def chain(values: np.ndarray, at: int, gap: float, most: int) -> list[int] | None:
    """Places of the starts from the one at `at` on; None for more than `most`."""
    rest = values[at:]
    if len(rest) <= most and (np.diff(rest) >= gap).all() and (rest[:-1] + gap <= rest[1:]).all():
        return list(range(at, len(values)))  # each opens a bin
    out = []
    while at < len(values):
        out.append(at)
        if len(out) > most:
            return None
        at = opens(values, float(values[at]), gap, at + 1)
    return out


def own_counts(values: np.ndarray, most: int) -> tuple[int, list[int]]:
    """(k, counts): starts of the values by themselves under GAP * 2^k, GAP * 2^(k+1) ..., up to the first gap with one; k is the first with at most `most`."""
    size = lambda k: len(found) if (found := chain(values, 0, GAP * 2.0**k, most)) is not None else None
    low, high = 0, 0
    while size(high) is None:
        low, high = high + 1, 2 * high + 1
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if size(mid) is not None else (mid + 1, high)
    counts = [size(low)]
    while counts[-1] > 1:
        counts.append(size(low + len(counts)))
    return low, counts


def _places(entries: np.ndarray, starts: np.ndarray, gap: float) -> np.ndarray:
    """For each start the place of the first entry that opens a bin after it."""
    at = np.searchsorted(entries, starts + gap)
    while (short := (at < len(entries)) & (entries[np.minimum(at, len(entries) - 1)] - starts < gap)).any():  # the sum was rounded
        at = at + short
    return at


def _joined(entry: np.ndarray, n: np.ndarray, last: np.ndarray) -> Steps:
    keep = np.append((n[1:] != n[:-1]) | (last[1:] != last[:-1]), True)
    return entry[keep], n[keep], last[keep]


def function(values: np.ndarray, gap: float) -> Steps:
    """Steps (last entry, starts, last start): what follows if the first start in the range is one of the values up to `last entry` and beyond the one before."""
    # Entries that a start before the range can have: values within a gap of the first, and the one after these.
    stop = min(len(values), opens(values, float(values[0]), gap) + 1)
    steps: list[Steps] = []  # (places of last entries, starts, places of last starts)
    # All chains at once: those that have met go on as one.
    at, ends, counts = np.arange(stop), np.arange(stop), 1
    while len(at):
        after = _places(values, values[at], gap)
        done = after >= len(values)
        steps.append((ends[done], np.full(int(done.sum()), counts), at[done]))
        at, ends, counts = after[~done], ends[~done], counts + 1
        if len(at):
            last = np.flatnonzero(np.append(at[1:] != at[:-1], True))  # chains are in order: equal ones are neighbours
            at, ends = at[last], ends[last]
    end, n, last = (np.concatenate(x) for x in zip(*steps, strict=True))
    order = np.argsort(end)
    return _joined(values[end[order]], n[order], values[last[order]])


def _after(steps: Steps, starts: np.ndarray, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """(starts, last start) of a range that begins while the bins of `starts` are open."""
    entry, n, last = steps
    at = _places(entry, starts, gap)
    none, at = at == len(entry), np.minimum(at, len(entry) - 1)
    return np.where(none, 0, n[at]), np.where(none, starts, last[at])


def apply(steps: Steps, start: float, gap: float) -> tuple[int, float]:
    """The same for one start."""
    n, last = _after(steps, np.array([start]), gap)
    return int(n[0]), float(last[0])


def composed(parts: list[Steps], first: float, gap: float) -> Steps:
    """The function of neighbouring ranges as of one, whose first value is `first`."""
    entry, n, last = parts[0]
    for part in parts[1:]:
        more, last = _after(part, last, gap)
        n = n + more
        if _places(entry[-1:], np.array([first]), gap)[0] == 1:  # a start before may lie within a gap of all so far
            to = int(_places(part[0], np.array([first]), gap)[0]) + 1
            entry, n, last = (np.concatenate([x, y[:to]]) for x, y in zip((entry, n, last), part, strict=True))
    return _joined(entry, n, last)


def _split(table: pa.Table) -> list[tuple[int, Steps]]:
    """[(at, function)] of the functions in a table, in order."""
    at, *steps = (table.column(c).to_numpy() for c in ("at", "entry", "n", "last"))
    order = np.lexsort((steps[0], at))
    at, steps = at[order], [x[order] for x in steps]
    starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return [(int(at[i]), tuple(x[i:j] for x in steps)) for i, j in zip(starts, np.append(starts[1:], len(at)), strict=True)]


def _begun(functions: DataFrame, firsts: dict[object, list[float]], ks: dict[object, list[int]], most: int | None) -> tuple[dict[tuple, float], dict[object, int]]:
    """({(feature, range): the start that is open before it}, {feature: k}): k is the first of its ks with at most `most` starts, or the last.

    functions: (feature, k, at, entry, n, last), the steps of each range.
    """
    spark, kind = functions.sparkSession, functions.schema["feature"].dataType.simpleString()
    columns, size = f"feature {kind}, k int, at int, entry double, n long, last double", max(map(len, firsts.values()))
    levels, paths = [], []

    def keep(df: DataFrame) -> None:
        df, path = stored(df, "gap-functions")
        levels.append(df.withColumn("up", F.expr(f"at div {FAN}")).groupBy("feature", "k", "up"))
        paths.append(path)

    keep(functions)
    while size > FAN:
        step = FAN ** len(levels)

        def block(key: tuple, table: pa.Table) -> pa.Table:
            feature, k, up = (x.as_py() for x in key)
            made = composed([x for _, x in _split(table)], firsts[feature][up * step], GAP * 2.0**k)
            n = len(made[0])
            head = [pa.array([feature] * n, key[0].type), pa.array([k] * n, pa.int32()), pa.array([up] * n, pa.int32())]
            return pa.Table.from_arrays([*head, *map(pa.array, made)], ["feature", "k", "at", "entry", "n", "last"])

        keep(levels[-1].applyInArrow(block, columns))
        size = -(-size // FAN)
    begin: dict[tuple, float | None] = {}  # (feature, k, block) -> the start that is open before it
    chosen: dict[object, int] = {}
    for level in reversed(levels):

        def entered(key: tuple, table: pa.Table) -> pa.Table:
            feature, k, up = (x.as_py() for x in key)
            rows, start = [], begin.get((feature, k, up))
            for at, own in _split(table) if chosen.get(feature, k) == k else []:
                rows.append({"feature": feature, "k": k, "at": at, "start": start, "n": 0})
                # The first value of all opens a bin.
                rows[-1]["n"], start = (int(own[1][0]), float(own[2][0])) if start is None else apply(own, start, GAP * 2.0**k)
            return pa.Table.from_pylist(rows, pa.schema([("feature", key[0].type), ("k", pa.int32()), ("at", pa.int32()), ("start", pa.float64()), ("n", pa.int64())]))

        found = level.applyInArrow(entered, f"feature {kind}, k int, at int, start double, n long").collect()  # a row a range or block
        if not chosen:
            totals: dict[tuple, int] = {}
            for r in found:
                totals[r.feature, r.k] = totals.get((r.feature, r.k), 0) + r.n
            chosen = {f: next((k for k in own if most is None or totals[f, k] <= most), own[-1]) for f, own in ks.items()}
        begin = {(r.feature, r.k, r.at): r.start for r in found}
    drop(spark, *paths)
    return {(f, at): start for (f, k, at), start in begin.items() if chosen[f] == k}, chosen


def start_rows(values: DataFrame, most: int | None) -> DataFrame:
    """(feature, value), distinct -> (feature, start), a row for each bin. most: None for as many as there are under GAP itself."""
    kind = values.schema["feature"].dataType
    name = kind.simpleString()
    parts = ranged(values.select("feature", "value"), ["feature", "value"], "gap-values")
    by_range = parts.groupBy("_part", "feature")
    sort = lambda t: np.sort(t.column("value").to_numpy())

    def counted(key: tuple, table: pa.Table) -> pa.Table:
        found = sort(table)
        k, counts = (0, []) if most is None else own_counts(found, most)
        schema = pa.schema([("feature", key[1].type), ("part", pa.int32()), ("k", pa.int32()), ("counts", pa.list_(pa.int32())), ("first", pa.float64()), ("last", pa.float64())])
        return pa.table({"feature": [key[1].as_py()], "part": [key[0].as_py()], "k": [k], "counts": [counts], "first": [float(found[0])], "last": [float(found[-1])]}, schema)

    ranges: dict[object, list] = {}
    for r in sorted(by_range.applyInArrow(counted, f"feature {name}, part int, k int, counts array<int>, first double, last double").collect(), key=lambda r: r.part):  # one row a range
        ranges.setdefault(r.feature, []).append(r)
    at = lambda r, k: None if k < r.k else r.counts[min(k - r.k, len(r.counts) - 1)]
    wanted: dict[object, list[int]] = {}
    for feature, own in ranges.items():
        k = max(r.k for r in own)
        while most is not None and sum(at(r, k) for r in own) - (len(own) - 1) > most:
            k += 1
        wanted[feature] = [k]
        span = own[-1].last - own[0].first
        # A gap has as many starts as it fits into all values, and one, at most; a range has one at least.
        while most is not None and sum(at(r, wanted[feature][-1]) for r in own) > most and span / (GAP * 2.0 ** wanted[feature][-1]) * (1 + 1e-9) >= most:
            wanted[feature].append(wanted[feature][-1] + 1)
    several = {f: ks for f, ks in wanted.items() if len(ranges[f]) > 1}
    begin: dict[tuple, tuple[int, float | None]] = {(f, own[0].part): (wanted[f][0], None) for f, own in ranges.items()}  # (feature, part) -> the gap, and the start that is open before the range
    if several:
        place = {(f, r.part): i for f in several for i, r in enumerate(ranges[f])}

        def stepped(key: tuple, table: pa.Table) -> pa.Table:
            feature, part = key[1].as_py(), key[0].as_py()
            found, made = sort(table), []
            schema = pa.schema([("feature", key[1].type), ("k", pa.int32()), ("at", pa.int32()), ("entry", pa.float64()), ("n", pa.int64()), ("last", pa.float64())])
            for k in several.get(feature, []):
                own = function(found, GAP * 2.0**k)
                n = len(own[0])
                head = [pa.array([feature] * n, key[1].type), pa.array([k] * n, pa.int32()), pa.array([place[feature, part]] * n, pa.int32())]
                made.append(pa.Table.from_arrays([*head, *map(pa.array, own)], schema=schema))
            return pa.concat_tables(made) if made else schema.empty_table()

        functions = by_range.applyInArrow(stepped, f"feature {name}, k int, at int, entry double, n long, last double")
        open_before, chosen = _begun(functions, {f: [r.first for r in ranges[f]] for f in several}, several, most)
        begin |= {(f, r.part): (chosen[f], open_before[f, i]) for f in several for i, r in enumerate(ranges[f])}

    def started(key: tuple, table: pa.Table) -> pa.Table:
        found = sort(table)
        k, start = begin[key[1].as_py(), key[0].as_py()]
        gap = GAP * 2.0**k
        own = chain(found, 0 if start is None else opens(found, start, gap), gap, len(found))
        return pa.table({"feature": pa.array([key[1].as_py()] * len(own), key[1].type), "start": pa.array(found[own], pa.float64())})

    return by_range.applyInArrow(started, f"feature {name}, start double")


def ranged_starts(values: DataFrame, most: int) -> DataFrame:
    """(feature, value), distinct -> (feature, starts)."""
    return start_rows(values, most).groupBy("feature").agg(F.array_sort(F.collect_list("start")).alias("starts"))  # at most `most` a feature

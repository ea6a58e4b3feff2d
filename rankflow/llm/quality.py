"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature, and each chosen pair of features, has a lookup table over bins. The tables are learned by cyclic
boosting: round by round, feature by feature, a tree of at most four leaves is fitted to the log-loss gradient over the
bins and added to the table at a small rate. Pairs are ranked by how much of the remaining gradient a coarse grid over
them explains, and boosted in the same way. A score is the sum of the tables' entries, so whole batches are scored by
adding gathered bins.

Features are counts and shares over the whole text; labels, language, source and ids are never among them. Learning
takes at most `sample` labelled rows (a documented bound), chosen by a hash of their id; scoring covers every row.

Defined cases: null text is empty and is scored like any other; labels that are null or neither 0 nor 1 are not
learned from, nor are those of ids without a document; several labels of one document count as several rows; repeated rows
are scored once each; texts of any length are read as a whole; of equally good splits the first counts; without any label
to learn from every score is 0.5; an empty table gives an empty result; quality_scores reads doc_id and text only,
keep_good keeps all columns, whatever they are called.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = (
    "log_bytes", "upper", "digits", "symbols", "bars", "periods", "commas", "lines", "beyond_ascii", "odd_bytes",
    "word_bytes", "long_words", "short_words", "distinct_words", "top_word", "repeated_lines", "top_line", "ended_words", "mixed_case_words", "zipf_words",
)
_BYTE = np.zeros((8, 256))
for _row, _bytes in enumerate((bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b"!#$%&*@^~<>=+_\\/{}[]|", b"|", b".", b",", bytes(range(128, 256)))):
    _BYTE[_row, list(_bytes)] = 1


def features(raw: bytes) -> list[float]:
    """The features of one text, in the order of FEATURES."""
    n = max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digits, symbols, bars, periods, commas, high = (_BYTE @ counts).tolist()
    words = raw.split()
    m = max(1, len(words))
    seen = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    by_line = Counter(lines)
    k = max(1, len(lines))
    sizes = np.fromiter(map(len, seen), np.int64, len(seen)) if seen else np.zeros(1, np.int64)
    times = np.fromiter(seen.values(), np.int64, len(seen)) if seen else np.zeros(1, np.int64)
    ended = sum(c for w, c in seen.items() if w[-1] in b"!$%&*#")
    mixed = sum(c for w, c in seen.items() if not w.islower() and not w.istitle() and not w.isupper())
    return [
        np.log1p(len(raw)), upper / max(1, upper + lower), digits / n, symbols / n, bars / m, periods / m, commas / m, counts[10] / m, high / n, float(counts[:9].sum() + counts[14:32].sum() + counts[127]) / n,
        n / m, float((times * (sizes > 12)).sum()) / m, float((times * (sizes <= 3)).sum()) / m, len(seen) / m, float(times.max()) / m, 1 - len(by_line) / k, max(by_line.values(), default=0) / k, ended / m, mixed / m, len(seen) / m**0.8,
    ]


def is_held_out(doc_id: object) -> bool:
    """Rows whose id has remainder 2 are never learned from."""
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


@dataclass
class AdditiveModel:
    """Tables over bins: base + sum of singles[f][bin] + sum of pairs[f, g][bin, bin], through the logistic function."""

    edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    singles: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        bins = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)]
        for f, table in enumerate(self.singles):
            total += table[bins[f]]
        for (f, g), table in self.pairs.items():
            total += table[self.coarse[f][bins[f]], self.coarse[g][bins[g]]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _step(grad: np.ndarray, weight: np.ndarray, least: float, depth: int = 2) -> np.ndarray:
    """A tree over ordered bins, given the gradient and curvature in each: the value of each bin."""
    if depth == 0 or len(grad) < 2:
        return np.full(len(grad), grad.sum() / (weight.sum() + 1.0))
    g, w = np.cumsum(grad)[:-1], np.cumsum(weight)[:-1]
    rest_g, rest_w = grad.sum() - g, weight.sum() - w
    gain = np.where((w >= least) & (rest_w >= least), g * g / (w + 1.0) + rest_g * rest_g / (rest_w + 1.0), -1.0)
    at = int(np.argmax(gain)) + 1
    if gain[at - 1] <= grad.sum() ** 2 / (weight.sum() + 1.0) + 1e-9:
        return _step(grad, weight, least, 0)
    return np.concatenate((_step(grad[:at], weight[:at], least, depth - 1), _step(grad[at:], weight[at:], least, depth - 1)))


def _step_pair(grad: np.ndarray, weight: np.ndarray, least: float) -> np.ndarray:
    """The same over a grid: one cut along either axis, then one along the other on each side."""
    best, out = -1.0, None
    for axis in (0, 1):
        g, w = (grad, weight) if axis == 0 else (grad.T, weight.T)
        line = _step(g.sum(1), w.sum(1), least, 1)
        at = int(np.argmax(line != line[0])) if (line != line[0]).any() else len(line)
        value = np.concatenate([np.broadcast_to(_step(a.sum(0), b.sum(0), least, 1), a.shape) for a, b in ((g[:at], w[:at]), (g[at:], w[at:])) if len(a)])
        explained = float((value * g).sum())
        if explained > best:
            best, out = explained, value if axis == 0 else value.T
    return out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, rate: float = 0.1, pairs: int = 8, pair_rounds: int = 60, grid: int = 8) -> AdditiveModel:
    """Learn the tables from features x and labels y (0 or 1)."""
    model = AdditiveModel()
    n, width = x.shape
    if not n or y.min() == y.max():
        model.edges = [np.zeros(0)] * width
        model.base = 0.0 if not n else (6.0 if y[0] else -6.0)
        return model
    share = float(y.mean())
    model.base = float(np.log(share / (1 - share)))
    least = 0.25 * max(2.0, n * 0.002)
    cells = []
    for f in range(width):
        edges = np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="higher"))
        model.edges.append(edges)
        cells.append(np.searchsorted(edges, x[:, f], side="right"))
        model.singles.append(np.zeros(len(edges) + 1))
        model.coarse.append((np.arange(len(edges) + 1) * grid // (len(edges) + 1)).astype(np.int64))
    total = np.full(n, model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f in range(width):
            g, w = slopes()
            size = len(model.singles[f])
            add = rate * np.clip(_step(np.bincount(cells[f], g, size), np.bincount(cells[f], w, size), least * 0.1), -4, 4)
            model.singles[f] += add
            total += add[cells[f]]
    g, w = slopes()
    flat = {}
    gains = []
    for a in range(width):
        for b in range(a + 1, width):
            cell = model.coarse[a][cells[a]] * grid + model.coarse[b][cells[b]]
            sums, weights = np.bincount(cell, g, grid * grid), np.bincount(cell, w, grid * grid)
            gains.append((float((sums * sums / (weights + 1.0)).sum()), a, b))
            flat[a, b] = cell
    chosen = [(a, b) for _, a, b in sorted(gains, reverse=True)[:pairs]]
    for key in chosen:
        model.pairs[key] = np.zeros((grid, grid))
    for _ in range(pair_rounds):
        for key in chosen:
            g, w = slopes()
            shape = lambda v: np.bincount(flat[key], v, grid * grid).reshape(grid, grid)  # noqa: E731, B023
            add = rate * np.clip(_step_pair(shape(g), shape(w), least * 0.1), -4, 4)
            model.pairs[key] += add
            total += add.ravel()[flat[key]]
    return model


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = np.array([features(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in batch.column("text").cast(pa.binary())], np.float64).reshape(-1, len(FEATURES))
        rest = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "text"]
        names = [name for name in batch.schema.names if name != "text"]
        lists = pa.FixedSizeListArray.from_arrays(pa.array(made.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([*rest, lists], [*names, "x"])


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the features of every document."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(_measure, "doc_id long, x array<double>")


def learn(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> AdditiveModel:
    """Fit on the labelled rows outside the held-out fold, at most `sample` of them, by the order of a hash of the id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)")
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    # Labels without a document take up no place in the sample.
    known = known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    chosen = known.withColumn("h", F.xxhash64("doc_id", "quality")).orderBy("h", "doc_id").limit(sample).select("doc_id", "quality")
    # The sample is bounded (16 bytes a row), so it may go to every task; the texts stay where they are.
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = text.mapInArrow(_measure, "doc_id long, quality int, x array<double>").toPandas().sort_values(["doc_id", "quality"])
    x = np.array(rows["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    return fit(x, rows["quality"].to_numpy(np.float64))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = 20_000) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = learn(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _measure(batches):
            x = batch.column(1).flatten().to_numpy().reshape(-1, len(FEATURES))
            score = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = base.mapInArrow(run, "doc_id long, score double, predicted int")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = 20_000) -> DataFrame:
    """The documents (all their columns) that score the threshold or more."""
    model = learn(docs, labels, sample)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([features((t or "").encode()) for t in text], np.float64).reshape(-1, len(FEATURES))))

    return docs.where(score(F.col("text").cast("string")) >= threshold)

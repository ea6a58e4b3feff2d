"""Feature transforms, BM25F and small networks, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def linear(x: Column, slope: float, intercept: float) -> Column:
    return slope * x + intercept


def log_linear(x: Column, slope: float, intercept: float) -> Column:
    return slope * F.log(F.greatest(x, F.lit(-0.99999)) + 1.0) + intercept


def rational(x: Column, slope: float, intercept: float, d: float) -> Column:
    return slope * F.try_divide(x, x + d) + intercept


def bucket(x: Column, low: float, high: float, with_low: bool = True, with_high: bool = False) -> Column:
    return ((x >= low if with_low else x > low) & (x <= high if with_high else x < high)).cast("double")


def idf(df_count: Column, n: float = 1e9) -> Column:
    """ln((n - df + 0.5) / (df + 0.5)) for terms in less than half of all documents, else 0."""
    return F.when(df_count < n / 2, F.log((n - df_count + 0.5) / (df_count + 0.5))).otherwise(0.0)


def field_tf(counts: list[Column], lengths: list[Column], weights: list[float], means: list[float], b: list[float]) -> Column:
    """The weighted term count over fields, each made up for its length."""
    parts = (w * c / (1 + k * (n / m - 1)) for c, n, w, m, k in zip(counts, lengths, weights, means, b, strict=True))
    return sum(parts, F.lit(0.0))


def bm25f(tfs: Column, idfs: Column, k: float = 1.2) -> Column:
    """Sum over a query's words (100 at most) of idf * tf / (k + tf)."""
    each = F.zip_with(F.slice(tfs, 1, 100), F.slice(idfs, 1, 100), lambda t, i: i * t / (k + t))
    return F.aggregate(each, F.lit(0.0), lambda s, x: s + x)


def log_bm25f(score: Column, slope: float, factor: float, intercept: float) -> Column:
    return slope * F.log(factor * score + 1.0) + intercept


def activated(x: Column, kind: str) -> Column:
    return {"linear": x, "tanh": F.tanh(x), "sigmoid": 1 / (1 + F.exp(-x))}[kind]


def network(inputs: list[Column], layers: list[tuple[list[list[float]], list[float], str]]) -> list[Column]:
    """A network's outputs: layers of (weights by node, biases, activation)."""
    for weights, biases, kind in layers:
        inputs = [activated(sum((w * x for w, x in zip(row, inputs, strict=True)), F.lit(float(bias))), kind) for row, bias in zip(weights, biases, strict=True)]
    return inputs


def softmax_mean(scores: list[Column], values: list[float]) -> Column:
    """Values weighted by the softmax of scores."""
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    weights = [F.exp(s - top) for s in scores]
    return sum((v * w for v, w in zip(values, weights, strict=True)), F.lit(0.0)) / sum(weights, F.lit(0.0))

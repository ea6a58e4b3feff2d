"""Gap bins by ranges, against the one-task pass."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankflow.ltr import gap_ranges, quantize


def one_task(values, most):
    return quantize.gap_bins(np.unique(np.array(values, float)), most)


SETS = {
    "even": [i / 7 for i in range(4000)],
    "whole": [float(i) for i in range(3000)],
    "random": np.random.default_rng(1).normal(size=4000).tolist(),
    "clusters": [c + d for c in np.random.default_rng(2).uniform(0, 1e6, 40) for d in np.random.default_rng(3).exponential(1e-3, 80)],
    "powers": [s * 1.5**e for e in range(-60, 60) for s in (-1, 1)] + [0.0],
    "tiny": [i * 1e-9 for i in range(3000)],
    "one": [3.5],
}


@pytest.mark.parametrize("most", [5, 30, 300, 65_535])
def test_same_as_one_task(spark, most):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(name, float(v)) for name, values in SETS.items() for v in values] + [("even", None), ("even", float("nan")), ("one", 3.5)]
        random.Random(1).shuffle(rows)
        long = spark.createDataFrame(rows, "feature string, value double").repartition(3)
        got = {r.feature: list(r.starts) for r in quantize.codebook(long, most).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {name: one_task(values, most) for name, values in SETS.items()}


def test_functions_of_ranges():
    r = random.Random(4)
    for _ in range(200):
        values = np.unique(np.round(np.array([r.uniform(0, 50) for _ in range(r.randint(1, 60))]), r.choice([0, 1, 6])))
        gap = r.choice([0.3, 1.0, 2.5, 7.0, 100.0])
        steps = gap_ranges.function(values, gap)
        for start in [float(values[0]) - d for d in (1e-6, 0.1, 0.5, 1.0, 2.5, 6.9, 50.0, 99.0, 1000.0)]:
            places = gap_ranges.chain(values, gap_ranges.opens(values, start, gap), gap, 10**6)
            want = (len(places), float(values[places[-1]])) if places else (0, start)
            if gap_ranges.opens(values, start, gap) <= gap_ranges.opens(values, float(values[0]), gap):
                assert gap_ranges.apply(steps, start, gap) == want
        k, counts = gap_ranges.own_counts(values, 10)
        assert counts[0] <= 10 and counts[-1] == 1 and counts == sorted(counts, reverse=True)


def test_functions_of_blocks_are_those_of_their_values():
    r = random.Random(9)
    for _ in range(300):
        values = np.unique(np.round(np.array([r.uniform(0, 50) for _ in range(r.randint(4, 60))]), r.choice([0, 1, 6])))
        gap = r.choice([0.3, 1.0, 2.5, 7.0, 100.0])
        cuts = sorted(r.sample(range(1, len(values)), min(len(values) - 1, r.randint(1, 6))))
        parts = [gap_ranges.function(x, gap) for x in np.split(values, cuts)]
        block = gap_ranges.composed(parts, float(values[0]), gap)
        for d in (1e-6, 0.1, 0.5, 1.0, 2.5, 6.9, 50.0, 99.0, 1000.0):
            start = float(values[0]) - d
            places = gap_ranges.chain(values, gap_ranges.opens(values, start, gap), gap, 10**6)
            assert gap_ranges.apply(block, start, gap) == ((len(places), float(values[places[-1]])) if places else (0, start))


def test_evenly_spaced_values_do_not_reach_the_driver(spark, monkeypatch):
    """Chains over evenly spaced values never meet: their functions, of as many steps as values, stay in tables."""
    from pyspark.sql.classic.dataframe import DataFrame

    seen, collect = [], DataFrame.collect
    size = lambda x: 1 + sum(map(size, x)) if isinstance(x, (list, tuple)) else 1

    def watched(self):
        rows = collect(self)
        seen.append(sum(map(size, rows)))
        return rows

    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    monkeypatch.setattr(DataFrame, "collect", watched)
    try:
        long = spark.range(60_000).select(F.lit("id").alias("feature"), F.col("id").cast("double").alias("value"))
        starts = quantize.codebook(long, 7).first().starts
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert starts == one_task(range(60_000), 7)
    assert max(seen) < 1000

import random

import pytest

from rankflow.llm import graph as m


def brute(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is None or b is None or a == b:
            continue
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


@pytest.mark.parametrize("most", [0, 10**6])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(m, "ONE_TASK", most)
    r = random.Random(1)
    chain = list(range(1000, 1400))
    r.shuffle(chain)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(150)] + list(zip(chain, chain[1:], strict=False)) + [(-5, 7), (7, 7), (None, 3), (4, None), (-5, 7), (2**62, -(2**62))]
    links += [(5000, 5000 + i) for i in range(1, 300)]
    df = spark.createDataFrame(links, "a long, b long").repartition(4)
    assert {x.node: x.component for x in m.components(df).collect()} == brute(links)
    assert m.components(df.where("false")).count() == 0

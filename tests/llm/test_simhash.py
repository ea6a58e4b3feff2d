import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from rankflow.llm import simhash as m
from rankflow.llm.graph import components


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_classes(prints):
    """Ids -> fingerprints; the smallest id reachable by links of at most four bits."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def near(r, n=250):
    out = []
    for _ in range(n):
        x = r.getrandbits(64)
        out.append(x)
        for _ in range(r.choice((0, 0, 1, 3))):
            for b in r.sample(range(64), r.randint(0, 6)):
                x ^= 1 << b
            out.append(x)
    return sorted(set(out))


def test_collisions_are_the_links():
    r = random.Random(1)
    prints = near(r)
    p, nodes = np.array(prints, np.uint64), np.arange(len(prints))
    want = brute_classes(dict(enumerate(prints)))
    for bits, room in ((0, 1 << 30), (4, 1 << 30), (0, 20_000)):
        pairs = np.concatenate([m.collide(p, nodes, k, bits, 2, room) for k in range(1 << bits)])
        assert all((prints[a] ^ prints[b]).bit_count() <= 4 for a, b in pairs.tolist())
        root = {i: i for i in range(len(prints))}
        for _ in range(20):
            for a, b in pairs.tolist():
                root[a] = root[b] = min(root[a], root[b])
        assert root == want


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 11), (12, 11), (13, 12), (14, 13), (5, 5)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 260)]
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {1: 1, 2: 1, 3: 1} | {i: 10 for i in range(10, 15)} | {i: 100 for i in range(100, 141)} | {i: 200 for i in range(200, 260)}
    assert got == want


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {x.doc_id: x.text for x in docs.collect()}
    prints = {i: brute_print(t) for i, t in rows.items()}
    want = brute_classes(prints)
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in m.simhash_classes(docs).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in rows}


def test_very_long_texts_and_even_bits():
    r = random.Random(6)
    for n in (65_536 + 3, 65_537 + 3, 140_001):  # shingles at and beyond the edges of a part
        text = " ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(n))
        assert m.fingerprint(text.encode()) == brute_print(text)
    assert m.fingerprint(b"a b c d e") == brute_print("a b c d e")  # two shingles: bits that one of them has are 0


def test_edge_rows(spark):
    df = spark.createDataFrame([(4, None, "a"), (2, " \t\n", "b"), (None, "One two", None), (7, "one  TWO", "c"), (7, "one  TWO", "c"), (9, "ONE É two " * 9, "d")], "doc_id long, text string, print string")
    rows = m.simhash_classes(df).collect()
    assert len(rows) == 6
    by = {x.doc_id: x for x in rows}
    assert by[2].fingerprint == "0" * 16 and by[4].component_id == by[2].component_id == 2
    assert by[7].component_id is None and by[7].fingerprint == f"{brute_print('one two'):016x}"
    assert m.simhash_classes(df.where(F.lit(False))).count() == 0


def test_rows_without_or_with_the_same_id_are_apart(spark):
    a, b, c, d = ("alpha beta gamma delta epsilon", "one two three four five six", "Seite auf Seite ab und zu", "un deux trois quatre cinq")
    rows = [(None, a), (None, b), (6, b), (7, a), (3, c), (5, c), (5, d), (9, d), (9, d)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((x.doc_id, x.text) for x in m.keep_one(df).collect()), key=str)
    assert kept == sorted([(None, a), (None, b), (3, c), (5, d)], key=str)
    got = {(x.doc_id, x.fingerprint, x.component_id) for x in m.simhash_classes(df).collect()}
    name = lambda t: f"{brute_print(t):016x}"
    assert got == {(i, name(t), {a: None, b: None, c: 3, d: 5}[t]) for i, t in rows}

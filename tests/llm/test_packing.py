import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations_with_replacement

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankflow.llm import packing as m
from rankflow.llm.queries import vocabulary

PATH = vocabulary("byte_bpe_50k.json")


def best_fit(counts, size):
    """Sequences that best-fit decreasing takes."""
    room = np.zeros(size + 1, np.int64)  # sequences by what is left in them
    for n in range(size, 0, -1):
        for _ in range(counts[n]):
            fits = np.flatnonzero(room[n:])
            k = n + fits[0] if len(fits) else size
            if len(fits):
                room[k] -= 1
            room[k - n] += 1
    return int(room.sum())


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_all_and_fits(seed):
    r = np.random.default_rng(seed)
    counts = np.zeros(65, np.int64)
    for n, k in zip(r.integers(1, 65, 40), r.integers(1, 500, 40), strict=True):
        counts[n] += k
    used = Counter()
    for lengths, times in m.plan(counts, 64):
        assert sum(lengths) <= 64 and times > 0
        for n in lengths:
            used[n] += times
    assert all(used[n] == counts[n] for n in range(65))
    bins = sum(t for _, t in m.plan(counts, 64))
    assert bins <= 1.01 * best_fit(counts, 64) + 1


def test_plan_fills_singles_pairs_triples_exactly():
    counts = np.zeros(101, np.int64)
    counts[[90, 10, 80, 12, 8, 70, 15, 11, 4]] = [3, 3, 2, 2, 2, 5, 5, 5, 5]
    assert sum(t for _, t in m.plan(counts, 100)) == 10


def test_no_exact_combination_is_left_when_best_fit_begins():
    """Replays the plan: before a sequence that is not full, nothing left could have filled it with up to three pieces."""
    assert sum(t for _, t in m.plan(np.bincount([60, 38, 25, 20, 15], minlength=101), 100)) == 2
    assert ((60, 25, 15), 1) in [(tuple(sorted(x, reverse=True)), t) for x, t in m.plan(np.bincount([60, 38, 25, 20, 15], minlength=101), 100)]
    for seed in range(40):
        r = np.random.default_rng(seed)
        size = int(r.integers(8, 40))
        counts = np.bincount(r.integers(1, size, int(r.integers(3, 60))), minlength=size + 1)
        left = counts.copy()
        for lengths, times in m.plan(counts, size):
            if sum(lengths) < size:
                free = left - np.bincount(lengths[:1], minlength=size + 1)
                for k in (1, 2, 3):
                    for c in combinations_with_replacement(np.flatnonzero(free > 0).tolist(), k):
                        assert sum(c) + lengths[0] != size or (np.bincount(c, minlength=size + 1) > free).any(), (lengths, c)
            left -= times * np.bincount(lengths, minlength=size + 1)
        assert not left.any()


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [t.encode(x, add_special_tokens=False).ids for x in texts]


SPECIAL = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|>b", "<|endoftext|><|endoftext|>", " <|endoftext|>\n", "<|endoftext|", "<|<|endoftext|>|>", "x<|startoftext|>  <|ENDOFTEXT|> y", "it's<|endoftext|>'s  \u00e9\u0301<|endoftext|>\u0301"]


def test_special_tokens_as_the_library_has_them():
    fast = m._encoder(PATH)
    assert [fast(t).tolist() for t in SPECIAL] == library(SPECIAL)
    assert fast("hello <|endoftext|> world").tolist() == [31373, 220, 50256, 995]


def test_encoders_agree():
    r = random.Random(0)
    texts = ["", " ", "a  b\n \n c", "<|endoftext|>", "it's 123 Ünïcode 　 x", "x" * 3000, "\U0001f600 ́a"]
    texts += ["".join(chr(r.choice((r.randint(32, 127), r.randint(1, 0x2FF), r.randint(0x4E00, 0x4F00)))) for _ in range(200)) for _ in range(50)]
    fast, plain = m._encoder(PATH), m._plain_encoder(PATH)
    for t, want in zip(texts, library(texts), strict=True):
        assert fast(t).tolist() == plain(t).tolist() == want


def test_pieces_are_placed_gapless(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, None), (10**9, "")], "doc_id long, text string"), allowMissingColumns=True).withColumn("length", F.lit("x"))
    rows = m.pack(docs, PATH, max_len=512).collect()
    plain = m._plain_encoder(PATH)
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for x in rows:
        by_seq[x.sequence_id].append((x.offset, x.length))
        by_doc[x.doc_id].append(x)
    for xs in by_seq.values():
        at = 0
        for offset, n in sorted(xs):
            assert offset == at
            at += n
        assert at <= 512
    total = sum(x.length for x in rows)
    assert len(by_seq) <= 1.02 * -(-total // 512) + 1
    for d in docs.select("doc_id", "text").dropDuplicates().collect():
        ids = np.append(plain(d.text or ""), 0).astype("<u4")
        mine = {x.piece: x for x in by_doc[d.doc_id]}
        assert [mine[k].length for k in sorted(mine)] == m.cut(len(ids), 512)
        for x in mine.values():
            assert x.ids_crc32 == zlib.crc32(ids[x.start : x.start + x.length])
    assert m.pack(docs.where(F.lit(False)), PATH).count() == 0

import random
import subprocess
import sys
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankflow.llm import token_file as m
from rankflow.llm.queries import vocabulary

PATH = vocabulary("word_bpe_49k.json")


def plain(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_word_cache_gives_the_tokenizer_s_ids():
    r = random.Random(2)
    texts = ["", " ", "a  b\n\n c\x0b\x0c", "it's <|endoftext|> x<|y", "ΣΑΣ İi ﬁ é é ́x", "a b c\x85d\x1ce", "don't DON'T 123 4,5", "x" * 500, "l'été ÉCOLE Ça!'s 'S x×y÷z ŒUVRE ŸŽ ſ ŉ ı", "a's,b'll?it'd''ve 1a2b ~!@#"]
    texts += ["".join(chr(r.choice((r.randint(32, 127), r.randint(1, 0x2FF), r.randint(0x2000, 0x2030), r.randint(0x4E00, 0x4E40)))) for _ in range(120)) for _ in range(80)]
    texts += ["".join(r.choice("aAéÉ'sStd1,.<|>İΣ×ñ \n") for _ in range(60)) for _ in range(200)]
    w = m.WordIds(PATH, most=300)
    for lo in range(0, len(texts), 7):
        ids, sizes = w.encode(texts[lo : lo + 7])
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == plain(texts[lo : lo + 7])


def test_special_tokens_as_the_library_has_them():
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|>b", "plain", "<|startoftext|><|endoftext|>", " <|endoftext|>\n", "<|endoftext|", "<|<|endoftext|>|>", "x<|startoftext|>  <|ENDOFTEXT|> y", "", "it's<|endoftext|>'s  \u00e9<|endoftext|>\u0301"]
    w = m.WordIds(PATH)
    for at in range(len(texts)):
        some = texts[at:] + texts[:at]
        ids, sizes = w.encode(some)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == plain(some)
    assert w.encode(texts[:1])[0].tolist() == [3306, 49407, 1002]


def test_long_text(spark):
    text = "One two, three <|endoftext|> four. " * 30_000
    (row,) = m.token_file(spark.createDataFrame([(1, text)], "doc_id long, text string"), PATH).collect()
    want = np.array([*plain([text])[0], 2], "<u4")
    assert tuple(row) == (1, 0, len(want), zlib.crc32(want))


@pytest.mark.parametrize("n", [1, 5, 64, 1000, 70_001])
def test_block_round_trip(n):
    r = np.random.default_rng(n)
    ids = np.minimum(r.zipf(1.3, n) - 1, 4999).astype(np.uint32)
    freq = m.frequencies(np.bincount(ids, minlength=5000) * 1000)
    assert freq.sum() == 1 << m.SCALE and (freq[np.unique(ids)] > 0).all()
    table = m.Table(freq)
    sizes = np.array([n // 3, 0, n - n // 3])
    raw = m.pack_block(np.array([4, 5, 9]), sizes, ids, table)
    docs, back, out = m.unpack_block(raw, table)
    assert (docs.tolist(), back.tolist()) == ([4, 5, 9], sizes.tolist()) and (out == ids).all()
    with pytest.raises(ValueError, match="damaged"):
        m.unpack_block(raw[:-1] + bytes([raw[-1] ^ 1]), table)
    if n > 1000:
        x, marks, words = m.encode_block(ids, table, 128, every=50)
        assert marks
        for step, read, states in marks:
            assert (m.decode_steps(n, states, words[read:], table, step) == ids[step * 128 :]).all()
        p = freq[ids] / (1 << m.SCALE)
        assert 32 * len(words) <= 1.05 * -np.log2(p).sum() + 64 * 128


def test_word_cache_on_given_texts():
    texts = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").text.tolist()
    w = m.WordIds(PATH)
    ids, sizes = w.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == plain(texts)


def test_file_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy(F.rand(3))
    docs = docs.unionByName(spark.createDataFrame([(None, None), (-5, ""), (10**9, "one Two <|endoftext|>")], "doc_id long, text string"), allowMissingColumns=True).withColumn("n", F.lit("x"))
    rows = {r.doc_id: r for r in m.token_file(docs, PATH).collect()}
    texts = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda x: (x[0] is not None, x[0]))
    at = 0
    for (doc, _), ids in zip(texts, plain([t for _, t in texts]), strict=True):
        want = np.array([*ids, 2], "<u4")
        assert tuple(rows[doc])[1:] == (at, len(want), zlib.crc32(want))
        at += len(want)
    assert len(rows) == len(texts)


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c")], "doc_id long, text string")
    rows = sorted(m.token_file(df, PATH).collect(), key=lambda r: r.start)
    assert [r.n_tokens for r in rows] == [2, 3, 3] and [r.start for r in rows] == [0, 2, 5]
    assert m.token_file(df.where(F.lit(False)), PATH).count() == 0


WORKER = """
import random, re, sys
import pyarrow as pa
from rankflow.llm import token_file as m

def mb():
    return int(re.search(r"Anonymous:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

r, before = random.Random(5), mb()

def batches():
    for _ in range(14):
        texts = [" ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=8)) + r.choice(["", ",", "."]) for _ in range(200)) for _ in range(200)]
        yield pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(texts)], ["doc_id", "text"])

print(max(mb() for _ in m._tokenize(sys.argv[1], 2, 49408)(batches())) - before)
"""


def test_memory_of_a_worker_whose_caches_are_full():
    done = subprocess.run([sys.executable, "-c", WORKER, PATH], capture_output=True, text=True, check=True)
    assert float(done.stdout) < 225


def test_long_texts_are_encoded_alone(monkeypatch):
    seen = []
    encode = m.WordIds.encode
    monkeypatch.setattr(m, "MOST_BYTES", 1000)
    monkeypatch.setattr(m.WordIds, "encode", lambda self, texts: seen.append(texts) or encode(self, texts))
    texts = ["a" * 400, None, "b " * 200, "é" * 300, "c d " * 2000, "", *["e"] * 600]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    rows = [x for out in m._tokenize(PATH, 2, 49408)(iter([batch])) for x in out.to_pylist()]
    assert [t for some in seen for t in some] == [t or "" for t in texts]
    assert all(len(some) == 1 or len(some) <= 256 and sum(len(t.encode()) for t in some) <= 1000 for some in seen)
    assert [np.frombuffer(x["ids"], "<u2").tolist() for x in rows[:-1]] == [[*ids, 2] for ids in plain([t or "" for t in texts])]
    assert [x["doc_id"] for x in rows[:-1]] == list(range(len(texts))) and np.frombuffer(rows[-1]["ids"], "<i8").sum() == sum(x["n"] for x in rows[:-1])

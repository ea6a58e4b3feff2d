import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankflow.llm import suffix_dedup as m


def brute(rows, span=100):
    """Rows (id, text) -> (id, n_bytes, n_removed, n_spans, kept_sha256)."""
    seen, out = {}, []
    for doc, text in sorted(rows):
        raw = text.encode()
        for s in range(len(raw) - span + 1):
            seen.setdefault(raw[s : s + span], (doc, s))
    for doc, text in sorted(rows):
        raw = text.encode()
        cover = bytearray(len(raw))
        for s in range(len(raw) - span + 1):
            if seen[raw[s : s + span]] < (doc, s):
                cover[s : s + span] = b"\1" * span
        spans = bytes(cover).split(b"\0")
        out.append((doc, len(raw), sum(cover), sum(1 for x in spans if x), hashlib.sha256(bytes(c for c, k in zip(raw, cover) if not k)).hexdigest()))
    return out


def got(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())


def made_up(n=60, seed=0):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefé") for _ in range(r.randint(1, 7)))
    passages = [" ".join(word() for _ in range(r.randint(15, 80))) for _ in range(4)]
    docs = []
    for _ in range(n):
        parts = [" ".join(word() for _ in range(r.randint(0, 60)))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randint(0, len(p) // 2)
            parts += [p[a : a + r.randint(60, len(p))], word()]
        docs.append(" ".join(parts))
    docs[5] = docs[3]
    docs[7] = docs[3] + "x"
    docs[9] = "a" * 5000 + "b" + "a" * 300
    docs[10] = "abcdefghij" * 60
    docs[11] = "a" * 99
    docs[12] = ""
    docs[13] = "y" + "a" * 4500
    return list(enumerate(docs))


@pytest.mark.parametrize(("seed", "hot"), [(0, 50_000), (1, 50_000), (2, 2)])
def test_against_brute_force(spark, seed, hot):
    rows = made_up(seed=seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(m.suffix_dedup(df, hot_fragments=hot)) == brute(rows)


def test_merge_of_shards_matches_plain_search():
    rng = np.random.default_rng(0)
    common = rng.integers(97, 100, 400, dtype=np.uint8)
    texts = [np.concatenate((rng.integers(97, 100, rng.integers(0, 60), dtype=np.uint8), common[rng.integers(0, 50) : 300 + rng.integers(0, 100)])) for _ in range(30)]
    texts = [t if len(t) >= 100 else common for t in texts]
    joined = np.concatenate(texts)
    seen, want = set(), []
    for t in texts:
        for s in range(len(t) - 99):
            x = t[s : s + 100].tobytes()
            want.append(x in seen)
            seen.add(x)
    starts = np.array([len(t) - 99 for t in texts])
    assert m.merged_repeats(joined, starts).tolist() == want
    for k in (1, 2, 3, 7):  # fewer texts: shards of one or two
        n, size = int(starts[:k].sum()), sum(map(len, texts[:k]))
        assert m.merged_repeats(joined[:size], starts[:k]).tolist() == want[:n]


def test_interleave_of_transforms_is_the_number_of_smaller_suffixes():
    """Rank queries against the other shard's transform give each suffix's class there; checked against all pairs."""
    rng = np.random.default_rng(3)
    texts = [rng.integers(97, 99, int(n), dtype=np.uint8) for n in rng.integers(100, 180, 12)]
    texts += [t[: int(rng.integers(100, len(t) + 1))] for t in texts[:8]]
    joined, counts = np.concatenate(texts), np.array([len(t) - 19 for t in texts])
    n = int(counts.sum())
    local, count = m.ranges(np.zeros(len(counts), np.int64), counts), np.repeat(counts, counts)
    sizes = counts + 19
    places = m.ranges(np.cumsum(sizes) - sizes, counts)
    blocks = m._blocks(joined, places)
    hashes = m._hashed(blocks, 0x9E3779B97F4A7C15)
    cut = int(np.cumsum(counts)[9])
    a, b = m._Transform(hashes, blocks, 0, cut, local, count), m._Transform(hashes, blocks, cut, n, local, count)
    met = m._interleaved(a, b, blocks)
    whole = [joined[p : p + 100].tobytes() if c - i > 80 else None for p, i, c in zip(places.tolist(), local.tolist(), count.tolist(), strict=True)]
    there = {w for w in whole[cut:] if w}
    for i in range(cut):
        if whole[i]:
            assert (met[i] >= 0) == (whole[i] in there)
            if met[i] >= 0:
                assert whole[cut + b.order[met[i]]] == whole[i] and (met[i] == 0 or whole[cut + b.order[met[i] - 1]] != whole[i])


def hashed_brute(rows):
    """brute() by 64-bit hashes of the strings, for larger inputs."""
    import xxhash

    raws = [t.encode() for _, t in rows]
    all_hashes = np.array([xxhash.xxh64_intdigest(memoryview(r)[s : s + 100]) for r in raws for s in range(len(r) - 99)], np.uint64)
    _, first = np.unique(all_hashes, return_index=True)
    again = np.ones(len(all_hashes), bool)
    again[first] = False
    out, at = [], 0
    for (doc, _), raw in zip(rows, raws, strict=True):
        n = max(0, len(raw) - 99)
        edge = np.zeros(len(raw) + 1, np.int64)
        on = np.flatnonzero(again[at : at + n])
        np.add.at(edge, on, 1)
        np.add.at(edge, on + 100, -1)
        cover, at = np.cumsum(edge)[:-1] > 0, at + n
        spans = int((np.diff(cover.astype(int), prepend=0) == 1).sum())
        out.append((doc, len(raw), int(cover.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~cover].tobytes()).hexdigest()))
    return out


def test_one_key_in_very_many_fragments(spark):
    """A passage between words that differ in each of 20,000 documents: found by the sample, dealt by whole strings."""
    r = random.Random(2)
    passage = "".join(r.choice("abcdefgh ") for _ in range(130))
    rows = [(i, f"{i * 7919 % 100003:06d} {r.random():.9f} {passage} {r.random():.9f}, {i}") for i in range(20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    split = m._split_keys(m.id_and_text(df), 1000)
    assert 1 <= len(split) < 200
    dealt = df.select("doc_id", "text").mapInArrow(m._scan(64, split), "bucket int, blob binary")
    sizes = [x.n for x in dealt.groupBy("bucket").agg(F.sum(F.length("blob")).alias("n")).collect()]
    assert max(sizes) < 0.2 * sum(sizes), (max(sizes), sum(sizes))
    assert got(m.suffix_dedup(df, hot_fragments=1000)) == hashed_brute(rows)
    assert got(m.suffix_dedup(df.limit(0).union(df.where("doc_id < 3000")), hot_fragments=3)) == hashed_brute(rows[:3000])


def test_very_long_text(spark):
    r = random.Random(9)
    part = "".join(r.choice("abcdefghij klmnop") for _ in range(700_000))
    rows = [(1, part[:400_000] + part * 7 + "end"), (2, part[1000:1500])]
    assert len(rows[0][1]) > 5_000_000
    assert got(m.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == hashed_brute(rows)


def test_edge_rows(spark):
    long = "word and another word, " * 20
    df = spark.createDataFrame([(3, None, 1), (None, long, 2), (4, long, 3), (4, long, 3), (5, "", None)], "doc_id long, text string, n_bytes int")
    rows = {r.doc_id: r for r in m.suffix_dedup(df).collect()}
    assert len(rows) == 4 and m.suffix_dedup(df).count() == 5 and rows[3].n_bytes == 0 and rows[5].n_removed == 0
    assert rows[4].n_removed == len(long) and rows[4].n_spans == 1
    assert 0 < rows[None].n_removed < len(long)
    assert m.suffix_dedup(df.where(F.lit(False))).count() == 0


def cut_rows(docs, buckets=16):
    """What _cut sends for documents of (id, text, [(key, start, starts, kind)])."""
    kind = m.pa.list_(m.pa.struct([("key", m.pa.int64()), ("start", m.pa.int64()), ("starts", m.pa.int32()), ("kind", m.pa.int32())]))
    listed = [[dict(zip(("key", "start", "starts", "kind"), x, strict=True)) for x in fragments] for _, _, fragments in docs]
    ids = m.pa.array([d for d, _, _ in docs], m.pa.int64())
    batch = m.pa.RecordBatch.from_arrays([ids, m.pa.array([0] * len(docs), m.pa.int64()), m.pa.array([t for _, t, _ in docs]), m.pa.array(listed, kind)], ["doc_id", "text_hash", "text", "listed"])
    return m.pa.Table.from_batches(list(m._cut(buckets)(iter([batch]))))


def test_crowded_key_of_one_string_is_sent_once():
    """Runs of one letter, each of its own length, are different fragments of one key and one string."""
    docs = [(i, "-" * (n + 99), [(5, 0, n, m.HOT)]) for i, n in enumerate(range(1, 1500, 3))]
    sent = cut_rows(docs)
    assert sum(map(len, sent.column("blob").to_pylist())) < 200_000  # a string for each start would be 51 MB
    found = m._merge(sent).to_pydict()
    repeats = sum(z - a + 1 for a, z in zip(found["a"], found["z"], strict=True))
    assert repeats == sum(n for _, _, [(_, _, n, _)] in docs) - 1
    assert min(zip(found["doc_id"], found["a"], strict=True)) == (1, 0)


def test_merge_of_a_large_bucket_stays_small():
    import tracemalloc

    rng = np.random.default_rng(1)
    same = rng.integers(97, 123, 100, dtype=np.uint8).tobytes()
    pieces = [(7, i, 0, 0, 1) for i in range(30_000)]  # one string from 30,000 tasks
    texts = [same] * 30_000
    for key in range(40):  # and keys of 100 kB
        body = rng.integers(97, 123, 200, dtype=np.uint8).tobytes()
        for i in range(250):
            pieces.append((100 + key, i, 0, 1000 * key, 301))
            texts.append(rng.integers(97, 123, 100, dtype=np.uint8).tobytes() + body + rng.integers(97, 123, 100, dtype=np.uint8).tobytes())
    rows = np.array(pieces, m._PIECE)
    table = m.pa.table({"bucket": m.pa.array([0], m.pa.int32()), "n": m.pa.array([len(rows)], m.pa.int32()), "blob": m.pa.array([rows.tobytes() + b"".join(texts)])})
    tracemalloc.start()
    found = m._merge(table).to_pydict()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    strings = [x[a : a + 100] for x in texts for a in range(len(x) - 99)]
    assert sum(z - a + 1 for a, z in zip(found["a"], found["z"], strict=True)) == len(strings) - len(set(strings))
    assert peak < 120e6, peak


def test_copies_of_one_fragment_are_dealt_evenly():
    """A line of one fragment in 20,000 documents: the copies' records spread over all buckets."""
    r = random.Random(4)
    line = "".join(r.choice("abcdefgh ") for _ in range(100))
    batch = m.pa.RecordBatch.from_arrays([m.pa.array(range(20_000), m.pa.int64()), m.pa.array([line] * 20_000)], ["doc_id", "text"])
    sizes = {}
    for out in m._scan(32, np.zeros(0, np.uint64))(iter([batch])):
        for b, blob in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True):
            sizes[b] = sizes.get(b, 0) + len(blob)
    assert len(sizes) == 32 and max(sizes.values()) < 2 * sum(sizes.values()) / 32


def test_buckets_follow_the_text_and_not_its_files(spark, tmp_path):
    spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("one line that is said again and again, "), 5000).alias("text")).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    assert m._buckets(m.id_and_text(docs)) == 13  # 78 MB of text in files of less than 2 MB


def test_runs_of_one_letter_and_crowded_passages(spark):
    r = random.Random(6)
    passage = "".join(r.choice("abcdefgh ") for _ in range(300))
    rows = [(i, "-" * r.randint(90, 900) + f"{r.random():.12f} {passage[r.randint(0, 99):]} {r.random():.12f}" + "ab" * r.randint(0, 300)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for hot in (3, 50_000):
        assert got(m.suffix_dedup(df, hot_fragments=hot)) == hashed_brute(rows)

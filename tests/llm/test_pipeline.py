import zlib

import numpy as np

import corpus_pipeline as p
from rankflow.llm import mixing, packing, privacy, quality
from rankflow.llm.queries import vocabulary

from .test_simhash import brute_classes, brute_print

DIR = "/root/testdata/sf0.01"


def test_run_against_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    model = quality.learn(docs, labels)
    rows = {r.doc_id: r.asDict() for r in docs.collect()}
    score = model.score(np.array([quality.features(r["text"].encode()) for r in rows.values()]))
    rows = {i: r for (i, r), s in zip(rows.items(), score, strict=True) if s >= 0.7}
    classes = brute_classes({i: brute_print(r["text"]) for i, r in rows.items()})
    rows = {i: r for i, r in rows.items() if classes[i] == i}
    net = privacy.trained()
    for r in rows.values():
        ((base, more),) = privacy.all_spans([r["text"]], net)
        r["text"] = privacy.masked_text(r["text"], base + more)
        r["n_chars"] = len(r["text"])
    left = spark.createDataFrame(list(rows.values()), docs.schema)
    kept = {r.doc_id for r in mixing.mixing_table(left).where("selected").collect()}
    encode = packing._encoder(vocabulary("byte_bpe_50k.json"))
    want = set()
    for i in kept:
        ids, at = np.append(encode(rows[i]["text"]), 0).astype("<u4"), 0
        for k, n in enumerate(packing.cut(len(ids), 2048)):
            want.add((i, k, at, n, zlib.crc32(ids[at : at + n])))
            at += n
    got = p.run(spark, DIR).collect()
    assert len(got) == len(want) and {tuple(r)[:5] for r in got} == want
    assert len(rows) > 500 and len({r.sequence_id for r in got}) <= 1.02 * -(-sum(r.length for r in got) // 2048) + 1


def test_stages_keep_columns_and_effects(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        after = stage(spark, docs, DIR)
        assert after.columns == docs.columns
        docs = after
    assert 5 >= len(p.STAGES) >= 4


def test_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (None, "some words here, and more of them.", "en", "s", 3), (2, "some words here, and more of them.", "en", "s", 3), (2, "some words here, and more of them.", "en", "s", 3), (3, "", "en", "s", 0), (4, "long text " * 50_000, "en", "t", 1)]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(99, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    one = p.near_duplicates(spark, docs, str(tmp_path))
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in one.collect()) == [(0, 34), (1, 0), (4, 500_000)]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert p.run(spark, str(tmp_path)).count() >= 0
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0

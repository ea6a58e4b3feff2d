import numpy as np
from pyspark.sql import functions as F

from rankflow.llm import quality as m

DIR = "/root/testdata/sf0.01"


def test_interaction_is_learned():
    r = np.random.default_rng(0)
    x = r.random((4000, len(m.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = m.fit(x[:3000], y[:3000], rounds=30)
    assert (0, 1) in model.pairs
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in m.quality_scores(docs, labels).collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == m.is_held_out(i) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in rows.items())
    held = [(rows[x.doc_id].predicted, x.quality) for x in labels.collect() if rows[x.doc_id].held_out]
    assert sum(p == q for p, q in held) / len(held) > 0.95
    kept = {r.doc_id for r in m.keep_good(docs, labels).collect()}
    assert kept == {i for i, r in rows.items() if r.predicted}


def test_only_text_decides(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet").limit(200) for t in ("documents", "labels"))
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string")).withColumn("score", F.lit(1))
    a, b = (sorted((r.doc_id, r.score) for r in m.quality_scores(d, labels).collect()) for d in (docs, other))
    assert a == b


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (None, "", 2), (2, "a b " * 50000, 3), (2, "x", None), (2, "x", None)], "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1), (77, 5)], "doc_id long, quality int")
    rows = m.quality_scores(df, labels).collect()
    assert len(rows) == 5 and all(r.score is not None and r.held_out is not None for r in rows)
    none = m.quality_scores(df, labels.where(F.lit(False))).collect()
    assert {r.score for r in none} == {0.5}
    assert m.quality_scores(df.where(F.lit(False)), labels).count() == 0

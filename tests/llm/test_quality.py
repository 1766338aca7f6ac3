"""Quality classifier: held-out accuracy, and rows of every kind."""

import zlib

import numpy as np

from fitlake.llm import quality as Q
from fitlake.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op9_nbsvm_quality"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows[:50]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 500 and np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def fixture(spark):
    good = [(i, f"The quiet house number {i} stood there, and nobody came.", 1) for i in range(60)]
    bad = [(100 + i, f"BUY!! NOW!! OFFER{i}!! CLICK!!", 0) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in good + bad] + [(None, 1), (5, None), (7, 1)],
                                   "doc_id long, quality int")
    return docs, labels


def test_unlabelled_rows_of_every_kind(spark):
    docs, labels = fixture(spark)
    model = Q.learn(docs, labels)
    new = spark.createDataFrame([(1, None), (2, ""), (3, "A"), (None, "SALE!! SALE!!"), (4, "quiet and there " * 9000),
                                 (4, "SALE!! SALE!!")], "doc_id long, text string").selectExpr("*", "9 AS score")
    got = Q.score(new, model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert got[3].score < 0.5 < got[4].score and got[0].score == got[1].score and got[3].score == got[5].score
    kept = Q.accepted(new, model)
    assert kept.columns == new.columns and {r.text[:5] for r in kept.collect() if r.text} >= {"quiet"}


def test_one_class_no_labels_no_rows(spark):
    docs, labels = fixture(spark)
    one = Q.learn(docs, labels.where("quality = 1"))
    assert 0.9 < one.score(np.array([], np.int64)) < 1
    none = Q.learn(docs, labels.limit(0))
    assert none.score(np.array([3], np.int64)) == 0.5
    assert Q.score(docs.limit(0), one).collect() == []


def test_dual_descent_separates():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 50, 10)) if i % 2 else np.unique(rng.integers(30, 90, 10)) for i in range(200)]
    y = np.array([1.0 if i % 2 else -1.0 for i in range(200)])
    w, b = Q.dual_descent(rows, np.ones(Q.PLACES), y, 1.0, 200)
    assert np.mean([np.sign(w[r].sum() + b) == s for r, s in zip(rows, y)]) > 0.95

"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fitlake.llm import ann


def brute(ids, x, query, k):
    score = x @ x[ids == query][0]
    rest = ids != query
    order = np.lexsort((ids[rest], -score[rest]))[:k]
    return list(ids[rest][order]), score[rest][order]


def recall(spark, df, k, **more):
    data = df.toPandas()
    ids, x = data.vec_id.to_numpy(), np.array([np.asarray(v, float) for v in data.embedding])
    got = ann.search(df, F.col("id") % 20 == 0, k=k, **more).toPandas()
    hit = total = 0
    for q in ids[ids % 20 == 0]:
        own = got[got.query_id == q].sort_values("rank")
        best, _ = brute(ids, x, q, k)
        assert len(own) == len(best) and list(own["rank"]) == list(range(1, len(best) + 1))
        assert np.allclose(own.score, [x[ids == q][0] @ x[ids == v][0] for v in own.vec_id], rtol=0, atol=1e-12)
        assert list(own.vec_id) == list(own.vec_id.to_numpy()[np.lexsort((own.vec_id, -own.score))])
        hit, total = hit + len(set(own.vec_id) & set(best)), total + len(best)
    return hit / total


@pytest.mark.parametrize("sf,least", [("sf0.01", 0.9), ("sf0.1", 0.9)])
def test_recall_on_the_table(spark, sf, least):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding")
    assert recall(spark, df, 20) >= least


def test_recall_with_different_norms(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 24)) * rng.uniform(0.1, 3, (1500, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert recall(spark, df, 20) >= 0.9


def unlike(kind):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "outlier":
        x[1] *= 10
    else:
        x *= rng.lognormal(0, 1, (6000, 1))
    return x


@pytest.mark.parametrize("kind,part", [("outlier", 4096), ("lognormal", 4096), ("lognormal", 128)])
def test_recall_with_unlike_norms_at_64_dimensions(spark, monkeypatch, kind, part):
    monkeypatch.setattr(ann, "PART_ROWS", part)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(unlike(kind))],
                               "vec_id long, embedding array<double>")
    assert recall(spark, df, 20) >= 0.95


def test_copies_and_ties_go_to_smaller_ids(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART_ROWS", 16)
    rows = [(i, [1.0, 0.0, 0.5]) for i in range(200)] + [(1000 + i, [0.0, float(i % 7), 1.0]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("id") == 20, k=5).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 2, 3, 4]


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, [2.0, 1.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]),
            (6, []), (7, [1.0, 1.0, 1.0]), (None, [1.0, 1.0]), (8, [-1.0, 0.0]), (9, [1.0, 2.0]), (9, [3.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS score")
    got = ann.search(df, F.col("id") % 20 == 0, k=20).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [
        (0, 1, 9, 5.0), (0, 2, 20, 4.0), (0, 3, 8, -1.0), (20, 1, 0, 4.0), (20, 2, 9, 4.0), (20, 3, 8, -2.0)]


def test_empty_and_single(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.search(df, F.lit(True)).collect() == []
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert ann.search(one, F.lit(True)).collect() == []

"""The hash tree: shares, movement, slots and checksums."""

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fitlake.llm import sharding as S


def shards(spark, tree, n=20_000):
    return {r.id: r.s for r in S.place(spark.range(n), F.col("id"), tree, "s").collect()}


def test_weights_are_followed(spark):
    tree = S.Tree({"a": {"a1": {0: 1.0, 1: 3.0}, "a2": {2: 2.0}}, "b": {"b1": {3: 2.0}}})
    count = Counter(shards(spark, tree).values())
    for shard, weight in {0: 1, 1: 3, 2: 2, 3: 2}.items():
        assert abs(count[shard] / 20_000 - weight / 8) < 0.015


def test_new_region_takes_rows_only_into_itself(spark):
    for n in (7, 8, 40):
        tree = S.Tree.even(n)
        old, new = shards(spark, tree), shards(spark, tree.with_shard(n))
        moved = [i for i in old if old[i] != new[i]]
        assert moved and all(new[i] == n for i in moved)
        assert abs(len(moved) / len(old) - 1 / (n + 1)) < 0.03


def test_changed_weight_moves_rows_only_through_its_subtree(spark):
    tree = S.Tree.even(16)
    grown = tree.with_shard(16, region="r1", rack="r1/k4")
    old, new = shards(spark, tree), shards(spark, grown)
    inside = {*range(8, 16), 16}
    moved = [i for i in old if old[i] != new[i]]
    assert moved and all(new[i] in inside for i in moved)
    assert all(new[i] == 16 or old[i] in (*range(8), *range(10, 16)) for i in moved)


ROWS = [(i, "é" * (i % 5)) for i in range(500)] + [(None, None), (None, ""), (None, "t"), (3, "x"), (3, "x")]


def test_sizes_checksums_and_slots(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "5 AS shard", "6 AS slot")
    tree = S.Tree.even(5, per_rack=1, per_region=2)
    rows = S.assign(df, tree, tree.with_shard(5)).collect()
    assert len(rows) == len(ROWS)
    slots = defaultdict(list)
    for r in rows:
        raw = (r.text or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert r.grown_shard in (r.shard, 5)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in rows if r.doc_id is None}) == 1


def test_plan_runs_no_python(spark):
    tree = S.Tree.even(4)
    df = S.assign(spark.createDataFrame(ROWS, "doc_id long, text string"), tree)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_table_and_bad_trees(spark):
    assert S.assign(spark.createDataFrame([], "doc_id long, text string"), S.Tree.even(3)).collect() == []
    with pytest.raises(ValueError):
        S.Tree({}).levels()
    with pytest.raises(ValueError):
        S.Tree.even(2).with_shard(1)

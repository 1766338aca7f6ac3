"""Mixing: targets, permutations, draws, and what is taken of each document."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fitlake.llm import mixing as M
from fitlake.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, source string"


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Sharing again by weight, source by source."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    goal, open_ = {}, set(names)
    left = share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level >= most * sizes[s]}
        if not over:
            return goal | {s: weight[s] * level for s in open_}
        for s in over:
            goal[s] = most * sizes[s]
            left -= goal[s]
        open_ -= over
    return goal


def docs_of(n=600):
    rows = [(i, " ".join(["w"] * (i * 7919 % 90)), f"s{i % 5}" if i % 3 else "hot") for i in range(n)]
    rows += [(n + i, "a\tb\x0bc d", None) for i in range(4)] + [(None, None, "hot"), (None, "", None)]
    rows += [(7, "x y", "é"), (7, "x y", "é"), (7, "x y z", "é"), (None, "p q", "é")]
    return rows


def check(rows, docs, tolerance):
    want = Counter((i, len(re.findall(M.WORD, t or ""))) for i, t, _ in docs)
    assert Counter((r.doc_id, r.size) for r in rows) == want
    sizes = defaultdict(int)
    for _, t, s in docs:
        sizes[s] += len(re.findall(M.WORD, t or ""))
    goal = plain_targets(sizes)
    expected = Counter((sizes[s], round(goal[s], 6)) for _, _, s in docs)
    assert Counter((r.source_size, round(r.target, 6)) for r in rows) == expected
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    taken = defaultdict(int)
    for r in rows:
        taken[(r.source_size, round(r.target, 6))] += r.taken
    by_goal = defaultdict(float)  # sources of one size and target together
    for s in sizes:
        by_goal[(sizes[s], round(goal[s], 6))] += goal[s]
    assert all(abs(taken[k] - by_goal[k]) <= tolerance * len(sizes) for k in by_goal)


def test_against_plain_targets(spark, block=16):
    docs = docs_of()
    df = spark.createDataFrame(docs, SCHEMA)
    out, held = M.mix(df, block=block)
    rows = out.collect()
    check(rows, docs, 1)
    again = M.mix(df.repartition(3).withColumn("number", F.lit(1)), block=block)[0].collect()
    assert Counter(rows) == Counter(again)
    per_slot = held.groupBy("shard", "position").agg(F.sum("words").alias("n")).collect()
    assert all(0 < r.n <= block for r in per_slot)
    assert sum(r.n for r in per_slot) == sum(r.taken for r in rows)


def test_windows_by_parts(spark, monkeypatch):
    monkeypatch.setattr(M, "PART", 5)
    monkeypatch.setattr(M, "SHARD_SLOTS", 3)
    docs = docs_of(40)
    out, _ = M.mix(spark.createDataFrame(docs, SCHEMA), block=4)
    check(out.collect(), docs, 1)
    table = spark.range(200).select((F.col("id") % 3).alias("k"), F.floor(F.col("id") / 3).alias("at"),
                                    (F.col("id") * 7 % 11).alias("v"))
    got = {(r[0], r[1]): r[2] for r in M.before(table, ["k"], "at", "v", 70).collect()}
    rows = {(i % 3, i // 3): i * 7 % 11 for i in range(200)}
    assert got == {(k, a): sum(v for (k2, a2), v in rows.items() if k2 == k and a2 < a) for k, a in rows}


def test_joins_without_broadcast(spark, monkeypatch):
    docs = docs_of(120)
    df = spark.createDataFrame(docs, SCHEMA)
    small = Counter(M.mix(df, block=16)[0].collect())
    monkeypatch.setattr(M, "SMALL_ROWS", 0)
    assert Counter(M.mix(df, block=16)[0].collect()) == small


def test_permutation(spark):
    for n in (1, 2, 7, 64, 1000):
        df = spark.range(n).select(M.permuted(F.col("id"), F.lit(n), F.lit(5)).alias("a"),
                                   M.permuted(F.col("id"), F.lit(n), F.lit(6)).alias("b"))
        a, b = zip(*[tuple(r) for r in df.collect()])
        assert sorted(a) == sorted(b) == list(range(n))
        if n == 1000:
            assert sum(x == y for x, y in zip(a, b)) < 10 and sum(x == i for i, x in enumerate(a)) < 10
            assert sum(abs(x - y) < 50 for x, y in zip(a, a[1:])) < 180  # neighbours go far apart


def test_shards_are_mixed(spark):
    """The counts of a source in the shards spread as multinomial draws do."""
    docs = [(i, " ".join(["w"] * 64), "ab"[i % 2]) for i in range(4000)]
    sources = M.targets(M.measured(spark.createDataFrame(docs, SCHEMA)), (1, 1))
    rows = M.slots(sources, block=16, shard_slots=256).groupBy("shard").agg(
        F.count("*").alias("n"), F.sum((F.col("source") == "a").cast("int")).alias("a")).collect()
    full = [r for r in rows if r.n == 256]
    assert len(full) == 4000 * 64 * 3 // 2 // 16 // 256
    spread = math.sqrt(sum((r.a - 128) ** 2 for r in full) / len(full))
    assert 5 < spread < 11  # a binomial draw has 8


def test_empty_and_wordless_tables(spark):
    assert M.mix(spark.createDataFrame([], SCHEMA))[0].collect() == []
    rows = M.mix(spark.createDataFrame([(1, None, "a"), (2, " ", None), (2, " ", None)], SCHEMA))[0].collect()
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in rows) == [
        (1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    with pytest.raises(ValueError):
        M.targets(M.measured(spark.createDataFrame([], SCHEMA)), share=3.0)


def test_long_text(spark):
    docs = [(0, "w " * 200_000, "a"), *((i, "v w", "b") for i in range(1, 50))]
    check(M.mix(spark.createDataFrame(docs, SCHEMA))[0].collect(), docs, 1)


def test_query_runs_no_python(spark):
    df = QUERIES["op11_multinomial_mix"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(
        "/root/testdata/sf0.001/documents.parquet").collect()]
    check(df.collect(), docs, 1)

"""Vector codes against a plain version of the same integer rounds."""

import hashlib
import math

import numpy as np
import pytest

from fitlake.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, positions=8, entries=16, rounds=6):
    """{row: (code, error, label error)} and the digest, in Python integers."""
    kept = [(i, v, lab) for i, v, lab in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], None
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    at = V.cuts(len(kept[0][1]), positions)
    whole = [[math.floor(4096 * x) for x in v] for _, v, _ in kept]
    books = [[tuple(v[c]) for v in whole[:entries]] for c in at]

    def assign(v, p):
        far = [sum((a - b) ** 2 for a, b in zip(v[at[p]], e)) for e in books[p]]
        return min(range(len(far)), key=lambda e: (far[e], e)), min(far)

    for _ in range(rounds):
        for p in range(positions):
            own = {}
            for v in whole:
                own.setdefault(assign(v, p)[0], []).append(v[at[p]])
            books[p] = [tuple(sum(c) // len(own[e]) for c in zip(*own[e])) if e in own else old
                        for e, old in enumerate(books[p])]
    out, sums = [], {}
    for (i, _, lab), v in zip(kept, whole):
        found = [assign(v, p) for p in range(positions)]
        out.append([i, "".join(f"{e:02x}" for e, _ in found), sum(d for _, d in found), lab])
        sums[lab] = sums.get(lab, 0) + out[-1][2]
    text = ",".join(str(x) for b in books for e in b for x in e)
    digest = hashlib.sha256(text.encode()).hexdigest()
    return sorted(([i, c, min(e, V.MOST), min(sums[lab], V.MOST), digest] for i, c, e, lab in out), key=str), digest


def got(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS row", "'x' AS code", "2 AS v")
    return sorted((list(r) for r in V.digest(V.compress(df, **kw)).collect()), key=str)


def table(n=700, width=16, seed=2):
    gen = np.random.default_rng(seed)
    centres = gen.normal(0, 1, (30, width))
    rows = [(int(i), [float(x) for x in centres[gen.integers(30)] + gen.normal(0, .1, width)], int(gen.integers(4)))
            for i in gen.permutation(n)]
    hot = rows[3][1]  # a third of all rows are one vector
    rows += [(n + i, hot, 9) for i in range(n // 2)] + [(n - 1, hot, None), (None, hot, None)]
    rows += [(-5, None, 1), (-4, [], 1), (-3, [math.nan] * width, 1), (-2, [None] * width, 1), (-1, [math.inf] * width, 1)]
    rows += [(4000, [1.0] * (width + 1), 1), (4001, [0.0] * width, None), (4001, [0.0] * width, None)]
    return rows


def test_against_plain(spark, monkeypatch):
    rows = table()
    want, _ = plain(rows)
    assert got(spark, rows) == want
    monkeypatch.setattr(V, "OWNER_ROWS", 40)  # many salts and partitions, pieces of a few members
    monkeypatch.setattr(V, "PARTITION_ROWS", 300)
    monkeypatch.setattr(V, "RUN_ROWS", 3)
    monkeypatch.setattr(V, "SMALL_ROWS", 0)
    assert got(spark, rows) == want


def test_only_movers_are_shuffled(spark):
    """Owners keep their partition over the rounds, and the union of members in place and movers has no shuffle."""
    def deal(key):
        return key[0] * 7 + key[1]

    own = spark.sparkContext.parallelize(
        [((0, i % 2, 0), np.full((2, 1), 10 * (i % 2) + i, np.int32)) for i in range(4)], 3).partitionBy(5, deal)
    books = [[[0], [3]]]
    stay = own.mapPartitions(V._moves(books, True), preservesPartitioning=True)
    gone = own.mapPartitions(V._moves(books, False)).partitionBy(5, deal)
    both = stay.union(gone)
    assert both.getNumPartitions() == 5 and both.partitioner == own.partitioner
    assert "PartitionerAwareUnionRDD" in both.toDebugString().decode()
    moved = gone.collect()
    assert [(k, m.tolist()) for k, m in moved] == [((0, 1, 0), [[2], [2]])]
    placed = dict(both.mapPartitionsWithIndex(lambda p, it: [(k, p) for k, _ in it]).collect())
    assert placed == {(0, 0, 0): 0, (0, 1, 0): 1}


def test_uneven_and_narrow_widths(spark):
    for width in (11, 3):
        rows = [r for r in table(60, width) if r[1] is None or len(r[1]) != width + 1]
        assert got(spark, rows, rounds=2) == plain(rows, rounds=2)[0]


def test_huge_components(spark):
    """Components beyond 64 bits are counted in whole numbers; an error beyond them is the largest one."""
    rows = [(i, [float(i), 1e300 if i == 7 else -1.5e9 * i, 1e17, 2.0 ** -1074] * 2, i % 2) for i in range(40)]
    assert got(spark, rows) == plain(rows)[0]


def test_few_rows_and_no_rounds(spark):
    rows = table(5, 8)[:5]
    assert got(spark, rows) == plain(rows)[0]
    assert got(spark, rows, rounds=0, entries=2) == plain(rows, entries=2, rounds=0)[0]
    assert got(spark, []) == [] and got(spark, [(1, None, 1)]) == []
    with pytest.raises(ValueError):
        got(spark, rows, entries=0)

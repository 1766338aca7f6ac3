"""Chunked ordered operators against pandas, with chunks of a few rows and one hot key."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fitlake.operators import ordered as O


@pytest.fixture(scope="module")
def pdf():
    gen = np.random.default_rng(3)
    key = np.where(gen.random(400) < 0.4, 0, gen.integers(1, 12, 400))
    df = pd.DataFrame({"key": key, "at": gen.integers(0, 90, 400), "id": np.arange(400),
                       "v": gen.integers(0, 15, 400).astype(float)})
    df = df.sort_values(["key", "at", "id"]).reset_index(drop=True)
    df["k"] = df.groupby("key").cumcount()
    return df


def collect(df, *order):
    return df.toPandas().sort_values(list(order)).reset_index(drop=True)


def test_number(spark, tiny_chunks, pdf):
    df = spark.createDataFrame(pdf.drop(columns="k"))
    out = collect(O.number(df, ["key"], ["at", "id"]), "key", "at", "id")
    assert (out["k"] == pdf["k"]).all()


def test_frames(spark, tiny_chunks, pdf):
    df = spark.createDataFrame(pdf)
    out = collect(O.frames(df, ["key"], "k", {
        "lag2": lambda w: F.lag("v", 2).over(w), "lead1": lambda w: F.lead("v").over(w),
        "sum3": lambda w: F.sum("v").over(w.rowsBetween(-2, 0))}, before=2, after=1), "key", "k")
    g = pdf.groupby("key")["v"]
    assert len(out) == len(pdf)
    np.testing.assert_array_equal(out["lag2"], g.shift(2))
    np.testing.assert_array_equal(out["lead1"], g.shift(-1))
    np.testing.assert_allclose(out["sum3"], g.rolling(3, min_periods=1).sum().to_numpy())


def test_running(spark, tiny_chunks, pdf):
    df = spark.createDataFrame(pdf)
    out = collect(O.running(df, ["key"], "k", {
        "total": (F.col("v"), "sum"), "top": (F.col("v"), "max"), "low": (F.col("v"), "min"),
        "seen": (F.when(F.col("v") > 7, F.col("v")), "max"),
        "bits": (F.col("v").cast("int"), "bit_or")}), "key", "k")
    g = pdf.groupby("key")["v"]
    np.testing.assert_allclose(out["total"], g.cumsum())
    np.testing.assert_allclose(out["top"], g.cummax())
    np.testing.assert_allclose(out["low"], g.cummin())
    want = pdf["v"].where(pdf["v"] > 7).groupby(pdf["key"]).cummax().groupby(pdf["key"]).ffill()
    np.testing.assert_array_equal(out["seen"].astype(float), want)
    bits = pdf.groupby("key")["v"].transform(
        lambda s: np.bitwise_or.accumulate(s.astype(int).to_numpy()))
    assert (out["bits"] == bits).all()


def test_quantiles(spark, tiny_chunks, pdf):
    df = spark.createDataFrame(pdf)
    out = collect(O.linear_quantiles(df, ["key"], "v", {"q": 0.3, "m": 0.5}), "key")
    want = pdf.groupby("key")["v"].quantile([0.3, 0.5]).unstack()
    np.testing.assert_allclose(out["q"], want[0.3])
    np.testing.assert_allclose(out["m"], want[0.5])
    whole = O.linear_quantiles(df, [], "v", {"q": 0.95}).first()
    assert whole["q"] == pytest.approx(pdf["v"].quantile(0.95)) and whole["rows"] == len(pdf)


def sizes_of(df, keys, order):
    chunked, split = O.with_chunk(df, keys, order)
    return {tuple(r)[:-1]: r["count"] for r in chunked.groupBy(*keys, O.CHUNK).count().collect()}, split


def test_long_run_is_split(spark, tiny_chunks, pdf):
    sizes, split = sizes_of(spark.createDataFrame(pdf), ["key"], ["at", "id"])
    assert split and max(sizes.values()) <= 14 and len([k for k in sizes if k[0] == 0]) > 10


SHAPES = {
    "outlier": lambda i: 1e12 if i == 77 else float(i),
    "low outlier": lambda i: -1e300 if i == 77 else float(i % 100),
    "one NaN": lambda i: float("nan") if i == 5 else float(i % 7),
    "all NaN": lambda i: float("nan"),
    "infinite": lambda i: float("inf") if i % 2 else float("-inf"),
    "one value": lambda i: 3.0,
    "nulls": lambda i: None if i % 3 else float(i),
    "exponential": lambda i: 1.01 ** i,
}


@pytest.mark.parametrize("shape", list(SHAPES))
def test_no_chunk_over_twice_the_target(spark, shape):
    """10,000 rows and chunks of 1000, cut by a sample of 64 rows per chunk; the run next to it is short."""
    rows = [(None if i % 2 else 1, SHAPES[shape](i), i) for i in range(20_000)] + [(2, 1.0, i) for i in range(10)]
    df = spark.createDataFrame(rows, "key long, v double, id long")
    spark.conf.set(O.CHUNK_ROWS_CONF, "1000")
    try:
        sizes, split = sizes_of(df, ["key"], ["v", "id"])
        assert split and max(sizes.values()) <= 2000
        assert all(7 <= len([k for k in sizes if k[0] == key]) <= 16 for key in (None, 1))
        assert sizes[2, 0] == 10
        got = {(r.key, r.id): r.k for r in O.number(df, ["key"], ["v", "id"]).collect()}
    finally:
        spark.conf.unset(O.CHUNK_ROWS_CONF)
    want = {(r.key, r.id): r.k for r in O.number(df, ["key"], ["v", "id"]).collect()}
    assert got == want and sorted(k for (key, _), k in got.items() if key == 1) == list(range(10_000))


def test_chunks_do_not_depend_on_partitions(spark, tiny_chunks, pdf):
    df = spark.createDataFrame(pdf)
    one, two = (O.with_chunk(d, ["key"], ["at", "id"])[0].select("id", O.CHUNK).collect()
                for d in (df, df.repartition(5, "v")))
    assert sorted(one) == sorted(two)


def test_neighbours_within_one_place(spark):
    """Many rows asked at one place are cut into chunks too; the mark there is both neighbours."""
    rows = [(1, 5, i, None) for i in range(60)] + [(1, 2, i, None) for i in range(60)]
    rows += [(1, 9, i, None) for i in range(60)] + [(1, p, -1, p) for p in (1, 5, 8)]
    df = spark.createDataFrame(rows, "key int, pos int, id int, m int")
    mark = F.when(F.col("m").isNotNull(), F.struct(F.col("m").alias("at")))

    def found():
        out = O.neighbours(df, ["key"], "pos", mark, "lo", "hi", "seen").where("m IS NULL")
        return {(r.pos, r.lo and r.lo.at, r.hi and r.hi.at, r.seen) for r in out.collect()}

    whole = found()
    assert whole == {(5, 5, 5, 2), (2, 1, 5, 1), (9, 8, None, 3)}
    spark.conf.set(O.CHUNK_ROWS_CONF, "7")
    try:
        assert found() == whole
    finally:
        spark.conf.unset(O.CHUNK_ROWS_CONF)


def test_running_plans_its_rows_once(spark, pdf):
    df = spark.createDataFrame(pdf)
    plan = O.running(df, ["key"], "k", {"total": (F.col("v"), "sum")})._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("LogicalRDD") <= 1


def test_window_is_not_over_the_whole_run(spark, tiny_chunks, pdf):
    plan = O.number(spark.createDataFrame(pdf.drop(columns="k")), ["key"], ["at", "id"])
    text = plan._jdf.queryExecution().toString()
    assert "windowspecdefinition(key" in text and "_chunk" in text.split("windowspecdefinition(key")[1][:40]

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fitlake.operators import series as S
from fitlake.operators import traces as T


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("base, kept", [(1.1, 76), (1.05, 134), (1.3, 32), (1.65, 19)])
def test_log_thinning_counts(spark, base, kept):
    steps = spark.range(5001).withColumnRenamed("id", "step")
    assert steps.where(T.ready(F.col("step"), base)).count() == kept


def test_nearest_step(spark):
    recorded = frame(spark, [(1, float(s), float(s)) for s in (0, 1, 2, 5, 8, 13)], "run long, step double, value double")
    asked = frame(spark, [(1, a) for a in (3.0, 6.5, 99.0, -4.0, 8.0)], "run long, asked double")
    got = {r["asked"]: (r["nearest"], r["index"], r["exact"], r["value"])
           for r in T.nearest_step(recorded, asked, carry=["value"]).collect()}
    assert got == {3.0: (2.0, 2, False, 2.0), 6.5: (5.0, 3, False, 5.0), 99.0: (13.0, 5, False, 13.0),
                   -4.0: (0.0, 0, False, 0.0), 8.0: (8.0, 4, True, 8.0)}


def test_nearest_step_in_split_runs(spark, tiny_chunks):
    gen = np.random.default_rng(0)
    steps = np.unique(gen.integers(0, 2000, 300))
    asks = gen.integers(-50, 2100, 200)
    recorded = frame(spark, [(1, int(s)) for s in steps], "run long, step long")
    asked = frame(spark, [(1, int(a)) for a in asks], "run long, asked long")
    got = T.nearest_step(recorded, asked).toPandas()
    assert len(got) == len(asks)
    for a, n, i in zip(got["asked"], got["nearest"], got["index"]):
        best = min(steps, key=lambda s: (abs(s - a), s))
        assert n == best and steps[i] == best


def test_decimate_keeps_both_ends(spark):
    rows = frame(spark, [(1, k) for k in range(401)] + [(2, k) for k in range(400)], "run long, k long")
    out = T.decimate(rows, "run", "k", 200).toPandas()
    one = sorted(out[out["run"] == 1]["k"])
    assert one[0] == 0 and one[-1] == 400 and one[1] == 2 and len(one) == 201
    assert len(out[out["run"] == 2]) == 400


def test_quantile_matches_numpy_and_flags_broken_traces(spark):
    gen = np.random.default_rng(1)
    rows, want = [], {}
    for run, n in ((1, 5), (2, 60), (3, 700), (4, 1)):
        steps = np.cumsum(gen.integers(1, 9, n))
        y = gen.normal(size=n)
        rows += [(run, k, int(s), float(v)) for k, (s, v) in enumerate(zip(steps, y))]
        x = np.linspace(max(steps[0], steps[-1] - 100), steps[-1], 4096)
        want[run] = np.quantile(np.interp(x, steps, y), 0.9)
    rows += [(5, 0, 1, 1.0), (5, 1, 2, math.nan), (5, 2, 3, 3.0), (6, 0, 1, 1.0), (6, 1, 2, math.inf)]
    df = frame(spark, rows, "run long, k long, step long, logl double")
    got = {r["run"]: r["quantile"] for r in T.windowed_quantile(df, 0.9, window=100).collect()}
    for run, q in want.items():
        assert got[run] == pytest.approx(q, abs=1e-9)
    assert got[5] == got[6] == -math.inf


def test_resample_clamps_and_hits_both_ends(spark):
    xs, ys = [0.0, 1.0, 4.0, 10.0], [0.0, 2.0, -1.0, 5.0]
    df = frame(spark, [(1, k, x, y) for k, (x, y) in enumerate(zip(xs, ys))],
               "run long, k long, x double, y double")
    out = S.resample(df, ["run"], "k", "x", "y", 75).orderBy("j").toPandas()
    grid = np.linspace(0, 10, 75)
    np.testing.assert_allclose(out["value"], np.interp(grid, xs, ys), atol=1e-9)


def test_merge_drops_only_trailing_gaps(spark):
    def part(values):
        return frame(spark, [(1, k, v) for k, v in values], "trial long, k long, value double")

    out = S.merge_on_axis({"a": part([(k, 1.0) for k in range(2, 10)]),
                           "b": part([(k, 2.0) for k in range(8) if k != 4])}).toPandas()
    assert sorted(out["k"]) == list(range(8))
    assert out[out["k"] == 4]["b"].isna().all() and out[out["k"] == 0]["a"].isna().all()


def test_padding_example(spark):
    rows = [(k, "u", float(k)) for k in range(10)] + [(k, "v", float(k)) for k in range(13)]
    df = frame(spark, rows, "k long, name string, value double")
    out = S.discard_padding(df, {"u": 0, "v": 3}).toPandas()
    first = out[out["k"] == 0].set_index("name")["value"]
    assert first["u"] == 3 and first["v"] == 0 and 1.0 + 3 * 0.01 == pytest.approx(1.03)
    assert (out.groupby("name")["k"].min() == 0).all()


def test_batches_match_brute_force(spark):
    df = frame(spark, [(t, k) for t in (1, 2) for k in range(97)], "trial long, k long")
    starts = [(1, 0, 0), (1, 1, 5), (1, 2, 87), (2, 0, 30)]
    out = S.batch_rows(df, frame(spark, starts, "trial long, batch long, b long"), "trial", 10)
    got = sorted((r["trial"], r["batch"], r["k"]) for r in out.collect())
    assert got == sorted((t, n, k) for t, n, b in starts for k in range(b, b + 10))

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fitlake.operators import convergence as C


@pytest.fixture(scope="module")
def example(spark):
    """Cost 10 exp(-s/30) (1 + sin s) over 300 steps with two slowly settling parameters."""
    rows, a, b = [], [0.5, -0.5], 3.0
    for s in range(300):
        if s:
            a, b = [x + s**-2.0 for x in a], b * (1 + s**-2.0)
        rows.append((1, s, s, 10 * math.exp(-s / 30) * (1 + math.sin(s)), a[0], a[1], b))
    return spark.createDataFrame(rows, "run long, k long, step long, cost double, a0 double, a1 double, b double")


def test_tests_match_plain_loops(spark, example):
    got = C.evaluate(example, {"cost": C.constant_cost("cost", n=6),
                               "par": C.constant_params(["a0", "a1", "b"], n=4)}).orderBy("k").toPandas()
    pdf = example.orderBy("k").toPandas()
    for k in range(300):
        c = pdf["cost"].to_numpy()
        still = k >= 5 and np.all(np.abs(c[k - 5:k] - c[k]) <= 2**-7)
        assert got["cost"][k] == (3 if still else 0)
        flat = k >= 3
        for name in ("a0", "a1", "b"):
            if k >= 3:
                m, b0 = np.polyfit(pdf["step"][k - 3:k + 1], pdf[name][k - 3:k + 1], 1)
                flat = flat and abs(m * k / (b0 + m * k)) <= 2**-6
        assert got["par"][k] == (1 if flat else 0)
    assert got["par"].iloc[-1] == 1 and got["cost"].iloc[-1] == 3
    status = C.run_status(C.evaluate(example, {"status": C.constant_cost("cost", n=6)}))
    reached = status.orderBy("k").toPandas()["run_status"]
    assert (reached[reached.to_numpy().argmax():] == 3).all()  # once converged, always converged


def test_combination_rules(spark):
    rows = [(a, b) for a in (0, 1, 3, -1) for b in (0, 1, 3, -1)]
    df = spark.createDataFrame(rows, "a int, b int").withColumn("c", C.both(F.col("a"), F.col("b")))
    got = {(r.a, r.b): r.c for r in df.collect()}
    assert got[(0, 3)] == 0 and got[(-1, 3)] == -1 and got[(3, 1)] == 1 and got[(3, -1)] == 3


def test_status_stream_and_failure_flag(spark):
    rows = [(1, k, k, s) for k, s in enumerate((0, 1, 0, 2))] + [(2, k, k, s) for k, s in enumerate((0, -1))]
    df = spark.createDataFrame(rows, "run long, k long, step long, status int")
    status = C.run_status(df)
    got = status.orderBy("run", "k").toPandas()
    assert list(got["run_status"]) == [0, 1, 1, 3, 0, -1]
    assert list(got["failed"]) == [False] * 5 + [True]
    ends = {r["run"]: (r["stop_step"], r["outcome"]) for r in C.outcomes(status).collect()}
    assert ends[1] == (3, "Status: <OptimizerStatus.Converged>")
    assert ends[2] == (1, "Status: <OptimizerStatus.Failed>")


def test_diverging_cost_directions(spark):
    rows = [(1, k, k, 0.0 if k < 10 else -150.0) for k in range(12)] + [(2, 0, 0, 1.0), (2, 1, 1, math.nan)]
    df = spark.createDataFrame(rows, "run long, k long, step long, v double")
    up = C.evaluate(df, {"s": C.diverging_cost("v", maximize=True)}).orderBy("run", "k").toPandas()
    assert list(up["s"]) == [0] * 10 + [-1, -1] + [0, -1]
    down = C.evaluate(df, {"s": C.diverging_cost("v", maximize=False)}).where("run = 1").toPandas()
    assert (down["s"] == 0).all()


def test_p_value_against_numerical_integration(spark):
    from fitlake.functions.scalars import t_test_p
    for dof in (1, 2, 3, 4, 7, 10):
        t = 1.7
        x = np.linspace(-t, t, 200001)
        pdf = (1 + x * x / dof) ** (-(dof + 1) / 2)
        pdf *= math.gamma((dof + 1) / 2) / (math.sqrt(dof * math.pi) * math.gamma(dof / 2))
        want = 1 - float(np.sum((pdf[1:] + pdf[:-1]) / 2) * (x[1] - x[0]))
        got = spark.range(1).select(t_test_p(F.lit(t), dof).alias("p")).first()["p"]
        assert got == pytest.approx(want, abs=1e-6)

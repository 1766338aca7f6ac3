"""Convergence tests over recorded traces, one status per run and step.

Statuses are bit masks. Fixed values: 0 not converged, 1 parameters, 2 latents, 3 both, -1 failed.
All tests take traces with a dense record index ``k`` from 0 next to the recorded ``step``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from fitlake.functions.scalars import t_test_p
from fitlake.operators.ordered import frames, running

NOT_CONVERGED, PARAMS, LATENTS, CONVERGED, FAILED = 0, 1, 2, 3, -1


@dataclass(frozen=True)
class Test:
    """A convergence test: window columns over the records before a step, and a status of them."""

    before: int
    columns: Mapping[str, Callable[[WindowSpec], Column]]
    status: Column
    first: str | None = None  # column whose first value the status needs, as ``_first``


def diverging_cost(value: str, maximize: bool = True, tol: float = 100.0) -> Test:
    change = F.col(value) - F.col("_first")
    worse = -change if maximize else change
    broken = F.isnan(change) | (F.abs(change) == float("inf"))
    return Test(0, {}, F.when(broken | ((F.col("k") >= 10) & (worse > tol)), FAILED)
                .otherwise(NOT_CONVERGED), value)


def constant_cost(value: str, n: int, tol: float = 2**-7) -> Test:
    v = F.col(value)
    columns = {"_c_hi": lambda w: F.max(v).over(w.rowsBetween(-(n - 1), -1)),
               "_c_lo": lambda w: F.min(v).over(w.rowsBetween(-(n - 1), -1)),
               "_c_n": lambda w: F.count(v).over(w.rowsBetween(-(n - 1), 0))}
    still = (F.col("_c_n") == n) & (F.col("_c_hi") - v < tol) & (v - F.col("_c_lo") < tol)
    return Test(n - 1, columns, F.when(still, CONVERGED).otherwise(NOT_CONVERGED))


def _slopes(values: Sequence[str], lo: int, hi: int) -> dict:
    x = F.col("step").cast("double")
    out = {}
    for v in values:
        out[f"_m_{v}"] = lambda w, v=v: F.regr_slope(v, x).over(w.rowsBetween(lo, hi))
        out[f"_b_{v}"] = lambda w, v=v: F.regr_intercept(v, x).over(w.rowsBetween(lo, hi))
    return out


def constant_params(values: Sequence[str], n: int, rtol: float = 2**-6) -> Test:
    """Converged where the regression over the last n records predicts no relative change."""
    s = F.col("step").cast("double")
    columns = {**_slopes(values, -(n - 1), 0),
               "_p_n": lambda w: F.count("*").over(w.rowsBetween(-(n - 1), 0))}
    still = F.col("_p_n") == n
    for v in values:
        m, b = F.col(f"_m_{v}"), F.col(f"_b_{v}")
        # a NaN would equal a NaN
        still = still & ~F.isnan(m) & ((m == 0) | (F.abs(m * s) <= rtol * F.abs(b + m * s)))
    return Test(n - 1, columns, F.when(still, PARAMS).otherwise(NOT_CONVERGED))


def evaluate(df: DataFrame, tests: Mapping[str, Test], key: str = "run") -> DataFrame:
    """Status of each test at each record, all tests in one pass over the traces."""
    columns = {n: c for t in tests.values() for n, c in t.columns.items()}
    first = {t.first for t in tests.values() if t.first}
    if len(first) > 1:
        raise ValueError("tests against the first value must share its column")
    out = df
    if first:
        start = df.groupBy(key).agg(F.min_by(first.pop(), "k").alias("_first"))
        out = out.join(start, key)
    if columns:
        out = frames(out, [key], "k", columns, before=max(t.before for t in tests.values()))
    return out.select(key, "k", "step", *[t.status.alias(n) for n, t in tests.items()])


def both(first: Column, second: Column) -> Column:
    """``first & second``; a first result of not converged or failed stands."""
    return F.when(first.isin(NOT_CONVERGED, FAILED), first).otherwise(first.bitwiseAND(second))


def sticky(results: DataFrame, status: str, evaluated: Column, key: str = "run") -> DataFrame:
    """Result at every step: the latest one evaluated, or not converged before the first."""
    latest = F.when(evaluated, F.struct("k", F.col(status).alias("_new")))
    return running(results, [key], "k", {"_last": (latest, "max")}).select(
        key, "k", "step", F.coalesce("_last._new", F.lit(NOT_CONVERGED)).alias("status"))


def run_status(tests: DataFrame, key: str = "run") -> DataFrame:
    """Running status of a run: bitwise OR of all test results so far."""
    return running(tests, [key], "k", {
        "run_status": (F.col("status"), "bit_or"),
        "failed": ((F.col("status") == FAILED).cast("int"), "max")}).withColumn(
        "failed", F.col("failed") == 1)


def outcomes(status: DataFrame, key: str = "run") -> DataFrame:
    """Where each run stops, and the text of its outcome."""
    done = (F.col("run_status").bitwiseAND(CONVERGED) == CONVERGED)
    ends = status.groupBy(key).agg(
        F.min(F.when(F.col("failed"), F.col("step"))).alias("failed_at"),
        F.min(F.when(done & ~F.col("failed"), F.col("step"))).alias("converged_at"),
        F.max("step").alias("last_step"))
    failed = F.col("failed_at").isNotNull() & (
        F.col("converged_at").isNull() | (F.col("failed_at") < F.col("converged_at")))
    text = (F.when(failed, "Status: <OptimizerStatus.Failed>")
            .when(F.col("converged_at").isNotNull(), "Status: <OptimizerStatus.Converged>")
            .otherwise("Status: <OptimizerStatus.NotConverged>"))
    return ends.select(key, F.coalesce(F.when(failed, F.col("failed_at")), "converged_at",
                                       "last_step").alias("stop_step"), text.alias("outcome"))


def regression_report(df: DataFrame, value: str, n: int, key: str = "run") -> DataFrame:
    """Rolling regression on the n records before each step, with its projection to twice the
    step, the relative change of that projection and the p-value of a zero slope."""
    s = F.col("step").cast("double")
    fit = frames(df, [key], "k", {
        **_slopes([value], -n, -1),
        "r2": lambda w: F.regr_r2(value, s).over(w.rowsBetween(-n, -1)),
        "_n": lambda w: F.count("*").over(w.rowsBetween(-n, -1))}, before=n).where(F.col("_n") == n)
    m, b = F.col(f"_m_{value}"), F.col(f"_b_{value}")
    now, later = b + m * s, b + 2 * m * s
    t = F.sqrt(F.try_divide(F.col("r2") * (n - 2), 1 - F.col("r2")))
    return fit.select(key, "step", m.alias("slope"), later.alias("projected"),
                      F.abs(F.try_divide(later - now, now)).alias("change"),
                      F.when(F.col("r2") == 1, 0.0).otherwise(t_test_p(t, n - 2)).alias("p_value"))


def restart_report(runs: DataFrame) -> DataFrame:
    """Runs that need no further steps because they already failed or converged."""
    done = F.col("run_status").bitwiseAND(CONVERGED) == CONVERGED
    return runs.where(F.col("failed") | done).withColumn("message", F.concat(
        F.lit("Fit already "), F.when(F.col("failed"), "failed").otherwise("converged"),
        F.lit(" at step "), F.col("step").cast("string")))

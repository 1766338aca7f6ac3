"""Convergence tests on the long traces of the line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from fitlake.operators import convergence as C
from fitlake.operators import traces as T
from fitlake.queries.common import SERIES
from fitlake.queries.registry import query
from fitlake.sources.tables import series

BASE = f"""{SERIES},
b AS (SELECT trial AS run, k, k AS step, x0, x1,
             CASE WHEN k % 251 = 250 AND trial % 5 = 0 THEN 'NaN'::DOUBLE ELSE x1 END AS xn, x2
      FROM series)"""
DIVERGING = """div AS (
  SELECT b.run, b.k, b.step, CASE WHEN isnan(b.xn - f.xn) OR (b.k >= 10 AND f.xn - b.xn > 60000)
         THEN -1 ELSE 0 END AS status
  FROM b JOIN (SELECT run, xn FROM b WHERE k = 0) f USING (run))"""
CONSTANT = """cost AS (
  SELECT run, k, step, CASE WHEN count(*) OVER w2 = 3 AND max(x2) OVER w - x2 < 0.0078125
         AND x2 - min(x2) OVER w < 0.0078125 THEN 3 ELSE 0 END AS status
  FROM b WINDOW w AS (PARTITION BY run ORDER BY k ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING),
                w2 AS (PARTITION BY run ORDER BY k ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))"""
PARAMS = """fit AS (
  SELECT run, k, step::DOUBLE AS s, count(*) OVER w AS n,
         regr_slope(x0, step::DOUBLE) OVER w AS m0, regr_intercept(x0, step::DOUBLE) OVER w AS b0,
         regr_slope(x1, step::DOUBLE) OVER w AS m1, regr_intercept(x1, step::DOUBLE) OVER w AS b1
  FROM b WINDOW w AS (PARTITION BY run ORDER BY k ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
par AS (
  SELECT run, k, s::BIGINT AS step, CASE WHEN n = 4
    AND (m0 = 0 OR abs(m0 * s) <= 0.9 * abs(b0 + m0 * s))
    AND (m1 = 0 OR abs(m1 * s) <= 0.9 * abs(b1 + m1 * s)) THEN 1 ELSE 0 END AS status FROM fit)"""


def base(spark, sf):
    broken = (F.col("k") % 251 == 250) & (F.col("trial") % 5 == 0)
    return series(spark, sf).select(
        F.col("trial").alias("run"), "k", F.col("k").alias("step"), "x0", "x1",
        F.when(broken, F.lit(float("nan"))).otherwise(F.col("x1")).alias("xn"), "x2")


TESTS = {"div": lambda: C.diverging_cost("xn", tol=60000.0),
         "cost": lambda: C.constant_cost("x2", n=3),
         "par": lambda: C.constant_params(["x0", "x1"], n=4, rtol=0.9)}


def evaluated(spark, sf, *names):
    return C.evaluate(base(spark, sf), {n: TESTS[n]() for n in names})


@query("cnv1_diverging_cost", f"WITH {BASE}, {DIVERGING} SELECT * FROM div")
def _(spark, sf):
    return evaluated(spark, sf, "div").withColumnRenamed("div", "status")


@query("cnv2_constant_cost", f"WITH {BASE}, {CONSTANT} SELECT * FROM cost")
def _(spark, sf):
    return evaluated(spark, sf, "cost").withColumnRenamed("cost", "status")


@query("cnv3_constant_params", f"WITH {BASE}, {PARAMS} SELECT * FROM par")
def _(spark, sf):
    return evaluated(spark, sf, "par").withColumnRenamed("par", "status")


@query("cnv4_combined_test", f"""
WITH {BASE}, {CONSTANT}, {PARAMS}
SELECT run, k, cost.step, CASE WHEN cost.status IN (0, -1) THEN cost.status
                          ELSE cost.status & par.status END AS status
FROM cost JOIN par USING (run, k)""")
def _(spark, sf):
    return evaluated(spark, sf, "cost", "par").select(
        "run", "k", "step", C.both(F.col("cost"), F.col("par")).alias("status"))


@query("cnv5_sticky_result", f"""
WITH {BASE}, {CONSTANT}
SELECT run, k, step, coalesce(last_value(CASE WHEN k % 5 = 0 THEN status END IGNORE NULLS)
       OVER (PARTITION BY run ORDER BY k), 0) AS status
FROM cost""")
def _(spark, sf):
    return C.sticky(evaluated(spark, sf, "cost"), "cost", T.ready(F.col("k"), 5, "linear"))


STATUS = f"""{DIVERGING}, {CONSTANT}, {PARAMS},
t AS (SELECT run, k, cost.step, (CASE WHEN cost.status IN (0, -1) THEN cost.status
        ELSE cost.status & par.status END) | div.status AS status, div.status AS d
      FROM cost JOIN par USING (run, k) JOIN div USING (run, k)),
st AS (SELECT run, k, step, status, bit_or(status) OVER w AS run_status,
              bool_or(d = -1) OVER w AS failed
       FROM t WINDOW w AS (PARTITION BY run ORDER BY k))"""


def status(spark, sf):
    tests = evaluated(spark, sf, "div", "cost", "par")
    default = C.both(F.col("cost"), F.col("par"))
    results = tests.select("run", "k", "step", default.bitwiseOR(F.col("div")).alias("status"))
    return C.run_status(results)


@query("cnv6_run_status", f"""
WITH {BASE}, {STATUS} SELECT run, k, step, status, run_status, failed FROM st""")
def _(spark, sf):
    return status(spark, sf)


@query("cnv6_outcomes", f"""
WITH {BASE}, {CONSTANT}, {DIVERGING},
st AS (SELECT run, step, bit_or(cost.status) OVER w AS rs, bool_or(div.status = -1) OVER w AS failed
       FROM cost JOIN div USING (run, k, step) WINDOW w AS (PARTITION BY run ORDER BY k)),
e AS (SELECT run, min(step) FILTER (WHERE failed) AS f,
             min(step) FILTER (WHERE rs & 3 = 3 AND NOT failed) AS c, max(step) AS l
      FROM st GROUP BY run)
SELECT run, CASE WHEN f IS NOT NULL AND (c IS NULL OR f < c) THEN f ELSE coalesce(c, l) END AS stop_step,
       'Status: <OptimizerStatus.' || CASE WHEN f IS NOT NULL AND (c IS NULL OR f < c) THEN 'Failed'
         WHEN c IS NOT NULL THEN 'Converged' ELSE 'NotConverged' END || '>' AS outcome
FROM e""")
def _(spark, sf):
    tests = evaluated(spark, sf, "div", "cost").select(
        "run", "k", "step", F.col("cost").bitwiseOR(F.col("div")).alias("status"))
    return C.outcomes(C.run_status(tests))


@query("cnv7_regression_report", f"""
WITH {BASE}, f AS (
  SELECT run, step::DOUBLE AS s, count(*) OVER w AS n, regr_slope(x1, step::DOUBLE) OVER w AS m,
         regr_intercept(x1, step::DOUBLE) OVER w AS b, regr_r2(x1, step::DOUBLE) OVER w AS r2
  FROM b WINDOW w AS (PARTITION BY run ORDER BY k ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
p AS (SELECT *, b + m * s AS now, b + 2 * m * s AS later, atan(sqrt(r2 * 4 / (1 - r2)) / 2) AS th
      FROM f WHERE n = 6)
SELECT run, s::BIGINT AS step, round(m, 3) AS slope, round(later, 2) AS projected,
       round(abs((later - now) / now), 4) AS change,
       round(1 - sin(th) * (1 + cos(th) * cos(th) / 2), 6) AS p_value
FROM p""")
def _(spark, sf):
    report = C.regression_report(base(spark, sf), "x1", 6)
    return report.select("run", "step", F.round("slope", 3).alias("slope"),
                         F.round("projected", 2).alias("projected"),
                         F.round("change", 4).alias("change"),
                         F.round("p_value", 6).alias("p_value"))


@query("fit5_restart_detection", f"""
WITH {BASE}, {STATUS}, l AS (
  SELECT run, step, run_status, failed FROM st
  QUALIFY row_number() OVER (PARTITION BY run ORDER BY k DESC) = 1)
SELECT run, step, 'Fit already ' || CASE WHEN failed THEN 'failed' ELSE 'converged' END
       || ' at step ' || step AS message
FROM l WHERE failed OR run_status & 3 = 3""")
def _(spark, sf):
    last = F.max_by(F.struct("step", "run_status", "failed"), "k")
    runs = status(spark, sf).groupBy("run").agg(last.alias("l")).select("run", "l.*")
    return C.restart_report(runs).select("run", "step", "message")

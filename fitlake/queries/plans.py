"""Composed plans and user hooks."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fitlake.functions import objectives as O
from fitlake.functions.labels import duration_text
from fitlake.operators import convergence as C
from fitlake.operators import fit as T
from fitlake.operators import likelihood as K
from fitlake.operators import runs as R
from fitlake.operators.traces import ready
from fitlake.plans import hooks as H
from fitlake.plans.alternate import alternated_fit
from fitlake.plans.analysis import compare_fits
from fitlake.plans.scoring import score_batches
from fitlake.queries.common import RUNS, SERIES, TRACES
from fitlake.queries.likelihood import DT, L1, LATENT, LOG_SIGMA, MU, NOISE, SE, SEEN, VIEW, W, cols, view
from fitlake.queries.registry import query
from fitlake.queries.runs import DURATION_SQL
from fitlake.sources.tables import runs, series, table, traces


@query("sort1_sorted_catalogue", f"""
WITH {RUNS} SELECT nation, split, run, label FROM runs ORDER BY nation, split, run""")
def _(spark, sf):
    return runs(spark, sf).select("nation", "split", "run", "label").orderBy("nation", "split", "run")


@query("scl8_formatting", f"""
WITH {RUNS} SELECT run, {DURATION_SQL} AS duration, round(score / 7e0, 2) AS score FROM runs""")
def _(spark, sf):
    return runs(spark, sf).select("run", duration_text(F.col("duration_s")).alias("duration"),
                                  F.round(F.col("score") / 7, 2).alias("score"))


@query("plan_compare_fits", f"""
WITH {TRACES}, {RUNS},
f AS (SELECT * FROM runs WHERE NOT coalesce(contains(outcome, '<OptimizerStatus.Failed>'), false)),
o AS (SELECT f.run, split, nation, row_number() OVER (PARTITION BY split, init_key ORDER BY stepi DESC, f.run) AS rn
      FROM f JOIN (SELECT run, max(step) AS stepi FROM traces GROUP BY run) USING (run)),
q AS (SELECT run, quantile_cont(logl, 0.95) AS score FROM traces GROUP BY run),
r AS (SELECT 'Split: ' || split AS split_label, run, score, row_number() OVER (PARTITION BY split ORDER BY score DESC, run) AS rn2,
             count(*) OVER (PARTITION BY split) AS n_fits
      FROM o JOIN q USING (run) WHERE rn = 1)
SELECT split_label, run, round(score, 5) AS score, n_fits FROM r WHERE rn2 = 1""")
def _(spark, sf):
    df = runs(spark, sf).withColumn("model", F.lit("WC"))
    return compare_fits(df, traces(spark, sf), ["split", "init_key"], ["split", "model"]).withColumn(
        "score", F.round("score", 5))


@query("plan_score_batches")
def _(spark, sf):
    lp = O.white_noise([F.col("x2"), F.col("x3")], MU, LOG_SIGMA, DT)
    return score_batches(series(spark, sf), lp, 200, start=30, length=400, Kb=40, Nb=6)


@query("plan_alternated_fit")
def _(spark, sf):
    trace, _ = alternated_fit(
        view(spark, sf), "trial", ["x2", "x3"], ["y0", "y1"], W, DT,
        [0.0, math.log(0.5), math.log(2.0)], {"x2": 1e-3, "x3": 1e-3}, rounds=2, Kb=50, Nb=10,
        latent_steps=2, settings=T.Adam(rate=0.05))
    return trace


@query("udf1_recorder_callback", f"""
WITH {SERIES} SELECT trial AS run, k AS step, x0 * 2 AS twice, x1 > 50000 AS large FROM series
WHERE k < 2 OR floor(ln(k) / ln(1.3::DOUBLE)) <> floor(ln(k - 1) / ln(1.3::DOUBLE))""")
def _(spark, sf):
    steps = series(spark, sf).withColumnsRenamed({"trial": "run", "k": "step"})
    return H.record(steps, lambda df: {"twice": df.x0 * 2, "large": df.x1 > 50000},
                    ready(F.col("step"), 1.3))


@query("udf2_record_condition", f"""
WITH {SERIES} SELECT trial AS run, k AS step, x1 AS value FROM series WHERE x0 > 40 AND k % 3 = 0""")
def _(spark, sf):
    steps = series(spark, sf).withColumnsRenamed({"trial": "run", "k": "step"})
    return H.record(steps, lambda df: {"value": df.x1}, (F.col("x0") > 40) & (F.col("step") % 3 == 0))


@query("udf3_fit_filter", f"""
WITH {RUNS} SELECT run, outcome FROM runs
WHERE NOT coalesce(contains(outcome, '<OptimizerStatus.Failed>'), false) AND score > nation * 100""")
def _(spark, sf):
    fits = H.filter_fits(runs(spark, sf), "nofail")
    return H.filter_fits(fits, lambda df: df.score > df.nation * 100).select("run", "outcome")


@query("udf4_split_field", f"""
WITH {RUNS} SELECT CASE WHEN score < 0 THEN 'debt' ELSE 'credit' END AS sign, count(*) AS n_records
FROM runs GROUP BY 1""")
def _(spark, sf):
    df = H.add_field(runs(spark, sf), "sign", lambda r: F.when(r.score < 0, "debt").otherwise("credit"))
    return R.counts(df, "sign")


@query("udf5_registered_objective", f"""
WITH {VIEW} SELECT trial, round(sum(2 * ({SE}) + {L1}), 5) AS objective FROM v GROUP BY trial""")
def _(spark, sf):
    H.register_objective("mixing", lambda kind="se": (O.mixing_se if kind == "se" else O.mixing_l1)(
        W, cols(*LATENT), cols(*SEEN)), "nodyn")
    both = 2 * H.objective("mixing") + H.objective("mixing", kind="l1")
    return view(spark, sf).groupBy("trial").agg(F.round(F.sum(both()), 5).alias("objective"))


@query("udf6_rate_update", """
SELECT s_suppkey AS set_id, round(0.1 * exp((s_nationkey - 12) / 10e0), 9) AS rate FROM supplier""")
def _(spark, sf):
    latents = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("set_id"), F.lit(0.1).alias("rate"))
    stats = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("set_id"), F.exp((F.col("s_nationkey") - 12) / 10).alias("std"))
    return H.update_rates(latents, stats, lambda a, b: a.join(b, "set_id").select(
        "set_id", F.round(a.rate * b.std, 9).alias("rate")))


@query("udf7_custom_distribution")
def _(spark, sf):
    axis = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return H.custom_draws(axis, "value", lambda g: g.gamma(2.0), "o_orderkey", stream="gamma")


@query("udf8_custom_test", f"""
WITH {SERIES} SELECT trial AS run, k, k AS step,
  CASE WHEN count(*) OVER w = 3 AND min(x0) OVER w > 20 THEN 1 ELSE 0 END AS high
FROM series WINDOW w AS (PARTITION BY trial ORDER BY k ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def _(spark, sf):
    df = series(spark, sf).select(F.col("trial").alias("run"), "k", F.col("k").alias("step"), "x0")
    test = C.Test(2, {"_lo": lambda w: F.min("x0").over(w.rowsBetween(-2, 0)),
                      "_n": lambda w: F.count("x0").over(w.rowsBetween(-2, 0))},
                  F.when((F.col("_n") == 3) & (F.col("_lo") > 20), 1).otherwise(0))
    return C.evaluate(df, {"high": test})


@query("udf9_curve_weights", f"""
WITH {VIEW}, q AS (SELECT trial AS run, trial % 7 AS grp, sum({NOISE}) / 100 AS q FROM v GROUP BY trial)
SELECT run, grp, round(CASE WHEN m - q >= 2 THEN 0 ELSE 1 - (m - q) / 2 END, 6) AS weight
FROM (SELECT *, max(q) OVER (PARTITION BY grp) AS m FROM q)""")
def _(spark, sf):
    lp = O.white_noise(cols(*LATENT), MU, LOG_SIGMA, DT)
    scores = K.segment_scores(view(spark, sf), ["trial"], {"q": lp / 100}).select(
        F.col("trial").alias("run"), (F.col("trial") % 7).alias("grp"), "q")
    return H.weigh(scores, lambda df: R.accent_weights(df, "grp", "q")).select(
        "run", "grp", F.round("weight", 6).alias("weight"))

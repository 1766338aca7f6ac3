"""Recorded traces of fit runs: selection, thinning, nearest step, quantiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from fitlake.operators import traces as T
from fitlake.operators.ordered import number
from fitlake.operators.series import components, resample, slices
from fitlake.queries.common import NAN_TRACES, RUNS, SERIES, TRACES
from fitlake.queries.registry import query
from fitlake.session import written
from fitlake.sources.tables import irregular, runs, series, table, traces

LONG_SQL = """long AS (
  SELECT trial AS run, k AS step, 'Θ' AS key, 0 AS idx, x0 AS value FROM series UNION ALL
  SELECT trial, k, 'Θ', 1, x1 FROM series UNION ALL
  SELECT trial, k, 'η', 0, x2 FROM series UNION ALL SELECT trial, k, 'η', 1, x3 FROM series)"""


def theta(spark, sf):
    """One parameter trace per run: step k, value x1."""
    return series(spark, sf).select(F.col("trial").alias("run"), F.col("k").alias("step"),
                                    F.col("x1").alias("value"))


def long_trace(spark, sf):
    return components(series(spark, sf), {("Θ", 0): "x0", ("Θ", 1): "x1", ("η", 0): "x2",
                                          ("η", 1): "x3"}).select(
        F.col("trial").alias("run"), F.col("k").alias("step"), F.col("name").alias("key"), "idx",
        "value")


@query("trc1_log_thinning", f"""
WITH {SERIES}
SELECT trial AS run, k AS step, x1 AS value FROM series
WHERE k < 2 OR floor(ln(k) / ln(1.1::DOUBLE)) <> floor(ln(k - 1) / ln(1.1::DOUBLE))""")
def _(spark, sf):
    return theta(spark, sf).where(T.ready(F.col("step"), 1.1))


@query("trc1_linear_thinning", f"""
WITH {SERIES} SELECT trial AS run, k AS step, x1 AS value FROM series WHERE k % 7 = 0""")
def _(spark, sf):
    return theta(spark, sf).where(T.ready(F.col("step"), 7, "linear"))


@query("trc2_windowed_quantile", f"""
WITH {NAN_TRACES}, e AS (
  SELECT run, min(step) AS x0, max(step) AS xn, bool_or(isnan(logl)) AS bad,
         greatest(min(step), max(step) - 12)::DOUBLE AS f FROM traces GROUP BY run),
g AS (SELECT run, f + j * ((xn - f) / 4095) AS at FROM e, range(4096) r(j) WHERE NOT bad),
p AS (SELECT run, step, logl, lead(step) OVER w AS xb, lead(logl) OVER w AS yb FROM traces
      WINDOW w AS (PARTITION BY run ORDER BY step)),
v AS (SELECT g.run, CASE WHEN p.xb IS NULL THEN p.logl
             ELSE p.logl + (g.at - p.step) * (p.yb - p.logl) / (p.xb - p.step) END AS y
      FROM g ASOF JOIN p ON g.run = p.run AND g.at >= p.step)
SELECT run, round(quantile_cont(y, 0.95), 4) AS quantile FROM v GROUP BY run
UNION ALL SELECT run, '-inf'::DOUBLE FROM e WHERE bad""")
def _(spark, sf):
    df = traces(spark, sf, with_nan=True).withColumn("k", F.col("step") - 1)
    return T.windowed_quantile(df, 0.95, window=12).select(
        "run", F.round("quantile", 4).alias("quantile"))


@query("sort2_best_fit_per_group", f"""
WITH {TRACES}, {RUNS}, q AS (SELECT run, quantile_cont(logl, 0.95) AS q FROM traces GROUP BY run),
r AS (SELECT split, lam, run, q, row_number() OVER (PARTITION BY split, lam ORDER BY q DESC, run) AS rn
      FROM q JOIN runs USING (run) WHERE NOT contains(outcome, '<OptimizerStatus.Failed>'))
SELECT split || '|' || lam AS grp, run, round(q, 5) AS q FROM r WHERE rn = 1""")
def _(spark, sf):
    from fitlake.operators.ordered import linear_quantiles
    from fitlake.operators.runs import best_per_group, without_failed
    q = linear_quantiles(traces(spark, sf), ["run"], "logl", {"q": 0.95})
    fits = without_failed(runs(spark, sf)).join(q, "run").withColumn(
        "grp", F.concat_ws("|", "split", "lam"))
    return best_per_group(fits, "grp", "q", "run").withColumn("q", F.round("q", 5))


@query("win1_without_repeats", """
WITH e AS (SELECT user_id AS trial, event_id, event_type AS name,
  lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
SELECT trial, event_id, name FROM e WHERE prev IS NULL OR prev <> name""")
def _(spark, sf):
    arrivals = number(irregular(spark, sf), ["trial"], ["t", "event_id"])
    return T.without_repeats(arrivals, ["trial"], "k", ["name"]).select("trial", "event_id", "name")


@query("win2_first_at_targets", f"""
WITH {SERIES}, u AS (
  SELECT trial AS run, k // 12 AS step, k AS arrival, 100 - 8 * (k % 12) - x0::BIGINT % 8 AS b
  FROM series WHERE x0::BIGINT % 3 <> 0),
n AS (SELECT *, (b <= 90)::INT + (b <= 60)::INT + (b <= 25)::INT AS reached FROM u)
SELECT run, step, arrival, b, reached FROM n
QUALIFY reached > coalesce(lag(reached) OVER (PARTITION BY run, step ORDER BY arrival), 0)""")
def _(spark, sf):
    q = F.col("x0").cast("long")
    updates = series(spark, sf).select(
        F.col("trial").alias("run"), F.floor(F.col("k") / 12).alias("step"),
        F.col("k").alias("arrival"), (100 - 8 * (F.col("k") % 12) - q % 8).alias("b"),
        F.when(q % 3 == 0, "θ").otherwise("η_default").alias("context"))
    return T.first_at_targets(updates, [90, 60, 25]).drop("context")


@query("win8_decimate", f"""
WITH {SERIES}, n AS (SELECT trial, count(*) AS n FROM series GROUP BY trial)
SELECT trial AS run, k AS step, x1 AS value FROM series JOIN n USING (trial)
WHERE n <= 400 OR k % (n // 200) = 0 OR k = n - 1""")
def _(spark, sf):
    return T.decimate(theta(spark, sf), "run", "step", 200)


@query("win9_increments", f"""
WITH {SERIES}
SELECT trial AS run, k AS step, round(x1 - lag(x1) OVER (PARTITION BY trial ORDER BY k), 4) AS diff
FROM series QUALIFY k > 0""")
def _(spark, sf):
    return T.increments(theta(spark, sf), "run", "step", "value").select(
        "run", "step", F.round("diff", 4).alias("diff"))


@query("win6_resample_75", f"""
WITH {SERIES}, e AS (SELECT trial, max(k) AS kn FROM series GROUP BY trial),
g AS (SELECT trial, j, j * (kn / 74e0) AS at FROM e, range(75) r(j)),
p AS (SELECT trial, k, x1, lead(x1) OVER (PARTITION BY trial ORDER BY k) AS xb FROM series)
SELECT g.trial AS run, g.j::INTEGER AS j, round(g.at, 6) AS at,
       round(coalesce(x1 + (g.at - k) * (xb - x1), x1), 3) AS value
FROM g ASOF JOIN p ON g.trial = p.trial AND g.at + 1e-7 >= p.k""")
def _(spark, sf):
    out = resample(theta(spark, sf), ["run"], "step", "step", "value", 75)
    return out.select("run", F.col("j").cast("int").alias("j"), F.round("at", 6).alias("at"),
                      F.round("value", 3).alias("value"))


def recorded_and_asked(spark, sf):
    recorded = theta(spark, sf).where((F.col("step") % 7).isin(0, 3))
    asked = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("run"),
        (F.col("l_linenumber") * 83 + F.col("l_partkey") % 90).cast("long").alias("asked")).distinct()
    return recorded, asked


NEAREST_SQL = """nearest_of AS (
  SELECT a.run, a.asked, lo.step AS prev, hi.step AS nxt
  FROM (SELECT DISTINCT l_suppkey AS run, l_linenumber * 83 + l_partkey % 90 AS asked FROM lineitem) a
  ASOF LEFT JOIN recorded lo ON lo.run = a.run AND lo.step <= a.asked
  ASOF LEFT JOIN recorded hi ON hi.run = a.run AND hi.step >= a.asked)"""


@query("join4_nearest_step", f"""
WITH {SERIES},
recorded AS (SELECT trial AS run, k AS step, x1 AS value,
    row_number() OVER (PARTITION BY trial ORDER BY k) - 1 AS idx FROM series WHERE k % 7 IN (0, 3)),
{NEAREST_SQL},
p AS (SELECT run, asked, CASE WHEN nxt IS NULL OR asked - prev <= nxt - asked THEN prev ELSE nxt END AS nearest
      FROM nearest_of)
SELECT p.run, p.asked, p.nearest, r.idx AS index, r.value, p.asked = p.nearest AS exact
FROM p JOIN recorded r ON r.run = p.run AND r.step = p.nearest""")
def _(spark, sf):
    recorded, asked = recorded_and_asked(spark, sf)
    return T.nearest_step(recorded, asked, carry=["value"])


@query("join5_rebuild_state", f"""
WITH {SERIES},
latents AS (SELECT trial AS run, k AS step FROM series WHERE k % 10 = 0),
params AS (SELECT trial AS run, k AS step FROM series WHERE k % 4 = 1),
a AS (SELECT s_suppkey AS run, unnest([-1, 5, 123, 400]) AS request FROM supplier),
w AS (SELECT a.run, request, CASE WHEN request = -1 THEN m ELSE request END AS asked
      FROM a JOIN (SELECT run, max(step) AS m FROM latents GROUP BY run) USING (run)),
l AS (SELECT w.run, request, arg_min(step, abs(step - asked) * 2 + (step > asked)::INT) AS latent_step
      FROM w JOIN latents USING (run) GROUP BY w.run, request),
p AS (SELECT l.run, request, latent_step,
             arg_min(step, abs(step - latent_step) * 2 + (step > latent_step)::INT) AS param_step
      FROM l JOIN params USING (run) GROUP BY l.run, request, latent_step)
SELECT p.run, request::BIGINT AS request, latent_step, param_step, latent_step <> param_step AS differs,
       count(*) AS n_obs, round(sum(x1), 2) AS sum_obs
FROM p JOIN series s ON s.trial = p.run AND s.k BETWEEN latent_step AND latent_step + 20
GROUP BY ALL""")
def _(spark, sf):
    # lines are numbered once; latents, parameters and observations read the result
    data = written(series(spark, sf).select(F.col("trial").alias("run"), F.col("k").alias("step"), "x1"), "series")
    latents = data.where("step % 10 = 0")
    params = data.where("step % 4 = 1")
    asked = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("run"),
        F.explode(F.array(*[F.lit(s).cast("long") for s in (-1, 5, 123, 400)])).alias("asked"))
    state = T.rebuild_state(latents, params, asked).withColumn(
        "until", F.col("latent_step") + 20)
    observed = slices(data.withColumnRenamed("step", "k"), state, "run", "k", "latent_step",
                      "until", width=32)
    return observed.groupBy("run", "request", "latent_step", "param_step", "differs").agg(
        F.count("*").alias("n_obs"), F.round(F.sum("x1"), 2).alias("sum_obs"))


@query("join6_also_recorded", f"""
WITH {SERIES}, l AS (SELECT trial, k FROM series WHERE k < 2 OR
  floor(ln(k) / ln(1.65::DOUBLE)) <> floor(ln(k - 1) / ln(1.65::DOUBLE)))
SELECT trial AS run, k AS step, x1 AS value FROM series
WHERE k < 2 OR floor(ln(k) / ln(1.1::DOUBLE)) <> floor(ln(k - 1) / ln(1.1::DOUBLE))
   OR (trial, k) IN (SELECT trial, k FROM l)""")
def _(spark, sf):
    thetas = theta(spark, sf)
    latents = thetas.where(T.ready(F.col("step"), T.INTERVALS["latents"]))
    return T.also_recorded(thetas, latents, T.INTERVALS["Θ"])


@query("fil4_by_steps_and_keys", f"""
WITH {SERIES}, {LONG_SQL}
SELECT * FROM long WHERE step IN (0, 5, 17, 300) AND key IN ('Θ')""")
def _(spark, sf):
    return T.select_values(long_trace(spark, sf), steps=[0, 5, 17, 300], keys=["Θ"])


@query("fil4_missing_steps_and_keys", f"""
WITH {SERIES}, {LONG_SQL}, a AS (
  SELECT run, step::BIGINT AS step, key FROM (SELECT DISTINCT run FROM long),
         (VALUES (5), (600), (100000)) s(step), (VALUES ('Θ'), ('none')) k(key))
SELECT a.*, 'no record of ' || key || ' at step ' || step AS error
FROM a ANTI JOIN long USING (run, step, key)""")
def _(spark, sf):
    return T.missing_values(long_trace(spark, sf), steps=[5, 600, 100000], keys=["Θ", "none"])


@query("fil4_by_slice_and_component", f"""
WITH {SERIES}, {LONG_SQL}
SELECT * FROM long WHERE step >= 100 AND step < 180 AND idx = 1""")
def _(spark, sf):
    return T.select_values(long_trace(spark, sf), step_range=(100, 180), index=1)


@query("fil5_drop_step", f"""
WITH {SERIES} SELECT trial AS run, k AS step, x1 AS value FROM series WHERE k <> 13""")
def _(spark, sf):
    return T.drop_step(theta(spark, sf), 13)

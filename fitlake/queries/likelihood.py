"""Scores of series under the pointwise objectives.

Latents are (x2, x3); observations are (x0 / 50, x1 / 100000); the bin width is 0.5.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fitlake.functions import objectives as O
from fitlake.functions import scalars
from fitlake.operators import likelihood as K
from fitlake.operators.series import batch_rows
from fitlake.operators.traces import last_records
from fitlake.queries.common import SERIES
from fitlake.queries.registry import query
from fitlake.queries.series import BATCHES, LENGTHS, batches, lengths
from fitlake.session import written
from fitlake.sources.tables import series, table

DT = 0.5
MU, SIGMA, TAU = [0.05, 0.04], [0.3, 0.2], [2.0, 4.0]
LOG_SIGMA = [-3.0, -3.5]
W = [[0.7, -0.3], [0.2, 0.9]]
WC = dict(alpha=[0.2, 0.3], beta=[2.0, 3.0], h=[0.4, 0.5], w=[[1.6, -4.7], [3.0, -0.13]], dt=DT)

VIEW = f"""{SERIES}, v AS (
  SELECT trial, k, x2, x3, x0 / 50e0 AS y0, x1 / 100000e0 AS y1, lag(x2) OVER w AS p2,
         lag(x3) OVER w AS p3, lead(x2) OVER w AS n2, lead(x3) OVER w AS n3
  FROM series WINDOW w AS (PARTITION BY trial ORDER BY k))"""
NOISE = ("(3e0 + 0.5 * ln(0.5e0) - pow(x2 - 0.05, 2) * 0.5 / (2 * exp(-6e0))"
         " + 3.5e0 + 0.5 * ln(0.5e0) - pow(x3 - 0.04, 2) * 0.5 / (2 * exp(-7e0)))")
NORM = "(ln(0.3e0 * sqrt(1e0)) + ln(0.2e0 * sqrt(1e0)))"
FNORM = "(ln(0.3e0 * sqrt(0.5e0)) + ln(0.2e0 * sqrt(0.25e0)))"
FQUAD = ("(pow(x2 - p2 + (p2 - 0.05) * 0.25e0, 2) / (4 * 0.09e0 * 0.5)"
         " + pow(x3 - p3 + (p3 - 0.04) * 0.125e0, 2) / (4 * 0.04e0 * 0.5))")
BQUAD = ("(pow(x2 - n2 - (n2 - 0.05) * 0.25e0, 2) / (4 * 0.09e0 * 0.5)"
         " + pow(x3 - n3 - (n3 - 0.04) * 0.125e0, 2) / (4 * 0.04e0 * 0.5))")
SE = "-(pow(0.7 * x2 - 0.3 * x3 - y0, 2) + pow(0.2 * x2 + 0.9 * x3 - y1, 2))"
L1 = "-(abs(0.7 * x2 - 0.3 * x3 - y0) + abs(0.2 * x2 + 0.9 * x3 - y1))"


def view(spark, sf, before=False, after=False):
    df = series(spark, sf).select(
        "trial", "k", "x2", "x3", (F.col("x0") / 50).alias("y0"), (F.col("x1") / 100000).alias("y1"))
    if before or after:
        df = K.with_neighbours(df, ["x2", "x3"], before=before, after=after)
    return df


def cols(*names):
    return [F.col(n) for n in names]


LATENT, SEEN = ("x2", "x3"), ("y0", "y1")


def forward(**kw):
    return O.ou(cols(*LATENT), cols("prev_x2", "prev_x3"), MU, SIGMA, TAU, DT, **kw)


def backward(**kw):
    return O.ou(cols(*LATENT), cols("next_x2", "next_x3"), MU, SIGMA, TAU, DT, drift=-1, **kw)


def halves(a, b):
    return (F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))) / 2


def noise(mu=MU):
    return O.white_noise(cols(*LATENT), mu, LOG_SIGMA, DT)


def rounded(df, **digits):
    return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c)
                       for c in df.columns])


@query("lik1_white_noise", f"""
WITH {VIEW} SELECT trial, round(sum({NOISE}), 5) AS logp FROM v GROUP BY trial""")
def _(spark, sf):
    return rounded(K.segment_scores(view(spark, sf), ["trial"], {"logp": noise()}), logp=5)


@query("lik2_gaussian_observation", f"""
WITH {VIEW}
SELECT trial, round(sum(-0.5 * ln(0.01e0) - pow(y0 - x2, 2) / 0.02 - 0.5 * ln(0.02e0)
       - pow(y1 - x3, 2) / 0.04), 4) AS logp FROM v GROUP BY trial""")
def _(spark, sf):
    lp = O.gaussian_observation(cols(*SEEN), cols(*LATENT), [0.01, 0.02])
    return rounded(K.segment_scores(view(spark, sf), ["trial"], {"logp": lp}), logp=4)


@query("lik3_mixing_residual", f"""
WITH {VIEW}
SELECT trial, round(sum({SE}), 6) AS se, round(sum({L1}), 6) AS l1 FROM v GROUP BY trial""")
def _(spark, sf):
    terms = {"se": O.mixing_se(W, cols(*LATENT), cols(*SEEN)),
             "l1": O.mixing_l1(W, cols(*LATENT), cols(*SEEN))}
    return rounded(K.segment_scores(view(spark, sf), ["trial"], terms), se=6, l1=6)


@query("lik4_ou_forward", f"""
WITH {VIEW} SELECT trial, k, round(-{NORM} - {FQUAD}, 11) AS logp FROM v WHERE p2 IS NOT NULL""")
def _(spark, sf):
    df = view(spark, sf, before=True).where("prev_x2 IS NOT NULL")
    return df.select("trial", "k", F.round(forward(), 11).alias("logp"))


@query("lik5_ou_backward_smoother", f"""
WITH {VIEW}
SELECT trial, round(sum(-{NORM} - {BQUAD}), 6) AS backward,
       round((sum(-{NORM} - {FQUAD}) + sum(-{NORM} - {BQUAD})) / 2, 6) AS smoother
FROM v GROUP BY trial""")
def _(spark, sf):
    # the first bin has no forward term and the last one no backward term
    df = view(spark, sf, before=True, after=True)
    terms = {"backward": backward(), "smoother": halves(forward(), backward())}
    return rounded(K.segment_scores(df, ["trial"], terms), backward=6, smoother=6)


@query("lik6_finite_noise_ou", f"""
WITH {VIEW}
SELECT trial, round(sum(-{FNORM} - {FQUAD}), 6) AS forward, round(sum(-{FNORM} - {BQUAD}), 6) AS backward,
       round((sum(-{FNORM} - {FQUAD}) + sum(-{FNORM} - {BQUAD})) / 2, 6) AS smoother,
       round(sum(-{FNORM} - pow(x2 - p2 + (p2 - 0.05) * 0.25e0, 2) / (4 * 0.045e0 * 0.5)
         - pow(x3 - p3 + (p3 - 0.04) * 0.125e0, 2) / (4 * 0.01e0 * 0.5)), 6) AS corrected
FROM v GROUP BY trial""")
def _(spark, sf):
    df = view(spark, sf, before=True, after=True)
    f, b = forward(finite_noise=True), backward(finite_noise=True)
    terms = {"forward": f, "backward": b, "smoother": halves(f, b),
             "corrected": forward(finite_noise=True, corrected=True)}
    return rounded(K.segment_scores(df, ["trial"], terms), forward=6, backward=6, smoother=6,
                   corrected=6)


WC_SQL = """wc AS (
  SELECT *, p2 + 0.2 * 0.5 * (-p2 + 1.6 / (1 + exp(-2 * (p2 - 0.4)::DOUBLE)) - 4.7 / (1 + exp(-3 * (p3 - 0.5)::DOUBLE)) + y0) AS e2,
         p3 + 0.3 * 0.5 * (-p3 + 3 / (1 + exp(-2 * (p2 - 0.4)::DOUBLE)) - 0.13 / (1 + exp(-3 * (p3 - 0.5)::DOUBLE)) + y1) AS e3
  FROM v WHERE p2 IS NOT NULL)"""


def predicted(spark, sf):
    step = O.wc_step(cols("prev_x2", "prev_x3"), cols(*SEEN), **WC)
    return view(spark, sf, before=True).where("prev_x2 IS NOT NULL").withColumns(
        {"e2": step[0], "e3": step[1]})


@query("lik7_rate_model_errors", f"""
WITH {VIEW}, {WC_SQL}
SELECT trial, round(-sum(pow((e2 - x2) / 0.5, 2) + pow((e3 - x3) / 0.5, 2)), 6) AS se,
       round(-sum(ln(1 + pow((e2 - x2) / 0.5, 2)) + ln(1 + pow((e3 - x3) / 0.5, 2))), 6) AS lorentz
FROM wc GROUP BY trial""")
def _(spark, sf):
    terms = {"se": O.squared_error(cols("e2", "e3"), cols(*LATENT), 0.5),
             "lorentz": O.lorentz(cols("e2", "e3"), cols(*LATENT), 0.5)}
    return rounded(K.segment_scores(predicted(spark, sf), ["trial"], terms), se=6, lorentz=6)


@query("lik8_consistency_check", f"""
WITH {VIEW}, {WC_SQL}
SELECT trial, count(*) AS n_bins, bool_and(trial % 2 = 0 OR k % 50 <> 7) AS consistent,
       count(*) FILTER (WHERE NOT (trial % 2 = 0 OR k % 50 <> 7)) AS n_off FROM wc GROUP BY trial""")
def _(spark, sf):
    spoiled = (F.col("trial") % 2 != 0) & (F.col("k") % 50 == 7)
    df = predicted(spark, sf).withColumn("seen", F.when(spoiled, F.col("e2") + 1e-3)
                                         .otherwise(F.col("e2") * (1 + 1e-9)))
    close = scalars.isclose(F.col("seen"), F.col("e2"))
    return df.groupBy("trial").agg(F.count("*").alias("n_bins"), F.bool_and(close).alias("consistent"),
                                   F.count(F.when(~close, 1)).alias("n_off"))


@query("lik9_stationary_statistics", """
WITH p AS (SELECT s_suppkey, s_acctbal / 1000 AS mu, (s_nationkey - 12) / 10e0 AS ls, s_suppkey % 5 / 2e0 AS lt,
           ['white noise', 'OU', 'OU finite noise'][s_suppkey % 3 + 1] AS model FROM supplier)
SELECT s_suppkey AS set_id, model, round(mu, 6) AS stat_mean,
  round(CASE model WHEN 'white noise' THEN exp(ls) / sqrt(0.5e0) WHEN 'OU' THEN exp(ls) * sqrt(exp(lt))
        ELSE exp(ls) END, 8) AS stat_std FROM p""")
def _(spark, sf):
    names = F.array(*[F.lit(n) for n in K.STATIONARY])
    params = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("set_id"),
        F.element_at(names, (F.col("s_suppkey") % 3 + 1).cast("int")).alias("model"),
        (F.col("s_acctbal") / 1000).alias("mu"), ((F.col("s_nationkey") - 12) / 10).alias("log_sigma"),
        (F.col("s_suppkey") % 5 / 2).alias("log_tau"))
    return rounded(K.analytic_stationary(params, F.col("model"), DT), stat_mean=6, stat_std=8).select(
        "set_id", "model", "stat_mean", "stat_std")


@query("lik10_objective_arithmetic", f"""
WITH {VIEW}, {BATCHES}
SELECT b.trial, batch, 'forward,nodyn,se' AS tags,
       round(sum((-{NORM} - {FQUAD}) + 0.5 * {SE}) + 25e0 / n_bins * -3.25, 6) AS objective
FROM v JOIN batches b ON b.trial = v.trial AND k >= b AND k < b + 25 JOIN lengths l ON l.trial = b.trial
WHERE p2 IS NOT NULL GROUP BY b.trial, batch, n_bins""")
def _(spark, sf):
    dynamics = O.Objective(lambda: forward(), frozenset({"forward"}))
    seen = O.Objective(lambda: O.mixing_se(W, cols(*LATENT), cols(*SEEN)), frozenset({"nodyn", "se"}))
    objective = sum([dynamics, 0.5 * seen])
    df = batch_rows(view(spark, sf, before=True).where("prev_x2 IS NOT NULL"), batches(spark, sf),
                    "trial", 25)
    df = df.join(lengths(spark, sf), "trial")
    return df.groupBy("trial", "batch", "n_bins").agg(
        F.round(F.sum(objective()) + 25.0 / F.col("n_bins") * -3.25, 6).alias("objective")
    ).drop("n_bins").withColumn("tags", F.lit(",".join(sorted(objective.tags))))


@query("lik11_log_prior", """
SELECT p_partkey AS set_id,
  round(-0.5 * pow((ln(p_size) - 3) / 0.8e0, 2) - ln(0.8e0 * sqrt(2 * pi())) - ln(p_size)
        - 0.5 * pow((p_retailprice - 1000) / 300e0, 2) - ln(300e0 * sqrt(2 * pi())), 7) AS log_prior
FROM part""")
def _(spark, sf):
    size = F.col("p_size").cast("double")
    lp = (scalars.normal_logpdf(F.ln(size), 3.0, 0.8) - F.ln(size)
          + scalars.normal_logpdf(F.col("p_retailprice"), 1000.0, 300.0))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("set_id"),
                                           F.round(lp, 7).alias("log_prior"))


@query("lik11_log_prior_of_families", f"""
WITH v AS (SELECT p_partkey, p_size::DOUBLE AS s, p_retailprice AS r FROM part),
t AS (SELECT p_partkey,
  -0.5 * pow((ln(s) - 3) / 0.8e0, 2) - ln(0.8e0 * sqrt(2 * pi())) - ln(s)
  - 0.5 * pow((r - 1000) / 300e0, 2) - ln(300e0 * sqrt(2 * pi()))
  - ln(1200e0) - r / 1200 - ln(60e0)
  - 0.5 * pow((s - 25) / 10e0, 2) - ln(10e0 * sqrt(2 * pi())) - ln({scalars.cdf(2.0) - scalars.cdf(-1.5)!r})
  + s * ln(25e0) - 25 - lgamma(s + 1) AS lp, s BETWEEN 10 AND 45 AS possible FROM v)
SELECT p_partkey AS set_id, possible, round(CASE WHEN possible THEN lp END, 7) AS log_prior, 6::BIGINT AS n_params FROM t""")
def _(spark, sf):
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    values = table(spark, sf, "part").select(F.col("p_partkey").alias("set_id"), F.inline(F.array(*[
        F.struct(F.lit(n).alias("param"), v.alias("value")) for n, v in {
            "log_size": size, "price": price, "scale": price, "range": size, "cut": size, "count": size}.items()])))
    priors = spark.sql("""SELECT * FROM VALUES ('log_size', 'lognormal', 3D, 0.8D, null, null),
        ('price', 'normal', 1000D, 300D, null, null), ('scale', 'exponential', 1200D, null, null, null),
        ('range', 'uniform', 0D, 60D, null, null), ('cut', 'truncnorm', 25D, 10D, 10D, 45D),
        ('count', 'poisson', 25D, null, null, null) AS t(param, dist, a, b, lo, hi)""")
    out = K.log_prior(values, priors, ["set_id"])
    possible = F.col("log_prior") > float("-inf")
    return out.select("set_id", possible.alias("possible"), F.when(possible, F.round("log_prior", 7)).alias("log_prior"),
                      "n_params")


@query("agg16_mean_score_with_prior", f"""
WITH {VIEW}, {LENGTHS}, s AS (
  SELECT trial, sum({NOISE}) AS lp FROM v WHERE k >= 50 AND k < 450 GROUP BY trial)
SELECT trial, round((lp + (-0.5 * pow((s_acctbal - 4000) / 3000e0, 2) - ln(3000e0 * sqrt(2 * pi()))) * 400 / n_bins) / 400, 7)
       AS mean_logp
FROM s JOIN lengths USING (trial) JOIN supplier ON s_suppkey = trial""")
def _(spark, sf):
    values = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("trial"), F.lit("bal").alias("param"), F.col("s_acctbal").alias("value"))
    priors = spark.sql("SELECT 'bal' AS param, 'normal' AS dist, 4000D AS a, 3000D AS b, "
                       "CAST(null AS DOUBLE) AS lo, CAST(null AS DOUBLE) AS hi")
    prior = K.log_prior(values, priors, ["trial"]).join(lengths(spark, sf), "trial")
    return rounded(K.mean_score(view(spark, sf), ["trial"], noise(), 50, 400, prior), mean_logp=7)


@query("agg13_stationary_beside_analytic", f"""
WITH {VIEW}, e AS (SELECT trial, avg(x2) AS mean, stddev_samp(x2) AS std FROM v WHERE k >= 100 GROUP BY trial),
a AS (SELECT s_suppkey AS trial, s_nationkey / 500e0 AS m, exp(s_nationkey / 10e0 - 4) * sqrt(exp(0.3e0)) AS s FROM supplier)
SELECT trial, round(mean, 9) AS mean, round(std, 9) AS std, round(m, 9) AS stat_mean, round(s, 9) AS stat_std,
       round(mean - m, 9) AS mean_error, round(std / s, 8) AS std_ratio FROM e JOIN a USING (trial)""")
def _(spark, sf):
    params = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("trial"), (F.col("s_nationkey") / 500).alias("mu"),
        (F.col("s_nationkey") / 10 - 4).alias("log_sigma"), F.lit(0.3).alias("log_tau"))
    out = K.stationary_beside(view(spark, sf), "x2", 100, ["trial"], params, F.lit("OU"), DT)
    return rounded(out, mean=9, std=9, stat_mean=9, stat_std=9, mean_error=9, std_ratio=8)


@query("lik12_ground_truth_score", f"""
WITH {VIEW}, n AS (SELECT s_suppkey AS trial, s_nationkey / 500e0 AS mu FROM supplier)
SELECT trial, round(sum({NOISE.replace("x2 - 0.05", "x2 - mu")}) / count(*), 7) AS mean_logp
FROM v JOIN n USING (trial) GROUP BY trial""")
def _(spark, sf):
    truth = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("trial"), (F.col("s_nationkey") / 500).alias("mu"))
    scored = view(spark, sf).join(truth, "trial").groupBy("trial").agg(
        (F.sum(noise([F.col("mu"), MU[1]])) / F.count("*")).alias("mean_logp"))
    return rounded(scored, mean_logp=7)


@query("lik13_term_decomposition", f"""
WITH {VIEW}, t AS (
  SELECT trial, 'norm' AS term, -{NORM} AS value FROM v WHERE p2 IS NOT NULL UNION ALL
  SELECT trial, 'gauss', -{FQUAD} FROM v WHERE p2 IS NOT NULL UNION ALL
  SELECT trial, 'se', {SE} FROM v WHERE p2 IS NOT NULL)
SELECT trial, term, round(sum(value), 6) AS value FROM t GROUP BY ALL
UNION ALL SELECT trial, 'total', round(sum(value), 6) FROM t GROUP BY trial""")
def _(spark, sf):
    norm, quad = O.ou_terms(cols(*LATENT), cols("prev_x2", "prev_x3"), MU, SIGMA, TAU, DT)
    df = view(spark, sf, before=True).where("prev_x2 IS NOT NULL")
    return rounded(K.objective_terms(df, "trial", {
        "norm": -norm, "gauss": -quad, "se": O.mixing_se(W, cols(*LATENT), cols(*SEEN))}), value=6)


@query("lik14_terms_at_steps", f"""
WITH {VIEW}, p AS (SELECT trial, k, x2, p2, x3, p3, y0, y1, y0 AS mu0 FROM v WHERE k IN (100, 250, 400))
SELECT trial, k AS step, round(-{NORM}, 11) AS norm,
       round(-{FQUAD.replace("p2 - 0.05", "p2 - mu0")}, 11) AS gauss, round({SE}, 11) AS se FROM p""")
def _(spark, sf):
    df = view(spark, sf, before=True).where(F.col("k").isin(100, 250, 400))
    norm, quad = O.ou_terms(cols(*LATENT), cols("prev_x2", "prev_x3"), [F.col("y0"), MU[1]],
                            SIGMA, TAU, DT)
    return df.select("trial", F.col("k").alias("step"), F.round(-norm, 11).alias("norm"),
                     F.round(-quad, 11).alias("gauss"),
                     F.round(O.mixing_se(W, cols(*LATENT), cols(*SEEN)), 11).alias("se"))


@query("lik14_terms_of_recorded_steps", f"""
WITH {VIEW}, a AS (SELECT o_custkey % 97 + 1 AS trial, o_orderkey % 500 AS step, min(o_orderkey) AS id FROM orders GROUP BY 1, 2),
p AS (SELECT trial, k AS step, y0 AS mu0 FROM v WHERE k % 7 = 3), l AS (SELECT trial, k AS step, x2, p2, x3, p3 FROM v
  WHERE k % 5 = 2), d AS (SELECT trial, k AS step, y0, y1 FROM v WHERE k % 3 = 0),
s AS (SELECT a.*, mu0, x2, p2, x3, p3, y0, y1, p.step AS param_step FROM a ASOF JOIN p ON a.trial = p.trial AND a.step >= p.step
      ASOF JOIN l ON a.trial = l.trial AND a.step >= l.step ASOF JOIN d ON a.trial = d.trial AND a.step >= d.step)
SELECT trial AS run, step, id, param_step, round(-{NORM}, 10) AS norm,
       round(-{FQUAD.replace("p2 - 0.05", "p2 - mu0")}, 10) AS gauss, round({SE}, 10) AS se FROM s""")
def _(spark, sf):
    # lines are numbered once; all three streams read the result
    df = written(view(spark, sf, before=True).withColumnsRenamed({"trial": "run", "k": "step"}), "bins")
    asked = table(spark, sf, "orders").groupBy(
        (F.col("o_custkey") % 97 + 1).alias("run"), (F.col("o_orderkey") % 500).alias("step")).agg(
        F.min("o_orderkey").alias("id"))
    state = last_records(asked, {
        "params": df.where("step % 7 = 3").select("run", "step", F.col("y0").alias("mu0")),
        "latents": df.where("step % 5 = 2").select("run", "step", *LATENT, "prev_x2", "prev_x3"),
        "bins": df.where("step % 3 = 0").select("run", "step", *SEEN)})
    state = state.where("params IS NOT NULL AND latents IS NOT NULL AND bins IS NOT NULL")
    x, old = cols("latents.x2", "latents.x3"), cols("latents.prev_x2", "latents.prev_x3")
    norm, quad = O.ou_terms(x, old, [F.col("params.mu0"), MU[1]], SIGMA, TAU, DT)
    return state.select("run", "step", "id", F.col("params.step").alias("param_step"), F.round(-norm, 10).alias("norm"),
                        F.round(-quad, 10).alias("gauss"),
                        F.round(O.mixing_se(W, x, cols("bins.y0", "bins.y1")), 10).alias("se"))


@query("join10_matrix_mixing", """
WITH c AS (SELECT vec_id, i - 1 AS m, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) r(i))
SELECT vec_id, j::INTEGER AS j, round(sum(CASE WHEN (j + m) % 2 = 0 THEN 1 ELSE -1 END
       * ((j * 7 + m * 3) % 11 - 5) / 10e0 * x), 6) AS value
FROM c, range(4) r2(j) GROUP BY ALL""")
def _(spark, sf):
    rows = [[(1 if (j + m) % 2 == 0 else -1) * ((j * 7 + m * 3) % 11 - 5) / 10 for m in range(64)]
            for j in range(4)]
    return O.mix_arrays(table(spark, sf, "embeddings"), "embedding", rows, ["vec_id"]).withColumn(
        "value", F.round("value", 6))


@query("join14_better_than_truth", f"""
WITH {VIEW}, {LENGTHS}, g AS (SELECT trial, unnest([50, 200, 500, n_bins]) AS len FROM lengths),
s AS (SELECT trial, len, sum({NOISE}) / len AS t,
  {", ".join(f"sum({NOISE.replace('x2 - 0.05', f'x2 - {m}')}) / len AS c{i}" for i, m in enumerate((0.03137, 0.04571, 0.05213, 0.07039)))}
  FROM v JOIN g USING (trial) WHERE k < len GROUP BY trial, len)
SELECT trial, len AS "K", (c0 > t)::INT + (c1 > t)::INT + (c2 > t)::INT + (c3 > t)::INT AS n_better FROM s""")
def _(spark, sf):
    candidates = [noise([m, MU[1]]) for m in (0.03137, 0.04571, 0.05213, 0.07039)]
    return K.better_than_truth(view(spark, sf), "trial", noise(), candidates, [50, 200, 500])


@query("win3_partial_scores", f"""
WITH {VIEW}, r AS (SELECT unnest([{{s: 0, n: 100}}, {{s: 40, n: 60}}, {{s: 300, n: 200}}], recursive := true))
SELECT trial, s AS start, n AS length, round(sum({NOISE} / n), 7) AS mean_logp
FROM v, r WHERE k >= s AND k < s + n GROUP BY trial, s, n""")
def _(spark, sf):
    return rounded(K.partial_scores(view(spark, sf), "trial", noise(), [0, 40, 300],
                                    [100, 60, 200]), mean_logp=7)


@query("win4_prefix_scores", f"""
WITH {VIEW} SELECT trial, k, round(sum({NOISE}) OVER (PARTITION BY trial ORDER BY k), 5) AS logp FROM v""")
def _(spark, sf):
    return rounded(K.prefix_scores(view(spark, sf), ["trial"], noise()).select("trial", "k", "logp"),
                   logp=5)


@query("agg16_mean_score", f"""
WITH {VIEW}
SELECT trial, round(sum({NOISE}) / 400, 7) AS mean_logp FROM v WHERE k >= 50 AND k < 450 GROUP BY trial""")
def _(spark, sf):
    return rounded(K.mean_score(view(spark, sf), ["trial"], noise(), 50, 400), mean_logp=7)


@query("fit3_gradient_clipping", f"""
WITH {VIEW}, g AS (SELECT trial, k, x2 - 0.05 AS g0, (x3 - 0.04) * 2 AS g1 FROM v),
r AS (SELECT *, greatest(1e0, abs(g0 / 0.02), abs(g1 / 0.02)) AS rescale FROM g)
SELECT trial, k, round(g0 / rescale, 9) AS g0, round(g1 / rescale, 9) AS g1 FROM r""")
def _(spark, sf):
    from fitlake.operators.fit import clip_gradients
    df = view(spark, sf).select("trial", "k", (F.col("x2") - 0.05).alias("g0"),
                                ((F.col("x3") - 0.04) * 2).alias("g1"))
    return rounded(clip_gradients(df, ["g0", "g1"], 0.02), g0=9, g1=9)


@query("fit3_gradient_clipping_per_update", f"""
WITH {VIEW}, g AS (SELECT trial, k, x2 - 0.05 AS g FROM v),
r AS (SELECT *, greatest(1e0, max(abs(g) / 0.02) OVER (PARTITION BY trial)) AS rescale FROM g)
SELECT trial, k, round(g / rescale, 9) AS g FROM r""")
def _(spark, sf):
    from fitlake.operators.fit import clip_over
    df = view(spark, sf).select("trial", "k", (F.col("x2") - 0.05).alias("g"))
    return rounded(clip_over(df, ["trial"], "g", 0.02), g=9)


@query("fit4_latent_rates", """
WITH p AS (SELECT s_suppkey AS set_id, exp((s_nationkey - 12) / 10e0) AS sigma, exp(s_suppkey % 5 / 2e0) AS tau FROM supplier)
SELECT set_id, round(0.01 * sigma * sqrt(tau), 9) AS rate FROM p""")
def _(spark, sf):
    from fitlake.operators.fit import scaled_rates
    params = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("set_id"), F.lit(0.0).alias("mu"), F.lit("OU").alias("model"),
        ((F.col("s_nationkey") - 12) / 10).alias("log_sigma"),
        (F.col("s_suppkey") % 5 / 2).alias("log_tau"))
    stats = K.analytic_stationary(params, F.col("model"), DT)
    return rounded(scaled_rates(stats, 0.01).select("set_id", "rate"), rate=9)



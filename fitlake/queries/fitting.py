"""Fits of the Ornstein–Uhlenbeck model to the series of every trial at once."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fitlake.functions import objectives as O
from fitlake.operators import fit as T
from fitlake.operators.sampling import batch_starts
from fitlake.queries.likelihood import DT, LOG_SIGMA, MU, SIGMA, TAU, W, view
from fitlake.queries.registry import query
from fitlake.session import shuffle_join
from fitlake.sources.tables import series, table

MODEL = T.LatentModel(MU, SIGMA, TAU, W, DT)
RATE = {"x2": 1e-3, "x3": 1e-3}


@query("fit1_parameter_pass")
def _(spark, sf):
    df = view(spark, sf, before=True)
    segments = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("trial")).agg(
        F.count("*").alias("K"))
    batches = batch_starts(segments, "trial", Kb=50, Nb=20)
    sums = T.batch_sums(df, batches, "trial", 50, {0: ("x2", "prev_x2"), 1: ("x3", "prev_x3")})
    trace = T.fit_parameters(sums.join(segments, "trial"), "trial",
                             [0.0, math.log(0.5), math.log(2.0)], 50 / F.col("K"), DT,
                             passes=3, settings=T.Adam(rate=0.05))
    last = F.max_by(F.struct("step", "mean_logp", "mu", "log_sigma", "log_tau"), "step")
    first = F.min_by("mean_logp", "step")
    return trace.groupBy("trial", "comp").agg(first.alias("first_logp"), last.alias("l")).select(
        "trial", "comp", F.round("first_logp", 6).alias("first_logp"), "l.step",
        *[F.round(f"l.{c}", 6).alias(c) for c in ("mean_logp", "mu", "log_sigma", "log_tau")])


def gradient_sql(x: int, prev: str, nxt: str, m: int, a: float, c: float, mu: float) -> str:
    w0, w1 = W[0][m], W[1][m]
    return (f"(-2 * {w0} * (0.7 * x2 - 0.3 * x3 - y0) - 2 * {w1} * (0.2 * x2 + 0.9 * x3 - y1)"
            f" - {c}::DOUBLE * coalesce(x{x} - {prev} + ({prev} - {mu}) * {a}, 0)"
            f" + {c}::DOUBLE * (1 - {a}) * coalesce({nxt} - x{x} + (x{x} - {mu}) * {a}, 0))")


def passes_sql(n: int) -> str:
    from fitlake.queries.common import SERIES
    out = f"""WITH {SERIES}, s0 AS (SELECT trial, k, x2, x3, x0 / 50e0 AS y0, x1 / 100000e0 AS y1 FROM series)"""
    for i in range(n):
        g2 = gradient_sql(2, "p2", "n2", 0, DT / TAU[0], 1 / (2 * SIGMA[0] ** 2 * DT), MU[0])
        g3 = gradient_sql(3, "p3", "n3", 1, DT / TAU[1], 1 / (2 * SIGMA[1] ** 2 * DT), MU[1])
        out += f""", s{i + 1} AS (
  SELECT trial, k, x2 + 1e-3 * {g2} AS x2, x3 + 1e-3 * {g3} AS x3, y0, y1
  FROM (SELECT *, lag(x2) OVER w AS p2, lead(x2) OVER w AS n2, lag(x3) OVER w AS p3, lead(x3) OVER w AS n3
        FROM s{i} WINDOW w AS (PARTITION BY trial ORDER BY k)))"""
    return out


@query("fit2_latent_pass", f"""
{passes_sql(3)}
SELECT trial, k, round(x2, 9) AS x2, round(x3, 9) AS x3 FROM s3""")
def _(spark, sf):
    out = T.latent_updates(view(spark, sf), ["trial"], ["x2", "x3"], ["y0", "y1"], MODEL, RATE,
                           T.full_trace_rules(3))
    return out.select("trial", "k", F.round("x2", 9).alias("x2"), F.round("x3", 9).alias("x3"))


@query("fit2_latent_batches")
def _(spark, sf):
    df = view(spark, sf)
    segments = df.groupBy("trial").agg(F.count("*").alias("K"))
    starts = batch_starts(segments, "trial", Kb=40, Nb=5, stream=3).groupBy("trial").agg(
        F.sort_array(F.collect_list("b")).alias("starts"))
    rules = T.batch_rules(F.col("starts"), 5, 30, 10)
    out = T.latent_updates(df.join(starts, "trial"), ["trial"], ["x2", "x3"], ["y0", "y1"], MODEL,
                           RATE, rules)
    return out.select("trial", "k", F.round("x2", 9).alias("x2"), F.round("x3", 9).alias("x3"))


WEIGHTS = """w AS (SELECT p_partkey AS set_id, r AS "row", m AS comp,
      ((p_partkey * (r * 7 + m * 3 + 1)) % 23 + 1) / 10e0 AS w FROM part, range(2) a(r), range(4) b(m)),
c AS (SELECT p_partkey AS set_id, m AS comp, p_partkey * (m + 3) % 11 / 10e0 AS log_sigma, p_size + m * 1e0 AS mu FROM part, range(4) b(m)),
f AS (SELECT set_id, comp, abs(sum(w)) AS factor FROM w GROUP BY ALL),
o AS (SELECT set_id, comp, factor, log_sigma + ln(factor) AS log_sigma, mu * factor AS mu,
        (comp // 2) * 2 + row_number() OVER (PARTITION BY set_id, comp // 2 ORDER BY round(log_sigma + ln(factor), 9) DESC, comp) - 1 AS new_comp
      FROM c JOIN f USING (set_id, comp))"""


def mixing(spark, sf):
    part = table(spark, sf, "part")
    r, m, p = F.col("row"), F.col("comp"), F.col("p_partkey")
    comps = part.withColumn("comp", F.explode(F.sequence(F.lit(0), F.lit(3))))
    weights = comps.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(1)))).select(
        p.alias("set_id"), "row", "comp", ((p * (r * 7 + m * 3 + 1) % 23 + 1) / 10).alias("w"))
    return weights, comps.select(
        p.alias("set_id"), "comp", (F.col("p_size") + m).cast("double").alias("mu"),
        (p * (m + 3) % 11 / 10).alias("log_sigma"), F.lit(1.0).alias("log_tau"))


LATENT = "((set_id * (comp + 2) + k * 13) % 31 - 15) / 7e0"


@query("fit6_mixed_signal_stays", f"""
WITH {WEIGHTS}, l AS (SELECT p_partkey AS set_id, m AS comp, k FROM part, range(4) b(m), range(5) t(k)),
old AS (SELECT set_id, k, "row", sum((CASE WHEN (comp + "row") % 2 = 0 THEN 1 ELSE -1 END) * w * {LATENT}) AS signal
        FROM w JOIN l USING (set_id, comp) GROUP BY ALL),
n AS (SELECT set_id, k, o.new_comp, {LATENT} * factor AS value FROM l JOIN o USING (set_id, comp))
SELECT old.set_id, old.k::INTEGER AS k, "row"::INTEGER AS "row", round(signal, 7) AS signal, (SELECT string_agg(round(value, 6)::DECIMAL(18, 6)::VARCHAR, ',' ORDER BY new_comp)
        FROM n WHERE n.set_id = old.set_id AND n.k = old.k) AS latents FROM old""")
def _(spark, sf):
    weights, comps = mixing(spark, sf)
    sign = F.when((F.col("comp") + F.col("row")) % 2 == 0, 1.0).otherwise(-1.0)
    new_w, new_c = T.remove_degeneracies(weights, comps, n_comps=4)
    moved = T.moves(new_c, 4)
    latents = comps.select("set_id", "comp", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")).withColumn(
        "value", F.expr("((set_id * (comp + 2) + k * 13) % 31 - 15) / 7"))
    signs = T.moved_rows(weights.withColumn("a", sign).select("set_id", "row", "comp", "a"), moved)
    long = T.moved_rows(latents, moved, times=["value"])
    whole = latents.groupBy("set_id", "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("comp", "value"))),
                                                           lambda x: x["value"]).alias("v"))
    arrays = T.moved_arrays(whole, moved, "v")
    signed = shuffle_join(signs, new_w.withColumnRenamed("new_comp", "comp"), ["set_id", "row", "comp"])
    mixed = (shuffle_join(signed, long, ["set_id", "comp"]).groupBy("set_id", "k", "row")
             .agg(F.round(F.sum(F.col("a") * F.col("w") * F.col("value")), 7).alias("signal")))
    text = F.concat_ws(",", F.transform("v", lambda x: F.round(x, 6).cast("decimal(18,6)").cast("string")))
    return shuffle_join(mixed, arrays.select("set_id", "k", text.alias("latents")), ["set_id", "k"])


@query("fit6_remove_degeneracies", f"""
WITH {WEIGHTS}
SELECT set_id, comp::INTEGER AS comp, new_comp::INTEGER AS new_comp, round(factor, 6) AS factor,
       round(mu, 6) AS mu, round(log_sigma, 8) AS log_sigma FROM o""")
def _(spark, sf):
    _, comps = T.remove_degeneracies(*mixing(spark, sf), n_comps=4)
    return comps.select("set_id", "comp", "new_comp", *[
        F.round(c, d).alias(c) for c, d in (("factor", 6), ("mu", 6), ("log_sigma", 8))])


@query("fit6_rescaled_weights", f"""
WITH {WEIGHTS}
SELECT w.set_id, "row"::INTEGER AS "row", new_comp::INTEGER AS new_comp, round(w / factor, 8) AS w
FROM w JOIN o USING (set_id, comp)""")
def _(spark, sf):
    weights, _ = T.remove_degeneracies(*mixing(spark, sf), n_comps=4)
    return weights.withColumn("w", F.round("w", 8))


@query("sort5_component_order", f"""
WITH {WEIGHTS}
SELECT set_id, comp::INTEGER AS comp, new_comp::INTEGER AS new_comp FROM o WHERE comp <> new_comp""")
def _(spark, sf):
    _, comps = T.remove_degeneracies(*mixing(spark, sf), n_comps=4)
    return comps.where("comp <> new_comp").select("set_id", "comp", "new_comp")


@query("dist11_adaptive_search")
def _(spark, sf):
    df = series(spark, sf).select("x2", "x3")

    def lp(point):
        return O.white_noise([F.col("x2"), F.col("x3")], point, LOG_SIGMA, DT) / 1000

    return T.densify(df, ["mu0", "mu1"], lp, [0.2, 0.2], [0.1, 0.1], per_round=8, required=12, seed=11)

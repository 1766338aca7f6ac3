"""Reproducible draws of trials, segments, batches and series."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from fitlake.functions import labels
from fitlake.operators import graphs as G
from fitlake.operators import sampling as S
from fitlake.operators.series import slices
from fitlake.queries.common import SERIES
from fitlake.queries.registry import query
from fitlake.queries.series import UNIFORM
from fitlake.sources.tables import series, table


@query("smp1_draw_segments", f"""
WITH {SERIES}, t AS (SELECT trial, row_number() OVER (ORDER BY trial) - 1 AS position FROM (SELECT DISTINCT trial FROM series)),
d AS (SELECT r.draw, CAST(floor({UNIFORM.format("'20201115:draw:' || r.draw")} * (SELECT count(*) FROM t)) AS BIGINT) AS position
      FROM range(300) r(draw))
SELECT draw, trial, k, x1 FROM d JOIN t USING (position) JOIN series USING (trial)
WHERE k BETWEEN 40 AND 70""")
def _(spark, sf):
    df = series(spark, sf)
    draws = S.draw_trials(df, "trial", 300, "draw").withColumns(
        {"start": F.lit(40), "stop": F.lit(70)})
    return slices(df, draws, "trial", "k", "start", "stop", width=64).select(
        "draw", "trial", "k", "x1")


POISSON = [float(np.exp(-1.0))]
for _i in range(1, 20):
    POISSON.append(POISSON[0] / float(np.prod(range(1, _i + 1))))
STEPS = np.cumsum(POISSON).tolist()


def drawn(name: str, i: int, dist: str) -> str:
    key = f"'20201115:5:{name}:{i}:' || trial || ':' || k"
    if dist == "normal":
        return (f"sqrt(-2 * ln(1 - {UNIFORM.format(key + chr(32) + '|| ' + repr(':a'))}))"
                f" * cos(2 * pi() * {UNIFORM.format(key + chr(32) + '|| ' + repr(':b'))})")
    u = UNIFORM.format(key)
    return " + ".join(f"({u} >= {s!r}::DOUBLE)::INT" for s in STEPS[:14])


@query("smp2_random_series", f"""
WITH {SERIES}
SELECT trial, k, 'x' AS name, 0 AS idx, round({drawn("x", 0, "normal")}, 8) AS value FROM series UNION ALL
SELECT trial, k, 'x', 1, round({drawn("x", 1, "normal")}, 8) FROM series UNION ALL
SELECT trial, k, 'y', 0, ({drawn("y", 0, "poisson")})::DOUBLE FROM series""")
def _(spark, sf):
    axis = series(spark, sf).select("trial", "k")
    return S.random_series(axis, ["trial", "k"], {"x": ("normal", 2), "y": ("poisson", 1)}, 5
                           ).withColumn("value", F.round("value", 8))


@query("smp3_batch_starts", f"""
WITH RECURSIVE seg AS (SELECT l_suppkey AS trial, count(*) - 24 AS n FROM lineitem GROUP BY 1),
s AS (
  SELECT trial, n, 0 AS i, list_transform(range(n), lambda x: 1e0) AS w, []::BIGINT[] AS starts FROM seg
  UNION ALL
  SELECT trial, n, i + 1, list_transform(share, lambda x, j: CASE WHEN abs(j - 1 - b) < 25
           THEN x * (1 - exp(-2 * pow((j - 1 - b) / 25e0, 2))) ELSE x END), list_append(starts, b)
  FROM (
    SELECT trial, n, i, starts, share, least(coalesce(list_position(list_transform(
             range(1, n + 1), lambda k: list_sum(share[1:k]) > u), true), n) - 1, n - 1) AS b
    FROM (
      SELECT trial, n, i, starts, u, list_transform(w, lambda x: 1e-6 + (1 - n * 1e-6) * x / total) AS share
      FROM (SELECT *, list_sum(w) AS total, {UNIFORM.format("'20201115:0:' || trial || ':' || i")} AS u
            FROM s WHERE i < 12))))
SELECT trial, unnest(range(12))::INTEGER AS batch, unnest(list_sort(starts)) AS b FROM s WHERE i = 12""")
def _(spark, sf):
    segments = series(spark, sf).groupBy("trial").agg(F.count("*").alias("K"))
    return S.batch_starts(segments, "trial", Kb=25, Nb=12)


@query("smp7_synthetic_trials", """
WITH p AS (SELECT p_partkey AS position, substr(sha256('size=' || p_size || ';type=' || p_type), 1, 10) AS param_hash,
                  p_partkey * 7 % 1000 AS seed FROM part)
SELECT param_hash, seed, param_hash || '__' || seed AS label, position FROM p""")
def _(spark, sf):
    part = table(spark, sf, "part")
    params = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("type"), "p_type")
    sets = part.select(F.col("p_partkey").alias("position"), labels.digest(params).alias("param_hash"))
    sims = part.select(F.col("p_partkey").alias("position"),
                       (F.col("p_partkey") * 7 % 1000).alias("seed"))
    return S.with_params(sets, sims).select(
        "param_hash", "seed", "position",
        labels.trial_label(F.col("param_hash"), F.col("seed").cast("string")).alias("label"))


@query("join13_rng_key_conflicts", """
WITH k AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN [o_custkey % 50] WHEN o_orderkey % 5 < 3
                  THEN [o_custkey % 50, o_orderkey % 7] ELSE [o_custkey % 60, o_orderkey, 1] END AS key FROM orders),
c AS (SELECT key, count(*) AS n FROM k GROUP BY key),
a AS (SELECT s.key, count(*) AS n_below FROM c s JOIN c l ON len(l.key) > len(s.key) AND l.key[:len(s.key)] = s.key
      GROUP BY s.key)
SELECT array_to_string(key, ',') AS key, n, coalesce(n_below, 0) AS n_below FROM c LEFT JOIN a USING (key)
WHERE n > 1 OR n_below IS NOT NULL""")
def _(spark, sf):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    key = (F.when(o % 5 == 0, F.array(c % 50)).when(o % 5 < 3, F.array(c % 50, o % 7))
           .otherwise(F.array(c % 60, o, F.lit(1).cast("long"))))
    keys = table(spark, sf, "orders").select(key.alias("key"))
    return S.key_conflicts(keys, "key").withColumn("key", F.concat_ws(
        ",", F.transform("key", lambda x: x.cast("string"))))


@query("join11_resolve_connections", """
WITH s AS (SELECT s_suppkey, s_nationkey AS a, CASE WHEN s_nationkey < 24 THEN least(s_nationkey + 1 + s_suppkey % 3, 24) END AS b FROM supplier)
SELECT 'NATION_' || b AS upper, count(*) AS n_inputs, count(DISTINCT a) AS n_models, true AS acyclic
FROM s GROUP BY b""")
def _(spark, sf):
    supplier = table(spark, sf, "supplier")
    n = F.col("s_nationkey")
    lower = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("NATION_"), n)).otherwise(
        F.concat(F.lit("Class"), n))
    upper = F.when(n < 24, F.concat(F.lit("NATION_"), F.least(n + 1 + F.col("s_suppkey") % 3, F.lit(24)))
                   ).otherwise("OUTSIDE")  # no model of that name
    text = F.concat(lower, F.lit(".u -> "), upper, F.lit(".I"))
    models = table(spark, sf, "nation").select(
        F.col("n_name").alias("attr"), F.concat(F.lit("Class"), F.col("n_nationkey")).alias("class"))
    found = G.resolve_connections(G.parse_connections(supplier.select(text.alias("text")), "text"),
                                  models)
    edges = found.select(F.col("src_model").alias("src"), F.col("dst_model").alias("dst"))
    acyclic = G.is_acyclic(edges)
    return found.groupBy(F.col("dst_model").alias("upper")).agg(
        F.count("*").alias("n_inputs"), F.count_distinct("src_model").alias("n_models")
    ).withColumn("acyclic", F.lit(acyclic))

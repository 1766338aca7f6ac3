"""Parameter sets from the parts table; sweeps over suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from fitlake.operators import params as P
from fitlake.queries.registry import query
from fitlake.sources.tables import table

FLAT = """flat AS (
  SELECT p_partkey AS set_id, p_name AS grp, path, value FROM (
    SELECT p_partkey, p_name, unnest([{path: 'dyn.brand', value: p_brand},
      {path: 'dyn.kind.type', value: p_type}, {path: 'obs.size', value: p_size::VARCHAR},
      {path: 'obs.even', value: CASE WHEN p_partkey % 2 = 0 THEN 'yes' END}], recursive := true)
    FROM part) WHERE value IS NOT NULL)"""


def flat(spark, sf):
    part = table(spark, sf, "part")
    return P.flat_params(part, "p_partkey", {
        "dyn.brand": F.col("p_brand"), "dyn.kind.type": F.col("p_type"),
        "obs.size": F.col("p_size"), "obs.even": F.when(F.col("p_partkey") % 2 == 0, "yes")})


def grouped(spark, sf):
    names = table(spark, sf, "part").select(F.col("p_partkey").alias("set_id"),
                                            F.col("p_name").alias("grp"))
    return flat(spark, sf).join(names, "set_id")


@query("join8_parameter_diff", f"""
WITH {FLAT}, b AS (SELECT set_id - 1 AS set_id, path, value FROM flat)
SELECT coalesce(a.set_id, b.set_id) AS set_id, coalesce(a.path, b.path) AS path,
       a.value AS left_value, b.value AS right_value
FROM flat a FULL JOIN b ON a.set_id = b.set_id AND a.path = b.path
WHERE a.value IS DISTINCT FROM b.value""")
def _(spark, sf):
    left = flat(spark, sf)
    right = left.withColumn("set_id", F.col("set_id") - 1)
    return P.diff(left, right, ["set_id"])


@query("join9_recursive_update", f"""
WITH {FLAT}
SELECT set_id, path, CASE WHEN path = 'obs.size' AND set_id % 3 = 0 THEN (value::INTEGER + 100)::VARCHAR
                     ELSE value END AS value FROM flat
UNION ALL SELECT p_partkey, 'obs.color', 'red' FROM part WHERE p_partkey % 5 = 0""")
def _(spark, sf):
    base = flat(spark, sf)
    changed = base.where("path = 'obs.size' AND set_id % 3 = 0").withColumn(
        "value", (F.col("value").cast("int") + 100).cast("string"))
    new = table(spark, sf, "part").where("p_partkey % 5 = 0").select(
        F.col("p_partkey").alias("set_id"), F.lit("obs.color").alias("path"),
        F.lit("red").alias("value"))
    return P.update(base, changed.unionByName(new), allow_new=True)


@query("agg6_differing_params", f"""
WITH {FLAT}, n AS (SELECT grp, count(DISTINCT set_id) AS n FROM flat GROUP BY grp)
SELECT grp, path, min(value) AS lowest, max(value) AS highest, count(*) AS n_sets
FROM flat JOIN n USING (grp) GROUP BY grp, path, n.n
HAVING min(value) <> max(value) OR count(*) < n.n""")
def _(spark, sf):
    return P.differing(grouped(spark, sf), "grp")


@query("agg6_differing_to_depth", f"""
WITH {FLAT}, n AS (SELECT grp, count(DISTINCT set_id) AS n FROM flat GROUP BY grp),
d AS (SELECT grp, path FROM flat JOIN n USING (grp) GROUP BY grp, path, n.n
      HAVING min(value) <> max(value) OR count(*) < n.n)
SELECT DISTINCT grp, array_to_string(string_split(path, '.')[:1], '.') AS path FROM d""")
def _(spark, sf):
    return P.differing(grouped(spark, sf), "grp", depth=1)


@query("fil7_subparams", f"""
WITH {FLAT} SELECT set_id, substr(path, 5) AS path, value FROM flat WHERE starts_with(path, 'dyn.')""")
def _(spark, sf):
    return P.subparams(flat(spark, sf), "dyn")


@query("smp5_outer_sweep", """
SELECT s_suppkey, s_nationkey, alpha::DOUBLE AS alpha, n_steps::INTEGER AS n_steps
FROM supplier, (VALUES (0.5), (1.0), (2.0)) a(alpha), (VALUES (5000), (25000)) n(n_steps)""")
def _(spark, sf):
    base = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    return P.outer_sweep(base, {"alpha": [0.5, 1.0, 2.0], "n_steps": [5000, 25000]})


@query("smp6_inner_sweep", """
SELECT s_suppkey, sweep::INTEGER AS sweep, alpha::DOUBLE AS alpha, seed::INTEGER AS seed, true AS uneven
FROM supplier, (VALUES (0, 0.5, 11), (1, 1.0, 12)) a(sweep, alpha, seed)""")
def _(spark, sf):
    base = table(spark, sf, "supplier").select("s_suppkey")
    return P.inner_sweep(base, {"alpha": [0.5, 1.0, 2.0], "seed": [11, 12]})


@query("smp10_named_tasks", """
WITH s AS (SELECT s_nationkey AS nation, n_steps FROM supplier, (VALUES (5000), (25000)) n(n_steps)),
d AS (SELECT nation, n_steps::INTEGER AS n_steps, count(*) AS n_rows,
        substr(sha256('n_steps=' || n_steps || ';nation=' || nation), 1, 10) AS digest
      FROM s GROUP BY ALL)
SELECT digest, nation, n_steps, n_rows, 'fit__' || digest AS task FROM d""")
def _(spark, sf):
    base = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"))
    return P.named_tasks(P.outer_sweep(base, {"n_steps": [5000, 25000]}), ["nation", "n_steps"],
                         "fit")


@query("scl5_unit_conversion", """
SELECT p_partkey AS set_id, 'dyn.tau' AS path, p_size || ' ms' AS value, round(p_size * 1e-3, 9) AS magnitude FROM part
UNION ALL SELECT p_partkey, 'dyn.rate', p_size || ' mV*s^2/ms', round(p_size * 1e0, 9) FROM part
UNION ALL SELECT p_partkey, 'dyn.name', p_brand, NULL FROM part
UNION ALL SELECT p_partkey, 'units.t', '1 ms', NULL FROM part""")
def _(spark, sf):
    size = F.col("p_size").cast("string")
    params = P.flat_params(table(spark, sf, "part"), "p_partkey", {
        "dyn.tau": F.concat(size, F.lit(" ms")), "dyn.rate": F.concat(size, F.lit(" mV*s^2/ms")),
        "dyn.name": F.col("p_brand"), "units.t": F.lit("1 ms")})
    return P.magnitudes(params).withColumn("magnitude", F.round("magnitude", 9))

"""Run tables: results, counts, labels, selections and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from fitlake.functions import labels
from fitlake.operators import runs as R
from fitlake.queries.common import NAN_TRACES, RUNS, SERIES, TRACES
from fitlake.queries.registry import query
from fitlake.sources.tables import runs, series, table, traces

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

OUTCOME_SQL = """CASE WHEN regexp_matches(lower(outcome), 'not ?converged') THEN 'Not converged'
       WHEN contains(lower(outcome), 'converged') THEN 'Converged'
       WHEN contains(lower(outcome), 'failed') THEN 'Failed' ELSE outcome END"""
DURATION_SQL = """trim(
    CASE WHEN duration_s >= 86400 THEN (duration_s // 86400) || 'D ' ELSE '' END
    || CASE WHEN duration_s >= 3600 THEN lpad((duration_s % 86400 // 3600)::VARCHAR, 2, '0') || 'h ' ELSE '' END
    || CASE WHEN duration_s >= 60 THEN lpad((duration_s % 3600 // 60)::VARCHAR, 2, '0') || 'm ' ELSE '' END
    || lpad((duration_s % 60)::VARCHAR, 2, '0') || 's')"""


@query("agg1_run_results", f"""
WITH {NAN_TRACES}, {RUNS},
s AS (SELECT run, max(logl) FILTER (WHERE NOT isnan(logl)) AS max_logl,
             bool_or(isnan(logl)) AS has_nan, count(*) AS n_steps, max(step) AS last_step
      FROM traces GROUP BY run)
SELECT runs.run, split, lam, init_key, round(max_logl, 2) AS max_logl,
       round(t.logl, 2) AS last_logl, has_nan, {OUTCOME_SQL} AS outcome,
       split_part(reason, chr(10), 1) AS reason, {DURATION_SQL} AS duration, n_steps, last_step
FROM runs JOIN s USING (run) JOIN traces t ON t.run = runs.run AND t.step = s.last_step
ORDER BY max_logl DESC, runs.run""")
def _(spark, sf):
    return R.run_results(runs(spark, sf), traces(spark, sf, with_nan=True))


@query("agg2_records_per_split", f"""
WITH {RUNS} SELECT split, count(*) AS n_records FROM runs GROUP BY split""")
def _(spark, sf):
    return R.counts(runs(spark, sf), "split")


@query("agg3_runs_per_set_and_split", f"""
WITH {RUNS}
SELECT lam, any_value(nation)::VARCHAR AS nation, '(No diff)' AS model,
       {", ".join(f"count(*) FILTER (WHERE split = '{s}') AS {s}" for s in SEGMENTS)}
FROM runs GROUP BY lam""")
def _(spark, sf):
    return R.run_counts(runs(spark, sf).withColumn("model", F.lit("WC")), "lam", "split",
                        SEGMENTS, ["nation", "model"])


@query("agg4_used_init_keys", f"""
WITH {RUNS}, u AS (
  SELECT init_key, {", ".join(f"bool_or(split = '{s}') AS {s}" for s in SEGMENTS)}
  FROM runs GROUP BY init_key)
SELECT *, {" || ".join(f"CASE WHEN {s} THEN '▮' ELSE '▯' END" for s in SEGMENTS)} AS bar FROM u""")
def _(spark, sf):
    return R.used_keys(runs(spark, sf), "init_key", "split", SEGMENTS)


@query("agg5_split_by_fields", f"""
WITH {RUNS}
SELECT run, 'split,nation' AS split_fields,
       'Split: ' || split || ' – Nation: ' || nation AS split_label
FROM runs""")
def _(spark, sf):
    df = runs(spark, sf).withColumn("model", F.lit("WC"))
    return R.split_by(df, ["split", "model", "nation"]).select("run", "split_fields", "split_label")


@query("agg7_set_labels", f"""
WITH {RUNS}, d AS (
  SELECT substr(sha256('nation=' || nation || ';split=' || split), 1, 10) AS digest,
         min(run) AS first_seen, count(*) AS n_runs
  FROM runs GROUP BY ALL)
SELECT digest, first_seen, n_runs, 'Λ' || row_number() OVER (ORDER BY first_seen, digest) AS label
FROM d""")
def _(spark, sf):
    params = F.create_map(F.lit("split"), "split", F.lit("nation"), F.col("nation").cast("string"))
    return R.set_labels(runs(spark, sf), params, "run")


@query("agg8_one_run_per_key", f"""
WITH {TRACES}, {RUNS}, c AS (
  SELECT split, init_key, run, stepi,
         row_number() OVER (PARTITION BY split, init_key ORDER BY stepi DESC, run) AS rn,
         count(*) OVER (PARTITION BY split, init_key) AS n_candidates
  FROM runs JOIN (SELECT run, max(step) AS stepi FROM traces GROUP BY run) USING (run))
SELECT split, init_key, run, stepi, n_candidates FROM c WHERE rn = 1""")
def _(spark, sf):
    return R.one_run_per_key(runs(spark, sf), traces(spark, sf), ["split", "init_key"])


@query("agg9_shared_ground_truth", """
SELECT o_custkey AS trial,
       CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN any_value(o_orderstatus) END AS ground_truth
FROM orders GROUP BY 1""")
def _(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("trial"), "o_orderstatus")
    return R.shared_value(orders, "trial", F.col("o_orderstatus"), "ground_truth")


@query("agg10_field_values", f"""
WITH {RUNS}
SELECT DISTINCT field, value FROM (
  SELECT 'split' AS field, split AS value FROM runs UNION ALL
  SELECT 'lam', lam FROM runs UNION ALL SELECT 'outcome', outcome FROM runs)""")
def _(spark, sf):
    return R.field_values(runs(spark, sf), ["split", "lam", "outcome"])


@query("agg11_init_keys_sorted", f"""
WITH {RUNS}, k AS (SELECT DISTINCT init_key FROM runs UNION SELECT DISTINCT lam FROM runs)
SELECT init_key, starts_with(init_key, '(') AS is_tuple,
       CASE WHEN starts_with(init_key, '(')
            THEN list_aggregate(list_transform(string_split(regexp_replace(init_key, '[() ]', '', 'g'), ','),
                 lambda x: lpad(len(x)::VARCHAR, 10, '0') || x), 'string_agg', ',')
            ELSE init_key END AS sort_key
FROM k ORDER BY is_tuple, sort_key""")
def _(spark, sf):
    r = runs(spark, sf)
    keys = r.select("init_key").union(r.select("lam")).distinct()
    is_tuple = F.startswith("init_key", F.lit("("))
    return keys.withColumns({
        "is_tuple": is_tuple,
        "sort_key": F.when(is_tuple, labels.tuple_order(F.col("init_key"))).otherwise(
            F.col("init_key"))}).orderBy("is_tuple", "sort_key")


@query("agg11_fit_step_keys", f"""
WITH {TRACES}, {RUNS}
SELECT DISTINCT lam, init_key, step FROM runs JOIN traces USING (run)""")
def _(spark, sf):
    return runs(spark, sf).select("run", "lam", "init_key").join(
        traces(spark, sf).select("run", "step"), "run").select("lam", "init_key", "step").distinct()


@query("set3_distinct_steps", f"""
WITH {TRACES}, {SERIES}
SELECT DISTINCT step FROM (SELECT step FROM traces UNION ALL SELECT k FROM series)""")
def _(spark, sf):
    return traces(spark, sf).select("step").union(series(spark, sf).select("k")).distinct()


@query("agg12_last_recorded", f"""
WITH {TRACES}
SELECT run, step AS last_step, logl AS last_logl, context AS last_context FROM traces
QUALIFY row_number() OVER (PARTITION BY run ORDER BY step DESC) = 1""")
def _(spark, sf):
    last = F.max_by(F.struct("step", "logl", "context"), "step")
    return traces(spark, sf).groupBy("run").agg(last.alias("l")).select(
        "run", F.col("l.step").alias("last_step"), F.col("l.logl").alias("last_logl"),
        F.col("l.context").alias("last_context"))


@query("agg12_trace_of_keys", f"""
WITH {SERIES}
SELECT trial AS run, k AS step, 'x1' AS key, x1 AS value FROM series
UNION ALL SELECT trial, k, 'x3', x3 FROM series""")
def _(spark, sf):
    chosen = series(spark, sf).select(F.col("trial").alias("run"), F.col("k").alias("step"),
                                      "x1", "x3")
    return chosen.unpivot(["run", "step"], ["x1", "x3"], "key", "value")


@query("fil1_runs_by_key_and_outcome", f"""
WITH {RUNS}
SELECT run, lam, init_key, outcome FROM runs
WHERE lam IN ('n3', 'n7', 'n11') AND init_key LIKE '(%, 2)'
  AND NOT coalesce(contains(outcome, '<OptimizerStatus.Failed>'), false)""")
def _(spark, sf):
    return R.without_failed(
        runs(spark, sf).where(F.col("lam").isin("n3", "n7", "n11")
                              & F.col("init_key").like("(%, 2)"))
    ).select("run", "lam", "init_key", "outcome")


@query("fil2_include_exclude_components", f"""
WITH {SERIES}, long AS (
  SELECT trial, k, 'x' AS name, 0 AS idx, x0 AS value FROM series UNION ALL
  SELECT trial, k, 'x', 1, x1 FROM series UNION ALL
  SELECT trial, k, 'y', 0, x2 FROM series UNION ALL
  SELECT trial, k, 'y', 1, x3 FROM series)
SELECT trial, k, name, idx, value FROM long
WHERE (name, idx) IN (('x', 0), ('x', 1), ('y', 1)) AND (name, idx) NOT IN (('x', 1))""")
def _(spark, sf):
    from fitlake.operators.series import components, include_exclude
    long = components(series(spark, sf), {("x", 0): "x0", ("x", 1): "x1",
                                          ("y", 0): "x2", ("y", 1): "x3"})
    return include_exclude(long, include={"x": [0, 1], "y": [1]}, exclude={"x": [1]})


@query("fil3_frame_selection", f"""
WITH {RUNS}
SELECT run, split, lam FROM runs
WHERE split IN ('BUILDING', 'FURNITURE') AND lam NOT IN ('n0', 'n1')""")
def _(spark, sf):
    return R.select_frames(runs(spark, sf), {"split": ["BUILDING", "FURNITURE"]},
                           {"lam": ["n0", "n1"]}).select("run", "split", "lam").orderBy("run")


@query("fil3_frames_without_the_dimension", f"""
WITH {RUNS}, d AS (SELECT run, split, CASE WHEN run % 5 = 0 THEN NULL ELSE lam END AS lam FROM runs)
SELECT run, split, lam FROM d WHERE split IN ('BUILDING', 'FURNITURE') AND (lam IS NULL OR lam NOT IN ('n0', 'n1'))""")
def _(spark, sf):
    df = runs(spark, sf).withColumn("lam", F.when(F.col("run") % 5 != 0, F.col("lam")))
    return R.select_frames(df, {"split": ["BUILDING", "FURNITURE"]}, {"lam": ["n0", "n1"]}).select("run", "split", "lam")


@query("join7_ground_truth_targets", f"""
WITH {SERIES}, {RUNS}
SELECT t.trial AS run, t.k AS step, t.x0 AS value, n.n_regionkey::DOUBLE * 10 AS target
FROM series t JOIN supplier s ON s.s_suppkey = t.trial
LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey AND n.n_regionkey < 3""")
def _(spark, sf):
    curves = series(spark, sf).join(
        table(spark, sf, "supplier").select(F.col("s_suppkey").alias("trial"), "s_nationkey"),
        "trial").select(F.col("trial").alias("run"), F.col("k").alias("step"),
                        F.col("x0").alias("value"), "s_nationkey")
    targets = table(spark, sf, "nation").where("n_regionkey < 3").select(
        F.col("n_nationkey").alias("s_nationkey"),
        (F.col("n_regionkey").cast("double") * 10).alias("target"))
    return R.add_targets(curves, targets, ["s_nationkey"]).drop("s_nationkey")


@query("join12_complete_grid", f"""
WITH {RUNS}, c AS (SELECT init_key, split, count(*) AS n FROM runs GROUP BY ALL)
SELECT i.init_key, s.split, c.n
FROM (SELECT DISTINCT init_key FROM c) i CROSS JOIN (SELECT DISTINCT split FROM c) s
LEFT JOIN c ON c.init_key = i.init_key AND c.split = s.split""")
def _(spark, sf):
    r = runs(spark, sf)
    cells = r.groupBy("init_key", "split").agg(F.count("*").alias("n"))
    return R.complete_grid(cells, "init_key", {"split": SEGMENTS}, "n")


@query("win7_accent_weights", f"""
WITH {TRACES}, {RUNS}, q AS (
  SELECT run, split, lam, max(logl) / 1000 AS q FROM traces JOIN runs USING (run) GROUP BY ALL),
b AS (SELECT *, max(q) OVER (PARTITION BY split, lam) AS best FROM q)
SELECT run, round(q, 6) AS q, round(best - q, 6) AS gap,
       round(CASE WHEN best - q >= 2 THEN 0 ELSE 1 - (best - q) / 2 END, 6) AS weight
FROM b""")
def _(spark, sf):
    q = (traces(spark, sf).groupBy("run").agg((F.max("logl") / 1000).alias("q"))
         .join(runs(spark, sf), "run").withColumn("g", F.concat_ws("|", "split", "lam")))
    return R.accent_weights(q, "g", "q").select(
        "run", *[F.round(c, 6).alias(c) for c in ("q", "gap", "weight")])


@query("win10_pooled_limits", f"""
WITH {NAN_TRACES}, {RUNS}, p AS (
  SELECT split, logl, row_number() OVER (PARTITION BY split ORDER BY logl) AS rn,
         count(*) OVER (PARTITION BY split) AS n
  FROM traces JOIN runs USING (run) WHERE NOT isnan(logl))
SELECT split, max(n) AS rows, max(logl) FILTER (WHERE rn = floor(0.05::DOUBLE * n) + 1) AS ymin,
       max(logl) FILTER (WHERE rn = least(floor(0.95::DOUBLE * n), n - 1) + 1) AS ymax
FROM p GROUP BY split""")
def _(spark, sf):
    pooled = traces(spark, sf, with_nan=True).join(runs(spark, sf), "run")
    return R.clip_limits(pooled, ["split"], "logl", 0.05, 0.95)


@query("src8_run_store_filters", f"""
WITH {TRACES}, {RUNS}
SELECT c_custkey AS run, c_name AS label, o_orderkey AS record
FROM customer JOIN orders ON o_custkey = c_custkey
WHERE list_contains([o_orderpriority, c_mktsegment], 'BUILDING')
  AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'
  AND contains('Init params: ' || c_nationkey, 'params: 1') AND starts_with(c_name, 'Customer#')""")
def _(spark, sf):
    from fitlake.sources.runstore import scan
    store = table(spark, sf, "customer").join(
        table(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_custkey").alias("run"), F.col("c_name").alias("label"),
        F.col("o_orderkey").alias("record"), F.col("o_orderdate").alias("ts"),
        F.array("o_orderpriority", "c_mktsegment").alias("tags"),
        F.concat(F.lit("Init params: "), F.col("c_nationkey")).alias("reason"))
    return scan(store, tags=["BUILDING"], after="1996-01-01", before="1998-01-01",
                reason="params: 1", label="Customer#").select("run", "label", "record")


@query("src9_required_outputs", """
WITH o AS (
  SELECT o_custkey AS run, list_distinct(list(CASE o_orderstatus WHEN 'F' THEN 'out/log L'
           WHEN 'O' THEN 'out/Θ' ELSE 'out/latents' END)) AS outputs
  FROM orders GROUP BY 1)
SELECT run, len(outputs) AS n_outputs, len(outputs) = 3 AS complete FROM o""")
def _(spark, sf):
    from fitlake.sources.runstore import required_outputs
    kind = (F.when(F.col("o_orderstatus") == "F", "out/log L")
            .when(F.col("o_orderstatus") == "O", "out/Θ").otherwise("out/latents"))
    found = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("run")).agg(
        F.collect_set(kind).alias("outputs"))
    return required_outputs(found).select("run", F.size("outputs").cast("long").alias("n_outputs"),
                                          "complete")


@query("agg17_summary_histogram", f"""
WITH {RUNS}, s AS (SELECT split, score AS v FROM runs),
q AS (SELECT split, min(v) AS lo, max(v) AS hi, count(*) AS n,
             quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM s GROUP BY split),
b AS (SELECT split, lo, hi, n, CAST(ceil((hi - lo) / CASE WHEN q3 > q1
          THEN least(2 * (q3 - q1) / pow(n, 1e0 / 3), (hi - lo) / (log2(n) + 1))
          ELSE (hi - lo) / (log2(n) + 1) END) AS BIGINT) AS bins FROM q)
SELECT split, bins, least(CAST(floor((v - lo) / (hi - lo) * bins) AS BIGINT), bins - 1) AS bin,
       count(*) AS freq
FROM s JOIN b USING (split) GROUP BY ALL""")
def _(spark, sf):
    from fitlake.operators.distributions import histogram
    return histogram(runs(spark, sf), ["split"], "score").select("split", "bins", "bin", "freq")

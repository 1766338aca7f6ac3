"""Streaming operators on the events; the SQL gives the batch result on the same rows."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fitlake.queries.convergence import BASE, CONSTANT, DIVERGING, PARAMS, base
from fitlake.queries.registry import query
from fitlake.session import written
from fitlake.sources.tables import table
from fitlake.streaming import live


PARTS = 3
FILE_ROWS = 250_000


def stream_of(spark, name, rows, part, run):
    """Rows as a stream of ``PARTS`` micro-batches in order of ``part``, each of as many files as its rows need.

    The rows that a run has in a part are in one file, and files are read in order of their parts, so that each run
    arrives in order whichever files a micro-batch takes.
    """
    folder = live.work_folder(spark, name)
    files = max(1, math.ceil(rows.count() / PARTS / FILE_ROWS))
    for i in range(PARTS):  # one write after the other, as the source reads files by their time
        rows.where(part == i).repartition(files, run).write.mode("append").parquet(folder)
    return live.read_files(spark, folder, "*.parquet", per_trigger=files)


def steps(spark, sf):
    """Events as a stream in order of their number."""
    events = table(spark, sf, "events")
    last = events.agg(F.max("event_id")).scalar()
    part = F.least(F.floor(F.col("event_id") * PARTS / (last + 1)), F.lit(PARTS - 1))
    df = stream_of(spark, "events", events, part, "user_id")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return df.select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), "value",
                     F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, F.col("ts"))).alias("at"))


@query("str1_thin_stream", """
SELECT user_id AS run, event_id AS step, value FROM events
WHERE event_id < 2 OR floor(ln(event_id) / ln(1.05::DOUBLE)) <> floor(ln(event_id - 1) / ln(1.05::DOUBLE))""")
def _(spark, sf):
    return live.run_to_table(live.thinned(steps(spark, sf), 1.05, "at"), "thin").select(
        "run", "step", "value")


@query("str2_live_convergence", """
WITH e AS (SELECT user_id AS run, event_id AS step, value, row_number() OVER w - 1 AS k,
  first_value(value) OVER w AS f, greatest(abs(value - lag(value, 1) OVER w), abs(value - lag(value, 2) OVER w)) AS gap,
  lag(value, 2) OVER w IS NOT NULL AS full_window
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
s AS (SELECT run, step, k, CASE WHEN NOT isfinite(f - value) OR (k >= 10 AND f - value > 60) THEN -1
        WHEN full_window AND gap < 2.5 THEN 3 ELSE 0 END AS st FROM e),
r AS (SELECT run, step, k, bit_or(st) OVER (PARTITION BY run ORDER BY k) AS status FROM s)
SELECT run, step, status FROM r QUALIFY status <> coalesce(lag(status) OVER (PARTITION BY run ORDER BY k), 0)""")
def _(spark, sf):
    changes = live.live_status(steps(spark, sf), n=3, tol=2.5, fall=60.0)
    return live.run_to_table(changes, "status")


def trace_files(spark, sf):
    """The long traces as a stream in order of their steps."""
    part = F.least(F.floor(F.col("k") / 200), F.lit(PARTS - 1))
    return stream_of(spark, "traces", written(base(spark, sf), "traces"), part, "run")


@query("str2_live_tests", f"""
WITH {BASE}, {DIVERGING}, {CONSTANT}, {PARAMS}
SELECT run, step, k, div.status AS div, cost.status AS cost, par.status AS par,
       bit_or(div.status | cost.status | par.status) OVER (PARTITION BY run ORDER BY k) AS run_status
FROM div JOIN cost USING (run, step, k) JOIN par USING (run, step, k)""")
def _(spark, sf):
    tests = live.LiveTests(("xn", True, 60000.0), ("x2", 3, 2**-7), (("x0", "x1"), 4, 0.9))
    return live.run_to_table(live.live_tests(trace_files(spark, sf), tests, stop=False), "tests")


@query("str4_merge_catalogue", """
WITH e AS (SELECT user_id % 40 AS run, event_type AS kind, user_id,
             least(event_id * 3 // ((SELECT max(event_id) FROM events) + 1), 2) AS part FROM events),
g AS (SELECT run, kind, user_id, part, count(*) AS n FROM e GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY run, kind ORDER BY part, user_id) AS nr,
             min(part) OVER (PARTITION BY run, kind) AS since FROM g)
SELECT run, kind, user_id, 'kept' AS reason, 1::BIGINT AS n_rows FROM r WHERE nr = 1
UNION ALL SELECT run, kind, user_id, CASE WHEN part > since THEN 'trial already present' ELSE 'trial given twice' END,
       sum(n - (nr = 1)::INT)::BIGINT FROM r GROUP BY ALL HAVING sum(n - (nr = 1)::INT) > 0""")
def _(spark, sf):
    folder = live.work_folder(spark, "trials")
    events = table(spark, sf, "events")
    last = events.agg(F.max("event_id")).scalar()
    part = F.least(F.floor(F.col("event_id") * PARTS / (last + 1)), F.lit(PARTS - 1))
    trials = events.select((F.col("user_id") % 40).alias("run"), F.col("event_type").alias("kind"), "user_id",
                           part.alias("part"))
    for i in range(PARTS):
        trials.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(folder)
    kept, refused = live.merge_catalogue(live.read_files(spark, folder, "*.parquet", per_trigger=1), ["run", "kind"],
                                         "merged")
    gone = refused.groupBy("run", "kind", "user_id", "reason").agg(F.sum("n_rows").alias("n_rows"))
    return kept.select("run", "kind", "user_id", F.lit("kept").alias("reason"), F.lit(1).cast("long").alias("n_rows")
                       ).unionByName(gone)


@query("str3_last_records", """
SELECT user_id AS run, event_id AS step, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")
def _(spark, sf):
    return live.last_records(steps(spark, sf).select("run", "step", "value"), "run", "step", "last")


@query("str4_refresh_catalogue", """
SELECT DISTINCT user_id AS run FROM events""")
def _(spark, sf):
    return live.refresh_catalogue(steps(spark, sf).select("run"), ["run"], "catalogue")


@query("str5_tumbling_statistics", """
WITH w AS (SELECT user_id AS run, epoch_us(ts) // 21600000000 * 21600 AS start, value FROM events),
m AS (SELECT max(epoch_us(ts)) / 1e6 - 3600 AS mark FROM events)
SELECT run, start, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std
FROM w, m WHERE start + 21600 <= floor(mark * 1000) / 1000 GROUP BY run, start""")
def _(spark, sf):
    stats = live.tumbling_stats(steps(spark, sf), "run", "value", "at", "6 hours", "1 hour")
    return live.run_to_table(stats, "stats").select(
        "run", "start", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))

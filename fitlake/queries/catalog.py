"""Catalogue scans and set checks; file paths come from the page addresses."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from fitlake.operators.series import grid_report, same_grid
from fitlake.queries.common import FILES, RUNS, SERIES
from fitlake.queries.registry import query
from fitlake.queries.runs import SEGMENTS
from fitlake.session import checkpoint_dir
from fitlake.sources import catalog as C
from fitlake.sources.tables import irregular, runs, series, table


def files(spark, sf):
    path = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "^https?://", "")
    return table(spark, sf, "pages").select("page_id", path.alias("path"))


@query("src1_scan_directory", f"""
WITH {FILES}
SELECT page_id, path, split_part(path, '/', -1) AS filename,
       nullif(regexp_extract(path, '^([^/]+)/', 1), '') AS subject,
       nullif(regexp_extract(path, '/([a-z]+)/', 1), '') AS lang,
       nullif(regexp_extract(path, '([0-9]+)[^/]*$', 1), '') AS session
FROM files WHERE split_part(path, '/', -1) LIKE '%.html'""")
def _(spark, sf):
    return C.parse_files(files(spark, sf), ".html", {
        "subject": "^([^/]+)/", "lang": "/([a-z]+)/", "session": "([0-9]+)[^/]*$"})


@query("src2_add_trials", """
SELECT c_custkey AS trial, c_name AS label, c_custkey % 2 = 1 AS added FROM customer""")
def _(spark, sf):
    trials = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("trial"), F.col("c_name").alias("label"),
        (F.col("c_custkey") % 2 == 1).alias("added"))
    return C.add_trials(trials.where("NOT added"), trials.where("added"), ["trial"])


@query("src3_load_wanted_trials", """
SELECT l_suppkey AS trial, l_orderkey, l_linenumber, l_quantity AS value FROM lineitem
WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (3, 4, 5))""")
def _(spark, sf):
    wanted = table(spark, sf, "supplier").where(F.col("s_nationkey").isin(3, 4, 5)).select(
        F.col("s_suppkey").alias("trial"))
    lines = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("trial"), "l_orderkey", "l_linenumber",
        F.col("l_quantity").alias("value"))
    return C.load(lines, wanted, ["trial"])


@query("src3_stored_ranges", f"""
WITH {SERIES}
SELECT trial, k, x1 FROM series JOIN supplier ON s_suppkey = trial WHERE s_nationkey IN (3, 4, 5) AND k BETWEEN 100 AND 333""")
def _(spark, sf):
    path = os.path.join(checkpoint_dir(spark), f"series-{uuid.uuid4().hex}")
    C.write_series(series(spark, sf).select("trial", "k", "x1"), path, by="trial", span=64, slots=8)
    wanted = table(spark, sf, "supplier").where(F.col("s_nationkey").isin(3, 4, 5)).select(
        F.col("s_suppkey").alias("trial"))
    return C.read_series(spark, path, wanted, first=100, last=333)


@query("src4_metadata_files", f"""
WITH {FILES},
p AS (SELECT split_part(path, '/', 1) AS host, page_id,
             array_to_string(string_split(path, '/')[:-2], '/') AS folder FROM files),
anc AS (SELECT host, page_id, array_to_string(string_split(folder, '/')[:d], '/') AS pre, d
        FROM p, range(1, 6) r(d) WHERE d <= len(string_split(folder, '/'))),
c AS (SELECT host, count(*) AS n_files FROM p GROUP BY host),
common AS (SELECT a.host, c.n_files, pre, d FROM anc a JOIN c USING (host)
           GROUP BY a.host, c.n_files, pre, d HAVING count(*) = c.n_files),
f AS (SELECT host, n_files, arg_max(pre, d) AS folder FROM common GROUP BY ALL)
SELECT host, n_files, folder, folder || '/' || host || '_meta.json' AS metadata,
       length(host) % 3 <> 0 AS "exists" FROM f""")
def _(spark, sf):
    df = files(spark, sf).select(
        F.substring_index("path", "/", 1).alias("host"),
        F.regexp_replace("path", "/[^/]*$", "").alias("folder"))
    name = F.concat("host", F.lit("_meta.json"))
    listing = C.common_folders(df.where(F.length("host") % 3 != 0), ["host"], "folder").select(
        F.concat_ws("/", "folder", name).alias("path"))
    return C.metadata_files(df, ["host"], "folder", name, listing)


@query("src5_nearest_format_file", f"""
WITH {FILES},
p AS (SELECT page_id, string_split(path, '/') AS parts FROM files),
anc AS (SELECT page_id, d AS depth, array_to_string(parts[:d], '/') AS folder
        FROM p, range(1, 8) r(d) WHERE d < len(parts)),
fmt AS (SELECT DISTINCT array_to_string(parts[:1], '/') AS folder, 'data_format' AS name FROM p
        WHERE length(parts[1]) % 2 = 0
        UNION ALL SELECT DISTINCT array_to_string(parts[:2], '/'), unnest(['data_format.json', 'data_format.old'])
        FROM p WHERE parts[2] = 'en'),
h AS (SELECT page_id, depth, folder, min(name) AS format, count(*) > 1 AS ambiguous
      FROM anc JOIN fmt USING (folder) GROUP BY ALL)
SELECT page_id, folder, format, ambiguous FROM h
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY depth DESC) = 1""")
def _(spark, sf):
    df = files(spark, sf)
    parts = F.split("path", "/")
    top = df.where(F.length(parts[0]) % 2 == 0).select(
        parts[0].alias("folder"), F.lit("data_format").alias("name")).distinct()
    inner = df.where(F.get(parts, 1) == "en").select(
        F.concat_ws("/", F.slice(parts, 1, 2)).alias("folder"),
        F.explode(F.array(F.lit("data_format.json"), F.lit("data_format.old"))).alias("name")
    ).distinct()
    return C.nearest_format(df, top.unionByName(inner), "page_id", "path")


@query("src6_catalogue_description", """
SELECT c_name AS label, c_custkey::VARCHAR AS trial, c_mktsegment AS segment FROM customer""")
def _(spark, sf):
    fields = ["label", "trial", "segment"]
    trials = table(spark, sf, "customer").select(
        F.col("c_name").alias("label"), F.col("c_custkey").alias("trial"),
        F.col("c_mktsegment").alias("segment"))
    desc = C.to_desc(trials, "demo", "CustomerAccessor", fields)
    return C.from_desc(desc, "demo", fields, trials.select("label"), "label")


@query("src7_save_and_load_points", """
SELECT p_size AS x, p_retailprice AS y, -abs(p_retailprice - 1000) AS z FROM part""")
def _(spark, sf):
    points = table(spark, sf, "part").select(
        "p_partkey", F.col("p_size").alias("x"), F.col("p_retailprice").alias("y"),
        (-F.abs(F.col("p_retailprice") - 1000)).alias("z"))
    path = f"{checkpoint_dir(spark)}/points-{uuid.uuid4().hex}"
    even = F.col("p_partkey") % 2 == 0
    C.save_points(points.where(even).drop("p_partkey"), path)
    C.save_points(points.where(~even).drop("p_partkey"), path, replace=False)
    return C.load_points(spark, path)


@query("src10_grid_check", """
WITH g AS (SELECT user_id AS trial, event_type AS name, min(ts::DATE) AS t_min,
                  max(ts::DATE) AS t_max, count(*) AS n_bins, list_sort(list(ts::DATE)) AS stops FROM events GROUP BY ALL),
c AS (SELECT trial, count(*) AS n_hists, count(DISTINCT stops) = 1 AS consistent
      FROM g GROUP BY trial)
SELECT trial, name, t_min::VARCHAR AS t_min, t_max::VARCHAR AS t_max, n_bins, n_hists, consistent
FROM g JOIN c USING (trial)""")
def _(spark, sf):
    long = irregular(spark, sf).withColumn("t", F.col("t").cast("date"))
    return grid_report(long, ["trial"]).join(same_grid(long, ["trial"]), "trial").select(
        "trial", "name", F.col("t_min").cast("string").alias("t_min"),
        F.col("t_max").cast("string").alias("t_max"), "n_bins", "n_hists", "consistent")


@query("set1_disjoint_union", f"""
WITH {RUNS} SELECT run, split FROM runs""")
def _(spark, sf):
    r = runs(spark, sf).select("run", "split")
    first, *others = SEGMENTS
    out = r.where(F.col("split") == first)
    for split in others:
        out = C.add_trials(out, r.where(F.col("split") == split), ["run"])
    return out


@query("set2_compare_names", """
SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'right'
       WHEN b.name IS NULL THEN 'left' ELSE 'both' END AS side
FROM (SELECT DISTINCT p_name || p_type AS name FROM part WHERE p_size < 25) a
FULL JOIN (SELECT DISTINCT p_name || p_type AS name FROM part WHERE p_retailprice > 1800) b
  ON a.name = b.name""")
def _(spark, sf):
    part = table(spark, sf, "part").withColumn("name", F.concat("p_name", "p_type"))
    return C.compare_names(part.where("p_size < 25"), part.where("p_retailprice > 1800"), ["name"])


@query("set4_missing_inputs", """
SELECT DISTINCT l_orderkey AS objective, l_linenumber AS param FROM lineitem WHERE l_quantity < 25
EXCEPT SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > 0.08""")
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("objective"), F.col("l_linenumber").alias("param"), "l_quantity",
        "l_discount")
    on = ["objective", "param"]
    return C.missing_inputs(lines.where("l_quantity < 25").select(*on).distinct(),
                            lines.where("l_discount > 0.08").select(*on).distinct(), on)

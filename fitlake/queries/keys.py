"""Keys and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from fitlake.functions import labels as L
from fitlake.operators.params import flatten_json, lookup_names
from fitlake.queries.common import FILES, RUNS
from fitlake.queries.registry import query
from fitlake.queries.runs import DURATION_SQL, OUTCOME_SQL
from fitlake.sources.catalog import get_trial
from fitlake.sources.tables import runs, table


@query("key1_digest_and_label", """
WITH d AS (
  SELECT p_partkey, p_partkey % 17 AS seed,
    substr(sha256('M=2;brand=' || p_brand || ';size=' || p_size || ';type=' || p_type), 1, 10) AS param_hash,
    substr(sha256('u=' || p_name), 1, 10) AS ic_hash
  FROM part)
SELECT *, param_hash || '__' || ic_hash || '__' || seed AS label FROM d""")
def _(spark, sf):
    text = F.col("p_size").cast("string")
    params = F.create_map(F.lit("type"), "p_type", F.lit("brand"), "p_brand", F.lit("size"), text,
                          F.lit("M"), F.lit("2"))
    keyed = table(spark, sf, "part").select(
        "p_partkey", (F.col("p_partkey") % 17).alias("seed"), L.digest(params).alias("param_hash"),
        L.digest(F.create_map(F.lit("u"), "p_name")).alias("ic_hash"))
    return keyed.withColumn("label", L.trial_label(F.col("param_hash"), F.col("ic_hash"),
                                                   F.col("seed").cast("string")))


@query("key2_flatten_nested", """
SELECT event_id, unnest([{path: 'meta.k', value: json_extract_string(props, '$.k')},
                         {path: 'meta.info.kind', value: event_type},
                         {path: 'user', value: user_id::VARCHAR}], recursive := true)
FROM events""")
def _(spark, sf):
    nested = F.format_string('{"user": %d, "meta": {"k": %s, "info": {"kind": "%s"}}}',
                             F.col("user_id"), F.get_json_object("props", "$.k"),
                             F.col("event_type"))
    df = table(spark, sf, "events").select("event_id", nested.alias("params"))
    return flatten_json(df, ["event_id"], "params", depth=3)


@query("fil6_search_nested", """
SELECT event_id, 'meta.k' AS path, json_extract_string(props, '$.k') AS value FROM events
WHERE contains(json_extract_string(props, '$.k'), '7')
UNION ALL SELECT event_id, 'kind.click', event_type FROM events WHERE event_type = 'click'""")
def _(spark, sf):
    from fitlake.operators.params import search
    nested = F.format_string('{"kind": {"%s": "%s"}, "meta": {"k": %s}}', F.col("event_type"),
                             F.col("event_type"), F.get_json_object("props", "$.k"))
    df = table(spark, sf, "events").select("event_id", nested.alias("params"))
    flat = flatten_json(df, ["event_id"], "params", depth=3)
    return search(flat, "7", "click")


@query("key3_parse_label", f"""
WITH {FILES}
SELECT page_id, nullif(regexp_extract(path, '^([^.]+)\\.', 1), '') AS subject,
       nullif(regexp_extract(path, '/([0-9]+)', 1), '')::INTEGER AS session,
       nullif(regexp_extract(path, '\\.(html)$', 1), '') AS ext,
       string_split(path, '/')[2] AS lang FROM files""")
def _(spark, sf):
    from fitlake.queries.catalog import files
    path = F.col("path")
    return files(spark, sf).select(
        "page_id", L.extract(path, r"^([^.]+)\.").alias("subject"),
        L.extract(path, "/([0-9]+)").cast("int").alias("session"),
        L.extract(path, r"\.(html)$").alias("ext"), F.get(F.split(path, "/"), 1).alias("lang"))


@query("key4_get_trial", """
SELECT s_suppkey AS trial, s_name AS label, s_nationkey AS nation, count(*) AS n_requests
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL""")
def _(spark, sf):
    catalogue = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("trial"), F.col("s_name").alias("label"),
        F.col("s_nationkey").alias("nation"))
    text = F.format_string("Supplier#%09d", F.col("l_suppkey"))
    asked = table(spark, sf, "lineitem").select(
        F.when(F.col("l_linenumber") <= 3, F.col("l_suppkey")).alias("trial"),
        F.when(F.col("l_linenumber") > 3, text).alias("label"))
    counted = asked.groupBy("trial", "label").agg(F.count("*").alias("n"))
    return get_trial(catalogue, counted, ["trial"]).groupBy("trial", "label", "nation").agg(
        F.sum("n").alias("n_requests"))


@query("key5_tuple_strings", """
SELECT o_orderkey, '(' || o_custkey || ', ' || o_orderkey % 13
         || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ', ' || o_orderkey % 5 END || ')' AS key,
       CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 3 END AS length,
       lpad(len(o_custkey::VARCHAR)::VARCHAR, 10, '0') || o_custkey::VARCHAR || ',' || lpad(len((o_orderkey % 13)::VARCHAR)::VARCHAR, 10, '0') || (o_orderkey % 13)::VARCHAR
         || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ',' || lpad(len((o_orderkey % 5)::VARCHAR)::VARCHAR, 10, '0') || (o_orderkey % 5)::VARCHAR END AS sort_key
FROM orders""")
def _(spark, sf):
    raw = F.concat(F.lit("( "), F.col("o_custkey"), F.lit(","), F.col("o_orderkey") % 13,
                   F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(
                       F.concat(F.lit(" ,"), F.col("o_orderkey") % 5)), F.lit(")"))
    return table(spark, sf, "orders").select(
        "o_orderkey", L.tuple_text(raw).alias("key"), F.size(L.tuple_parts(raw)).alias("length"),
        L.tuple_order(raw).alias("sort_key"))


@query("key6_join_keys", """
SELECT o_orderkey AS fit, l_linenumber AS line, o_custkey AS run, l_linestatus <> o_orderstatus AS conflict
FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_linestatus FROM lineitem)
JOIN orders ON o_orderkey = l_orderkey""")
def _(spark, sf):
    from fitlake.operators.params import join_keys
    left = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("fit"), F.col("l_linenumber").alias("line"),
        F.col("l_linestatus").alias("status"))
    right = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("fit"), F.col("o_custkey").alias("run"),
        F.col("o_orderstatus").alias("status"))
    return join_keys(left, right, ["fit"], ["status"]).select("fit", "line", "run", "conflict")


@query("key7_labels_and_slugs", """
SELECT p_partkey, 'Brand: ' || p_brand || ' – Size: ' || p_size AS label,
       CASE WHEN p_size % 4 = 0 THEN '∅' ELSE replace(p_name, ' ', ', ') END AS slug,
       'size=' || p_size || ', type=' || p_type AS params
FROM part""")
def _(spark, sf):
    names = F.when(F.col("p_size") % 4 == 0, F.array().cast("array<string>")).otherwise(
        F.split("p_name", " "))
    return table(spark, sf, "part").select(
        "p_partkey",
        L.field_label({"brand": F.col("p_brand"), "size": F.col("p_size")}).alias("label"),
        L.slug(names).alias("slug"),
        L.param_text({"model.size": F.col("p_size"), "model.type": F.col("p_type"),
                      "model.brand": F.col("p_brand")}, exclude=["model.brand"]).alias("params"))


@query("key8_model_name", """
SELECT p_partkey, p_type || '[' || replace(p_name, ' ', ',') || ']' AS model FROM part""")
def _(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", L.model_name(F.col("p_type"), F.split("p_name", " ")).alias("model"))


@query("key9_init_key", f"""
WITH {RUNS}
SELECT run, init_key, init_key || ' / ' || run % 11 AS paired FROM runs""")
def _(spark, sf):
    key = L.init_key(F.col("reason"))
    return runs(spark, sf).select(
        "run", key.alias("init_key"),
        F.concat_ws(" / ", key, (F.col("run") % 11).cast("string")).alias("paired"))


@query("key10_outcome_class", f"""
WITH {RUNS} SELECT run, {OUTCOME_SQL} AS outcome FROM runs""")
def _(spark, sf):
    return runs(spark, sf).select("run", L.outcome_class(F.col("outcome")).alias("outcome"))


@query("key11_reason_and_duration", f"""
WITH {RUNS}
SELECT run, split_part(reason, chr(10), 1) AS reason, {DURATION_SQL} AS duration FROM runs""")
def _(spark, sf):
    return runs(spark, sf).select("run", L.first_line(F.col("reason")).alias("reason"),
                                  L.duration_text(F.col("duration_s")).alias("duration"))


@query("key12_component_names", """
SELECT l_orderkey, l_linenumber, l_partkey, 'rates_' || l_linenumber
       || CASE WHEN l_partkey % 14 > 9 THEN ',' ELSE '' END || l_partkey % 14 AS component
FROM lineitem""")
def _(spark, sf):
    idx = F.array(F.col("l_linenumber").cast("long"), F.col("l_partkey") % 14)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        L.component_name(F.lit("rates"), idx).alias("component"))


@query("key13_name_lookup", """
SELECT p_partkey, CASE WHEN p_name = 'red widget' AND p_type = 'ECONOMY' THEN 'Economy red widget'
  WHEN p_name LIKE '% widget' THEN 'W' WHEN p_name LIKE '% ring' THEN 'R'
  ELSE p_type || '.' || replace(p_name, ' ', '.') END AS shown
FROM part""")
def _(spark, sf):
    key = F.concat_ws(".", "p_type", F.regexp_replace("p_name", " ", "."))
    names = {"widget": "W", "ring": "R", "ECONOMY.red.widget": "Economy red widget"}
    return lookup_names(table(spark, sf, "part").select("p_partkey", key.alias("name")), names
                        ).select("p_partkey", "shown")


@query("key1_digests_with_separators", r"""
WITH p AS (SELECT p_partkey, p_brand, p_size, CASE WHEN p_size % 3 <> 0 THEN p_type END AS t FROM part),
s AS (SELECT p_partkey, 'one' AS kind, 'a=' || p_brand || '\;b\=' || p_size AS txt FROM p
  UNION ALL SELECT p_partkey, 'two', 'a=' || p_brand || ';b=' || p_size FROM p
  UNION ALL SELECT p_partkey, 'three', 'a\=' || p_brand || '=\\' FROM p
  UNION ALL SELECT p_partkey, 'four', 'a=' || p_brand || ';t=' || coalesce(t, '\N') FROM p
  UNION ALL SELECT p_partkey, 'five', 'a=' || p_brand FROM p)
SELECT p_partkey, kind, substr(sha256(txt), 1, 10) AS digest FROM s""")
def _(spark, sf):
    brand, size = F.col("p_brand"), F.col("p_size").cast("string")
    kind = F.when(F.col("p_size") % 3 != 0, F.col("p_type"))
    sets = {"one": [F.lit("a"), F.concat(brand, F.lit(";b="), size)], "two": [F.lit("a"), brand, F.lit("b"), size],
            "three": [F.concat(F.lit("a="), brand), F.lit("\\")], "four": [F.lit("a"), brand, F.lit("t"), kind],
            "five": [F.lit("a"), brand]}
    digests = [F.struct(F.lit(n).alias("kind"), L.digest(F.create_map(*pairs)).alias("digest"))
               for n, pairs in sets.items()]
    return table(spark, sf, "part").select("p_partkey", F.inline(F.array(*digests)))

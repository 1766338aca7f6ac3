"""Tag selection; items are parts, tagged by the words of their name, type and brand."""

from __future__ import annotations

from pyspark.sql import functions as F

from fitlake.functions import tags as G
from fitlake.operators import tags as T
from fitlake.queries.common import ITEMS
from fitlake.queries.registry import query
from fitlake.sources.tables import table

TEXT = "array_to_string(list_sort(tags), ',')"


def items(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        F.concat(F.split("p_name", " "), F.array("p_type", "p_brand")).alias("tags"))


def shown(df, *more):
    return df.select("id", G.tag_text(F.col("tags")).alias("tags"), *more)


@query("tag1_all_tags", f"""
WITH {ITEMS}, r AS (
  SELECT id, list_filter(tags, lambda t: t NOT IN ('ECONOMY', 'widget')) AS tags FROM items
  WHERE list_has_all(tags, ['ECONOMY', 'widget']))
SELECT id, {TEXT} AS tags FROM r""")
def _(spark, sf):
    return shown(T.select(items(spark, sf), ["ECONOMY", "widget"], remove=True))


@query("tag2_no_tags", f"""
WITH {ITEMS} SELECT id, {TEXT} AS tags FROM items
WHERE list_contains(tags, 'ECONOMY') AND NOT list_has_any(tags, ['widget', 'blue'])""")
def _(spark, sf):
    return shown(T.select(items(spark, sf), ["ECONOMY", "!widget", "!blue"]))


@query("tag3_squeeze", f"""
WITH {ITEMS}, r AS (SELECT * FROM items WHERE list_has_all(tags, ['SMALL', 'ring']))
SELECT id, {TEXT} AS tags, (SELECT count(*) FROM r) = 1 AS is_unique, true AS has_tags FROM r""")
def _(spark, sf):
    found = T.select(items(spark, sf), ["SMALL", "ring"])
    return shown(T.squeeze(found), "is_unique", "has_tags")


@query("tag4_by_exact_set", f"""
WITH {ITEMS}, t AS (SELECT id, {TEXT} AS tags FROM items)
SELECT tags, max(id) AS id, count(*) AS n FROM t GROUP BY tags""")
def _(spark, sf):
    return shown(T.by_tag_set(items(spark, sf), "id"), "n")


@query("tag5_deduplicate", """
SELECT o_custkey AS id, min(o_orderpriority || ',' || o_orderstatus) AS tags,
       min(o_orderpriority || ',' || o_orderstatus) <> max(o_orderpriority || ',' || o_orderstatus) AS conflict
FROM orders GROUP BY 1""")
def _(spark, sf):
    copies = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("id"), F.array("o_orderstatus", "o_orderpriority").alias("tags"))
    return T.deduplicate(copies)


@query("tag5_universe", f"WITH {ITEMS} SELECT DISTINCT unnest(tags) AS tag FROM items")
def _(spark, sf):
    return T.universe(items(spark, sf))


@query("tag6_normalise", f"""
WITH {ITEMS}, r AS (
  SELECT id, tags AS raw, list_distinct(list_transform(list_append(tags, 'model'), lambda t:
    CASE WHEN t IN ('ring', 'bolt') THEN 'metal' WHEN t = 'widget' THEN 'thing' ELSE t END)) AS tags
  FROM items)
SELECT id, {TEXT} AS tags,
  CASE WHEN list_contains(raw, 'Brand#13') THEN 'disallowed: Brand#13'
       WHEN list_has_all(raw, ['ECONOMY', 'red']) THEN 'exclusive: ECONOMY,red' END AS error
FROM r""")
def _(spark, sf):
    return shown(T.normalise(
        items(spark, sf), defaults=["model"],
        synonyms={"bolt": "ring", "ring": "metal", "widget": "thing"},
        disallowed=["Brand#13"], exclusive=[["red", "ECONOMY"]]), "error")


@query("tag7_merge_identical", """
WITH t AS (SELECT md5(text) AS digest, unnest([lang, source, 'docs']) AS tag FROM documents),
d AS (SELECT DISTINCT digest, tag FROM t)
SELECT digest, string_agg(tag, ',' ORDER BY tag) AS tags, count(*) AS n_tags FROM d GROUP BY digest""")
def _(spark, sf):
    docs = table(spark, sf, "documents").withColumn(
        "tags", F.array("lang", "source", F.lit("docs")))
    return T.merge_identical(docs, F.md5("text"))


@query("tag8_resolve_selectors", f"""
WITH {ITEMS}
SELECT 'dynamics' AS selector, id, 'dynamics.' || id AS name FROM items WHERE list_has_all(tags, ['ECONOMY', 'red'])
UNION ALL SELECT 'input.noise', id, 'input.noise.' || id FROM items
  WHERE list_contains(tags, 'ring') AND NOT list_contains(tags, 'SMALL')
UNION ALL SELECT '', id, id::VARCHAR FROM items WHERE list_contains(tags, 'Brand#3')""")
def _(spark, sf):
    return T.resolve(items(spark, sf), {
        "dynamics": ["ECONOMY", "red"], "input.noise": ["ring", "!SMALL"], "": ["Brand#3"],
    }).select("selector", "id", "name")


@query("tag7_origins_of_items", """
WITH f AS (SELECT page_id, string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://', ''), '/') AS p,
             ['model', 'objective', 'prior', 'paramset'][page_id % 4 + 1] AS kind FROM pages),
i AS (SELECT page_id, kind, CASE WHEN kind = 'paramset' AND page_id % 8 = 3 THEN p[-1] || '.paramset' ELSE p[-1] || '.py' END AS file,
        p[-2] AS folder, 'Obj' || page_id % 30 AS name, md5((page_id % 11)::VARCHAR) AS digest,
        CASE WHEN page_id % 3 > 0 THEN ['own' || page_id % 5, 'x'] END AS own FROM f),
t AS (SELECT kind, name, digest, CASE kind WHEN 'paramset' THEN digest ELSE name END AS grp,
        list_concat(coalesce(own, []), [folder], CASE WHEN kind = 'model' THEN [name]
          WHEN kind = 'paramset' AND ends_with(file, '.paramset') THEN [regexp_replace(file, '[.][^.]*$', '')]
          WHEN kind = 'paramset' THEN [name] ELSE [] END) AS tags
      FROM i WHERE folder IS NOT NULL AND NOT regexp_matches(folder, '^[_.]') AND folder <> 'blog'
        AND (kind <> 'prior' OR own IS NOT NULL))
SELECT kind, min(name) AS name, min(digest) AS digest,
       array_to_string(list_sort(list_distinct(flatten(list(tags)))), ',') AS tags FROM t GROUP BY kind, grp""")
def _(spark, sf):
    bare = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^https?://", "")
    kind = F.get(F.array(*[F.lit(k) for k in ("model", "objective", "prior", "paramset")]),
                 (F.col("page_id") % 4).cast("int"))
    stored = (kind == "paramset") & (F.col("page_id") % 8 == 3)
    found = table(spark, sf, "pages").select(
        F.concat(bare, F.when(stored, ".paramset").otherwise(".py")).alias("path"), kind.alias("kind"),
        F.concat(F.lit("Obj"), F.col("page_id") % 30).alias("name"), (F.col("page_id") % 11).alias("content"),
        F.when(F.col("page_id") % 3 > 0, F.array(F.concat(F.lit("own"), F.col("page_id") % 5), F.lit("x"))).alias("tags"))
    out = T.collect_tagged(found, F.md5(F.col("content").cast("string").cast("binary")), skipped=["blog"])
    return out.withColumn("tags", F.concat_ws(",", "tags"))


@query("tag8_nested_selectors", f"""
WITH {ITEMS}, h AS (
  SELECT 0 AS nr, 'dyn.fast' AS submodel, id, '{{"scale":"2.5"}}' AS keywords FROM items WHERE list_has_all(tags, ['ECONOMY', 'red'])
  UNION ALL SELECT 1, 'dyn', id, '{{}}' FROM items WHERE list_contains(tags, 'ring') AND NOT list_contains(tags, 'SMALL')
  UNION ALL SELECT 2, 'obs', id, '{{"order":"[1, 2]"}}' FROM items WHERE list_contains(tags, 'Brand#3')
  UNION ALL SELECT 3, '', id, '{{}}' FROM items WHERE list_contains(tags, 'widget'))
SELECT nr, submodel, id, CASE submodel WHEN '' THEN id::VARCHAR ELSE submodel || '.' || id END AS name,
       replace(replace(keywords, '"[', '['), ']"', ']') AS keywords, count(*) OVER (PARTITION BY nr) AS n_found FROM h""")
def _(spark, sf):
    out = T.resolve_nested(items(spark, sf), [
        {"dyn": [{"fast": ("ECONOMY", "red", {"scale": 2.5})}, ("ring", "!SMALL")], "obs": ("Brand#3", {"order": [1, 2]})},
        "widget"])
    return out.select("nr", "submodel", "id", "name", F.regexp_replace(F.regexp_replace(
        F.to_json("keywords"), r'"\[', "["), r'\]"', "]").alias("keywords"), "n_found")


@query("tag9_compose_prior", f"""
WITH {ITEMS}, s AS (
  SELECT 'dyn' AS sub, id FROM items WHERE list_has_all(tags, ['ECONOMY', 'red'])
  UNION ALL SELECT 'obs', id FROM items WHERE list_contains(tags, 'Brand#3'))
SELECT sub || '.' || p_name AS param, id, CASE WHEN sub = 'obs' AND p_name = 'red ring' THEN 1e0
       ELSE p_size::DOUBLE END AS scale
FROM s JOIN part ON p_partkey = id""")
def _(spark, sf):
    from fitlake.operators.distributions import compose_prior
    priors = items(spark, sf).join(table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("param"),
        F.col("p_size").cast("double").alias("scale")), "id")
    return compose_prior(priors, {"obs": ["Brand#3"], "dyn": ["ECONOMY", "red"]},
                         overrides={"obs.red ring": 1.0}).select("param", "id", "scale")

"""Registered queries of the text operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from fitlake.llm import (ann, decontaminate, lexical, licenses, line_dedup, lm_scoring, mixing, near_dedup,
                         packing, pii, quality, sharding, vector_codes)
from fitlake.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql.strip()
        return build

    return register


@query("op1_license_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs, carry=["doc_id"])


@query("op2_cross_polytope_neighbours")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


@query("op3_hash_tree_shards")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = sharding.Tree.even(40)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.assign(docs, tree, tree.with_shard(40), carry=["doc_id"])


@query("op4_line_dedup", r"""
WITH lines AS (
  SELECT doc_id, row_no, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no
  FROM (SELECT *, row_number() OVER () AS row_no FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
frequent AS (
  SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT row_no) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE f.k IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f ON keyed.k = f.k
GROUP BY row_no
""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs, min_chars=1, min_docs=10, carry=["doc_id"])
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_weak_supervision_pii")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, carry=["doc_id"])
    return found.select(
        "doc_id", *(pii.count_of(F.col("spans"), kind).alias(f"n_{kind}") for kind in pii.BASE),
        F.sha2(pii.as_text(F.col("base")), 256).alias("base_sha256"), pii.as_text(F.col("spans")).alias("spans"),
        *(pii.count_of(F.col("spans"), kind).alias(f"n_{kind}") for kind in pii.ADDED_KINDS),
        F.size("spans").cast("long").alias("n_spans"))


@query("op6_minhash_near_dedup", r"""
WITH RECURSIVE cut AS (
  SELECT row_number() OVER () AS row_no, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingled AS (
  SELECT row_no, doc_id, CASE WHEN len(w) < 2 THEN w ELSE
           list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
  FROM cut),
classes AS (
  SELECT list_sort(s) AS k, min(doc_id) AS doc, len(any_value(s)) AS n FROM shingled WHERE len(s) > 0 GROUP BY 1),
posts AS (SELECT doc, n, unnest(k) AS s FROM classes),
-- texts that share enough shingles share one of the rarest fifth of either
ranked AS (
  SELECT doc, n, p.s, row_number() OVER (PARTITION BY doc ORDER BY f.df, p.s) AS r
  FROM posts p JOIN (SELECT s, count(*) AS df FROM posts GROUP BY s) f ON f.s = p.s),
first AS (SELECT doc, n, s FROM ranked WHERE r <= n - ceil(0.8 * n) + 1),
cand AS (
  SELECT DISTINCT a.doc AS a, b.doc AS b FROM first a JOIN first b ON a.s = b.s AND a.doc < b.doc
  AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
links AS (
  SELECT a, b FROM (
    SELECT c.a, c.b, x.n AS na, y.n AS nb, len(list_intersect(x.k, y.k)) AS i
    FROM cand c JOIN classes x ON x.doc = c.a JOIN classes y ON y.doc = c.b)
  WHERE 100 * i >= 80 * (na + nb - i)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT doc AS v, doc AS c FROM classes
  UNION
  SELECT e.b, r.c FROM reach r JOIN edges e ON e.a = r.v WHERE r.c < e.b),
comp AS (SELECT v, min(c) AS c FROM reach GROUP BY v)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(m.c, s.doc_id) AS component_id,
       s.doc_id = coalesce(m.c, s.doc_id) AS kept
FROM shingled s LEFT JOIN classes c ON c.k = list_sort(s.s) LEFT JOIN comp m ON m.v = c.doc
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(table(spark, sf_dir, "documents"), words=2, percent=80)


@query("op7_best_fit_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), size=2048)


@query("op8_gru_lm_scores")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored, total = lm_scoring.score(docs, by=5, held=1, carry=["doc_id"])
    return scored.select("doc_id", (quality.remainder(5) == 1).alias("held_out"), "n_tokens", "n_known",
                         F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


@query("op9_nbsvm_quality")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, carry=["doc_id"]).select(
        "doc_id", (quality.remainder(3) == 1).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op10_decontaminate", r"""
WITH folded AS (
  SELECT row_number() OVER () AS row_no, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id::VARCHAR AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
cuts AS (
  SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS pos, least(len(w), 10) AS n
  FROM items WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item, n, array_to_string(list_slice(w, pos, pos + n - 1), ' ') AS words FROM cuts),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT row_no, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM folded, sizes WHERE len(w) >= n),
hits AS (
  SELECT row_no, pos, p.n, item FROM places p
  JOIN windows x ON x.n = p.n AND x.words = array_to_string(list_slice(p.w, pos, pos + p.n - 1), ' ')),
words AS (
  SELECT row_no, count(DISTINCT word) AS n_hit
  FROM (SELECT row_no, unnest(range(pos, pos + n)) AS word FROM hits) GROUP BY row_no),
named AS (
  SELECT row_no, count(DISTINCT item) AS n_items,
         array_to_string(list_sort(list(DISTINCT item)), ',') AS ids
  FROM hits GROUP BY row_no)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM folded LEFT JOIN words USING (row_no) LEFT JOIN named USING (row_no)
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"), window=10, carry=["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query("op11_multinomial_mix")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))[0]


@query("op12_lexical_search", r"""
WITH cut AS (
  SELECT row_number() OVER () AS row_no, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents),
item AS (
  SELECT item_no, item_id, unnest(list_distinct(t)) AS term FROM (
    SELECT row_number() OVER () AS item_no, item_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
    FROM benchmark)),
total AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM cut),
sized AS (
  SELECT row_no, doc_id, t, 10 + ((90 * len(t) * (SELECT n_docs FROM total)) // (SELECT n_terms FROM total)) AS m
  FROM cut),
tf AS (
  SELECT row_no, doc_id, m, term, count(*) AS tf
  FROM (SELECT row_no, doc_id, m, unnest(t) AS term FROM sized)
  WHERE term IN (SELECT term FROM item) GROUP BY ALL),
w AS (
  SELECT term, floor(1000 * ln((2 * (SELECT n_docs FROM total) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tf GROUP BY term),
scores AS (
  SELECT item_no, item_id, row_no, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM tf JOIN w USING (term) JOIN item USING (term) GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_no ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def _lloyd_sql(rounds: int = 6) -> str:
    """The rounds of op13 as one statement: assignments a1, a2, ... and entries b0, b1, ..."""
    far = "list_sum(list_transform(range(1, len(x.c) + 1), lambda i: (x.c[i] - b.c[i]) * (x.c[i] - b.c[i])))::BIGINT"
    steps = []
    for n in range(1, rounds + 2):
        steps.append(f"""
a{n} AS MATERIALIZED (
  SELECT r, p, c, best.e AS e, best.d AS d FROM (
    SELECT r, x.p, any_value(x.c) AS c, min(struct_pack(d := {far}, e := b.e)) AS best
    FROM parts x JOIN b{n - 1} b ON b.p = x.p GROUP BY r, x.p))""")
        if n <= rounds:
            steps.append(f"""
b{n} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{n - 1} b LEFT JOIN (
    SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM (
      SELECT p, e, j, sum(v)::BIGINT AS s, count(*) AS n FROM (
        SELECT p, e, unnest(c) AS v, generate_subscripts(c, 1) AS j FROM a{n}) GROUP BY p, e, j)
    GROUP BY p, e) m ON m.p = b.p AND m.e = b.e)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label,
         list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT r, vec_id, p, list_slice(v, p * len(v) // 8 + 1, (p + 1) * len(v) // 8) AS c
  FROM kept, range(8) AS t(p)),
b0 AS MATERIALIZED (
  SELECT p, e, c FROM (
    SELECT p, c, row_number() OVER (PARTITION BY p ORDER BY vec_id, r) - 1 AS e FROM parts) WHERE e < 16),
{",".join(steps)},
coded AS (
  SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error
  FROM a{rounds + 1} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256
FROM kept JOIN coded ON coded.r = kept.r
"""


@query("op13_vector_codes", _lloyd_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digest(vector_codes.compress(table(spark, sf_dir, "embeddings")))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)

"""Histograms, densities, evaluated points and text differences."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from fitlake.functions import families
from fitlake.operators import distributions as D
from fitlake.operators.ordered import frames, number
from fitlake.queries.common import SERIES
from fitlake.queries.registry import query
from fitlake.queries.series import UNIFORM
from fitlake.sources.tables import series, table


def hist_sql(source: str, bounds: str = "", tag: str = "") -> str:
    """Histogram CTEs over ``source(key, v)``; ``bounds`` is a table (key, lo, hi)."""
    ends = "b.lo AS lo0, b.hi AS hi0" if bounds else "min(v) AS lo0, max(v) AS hi0"
    join = f"JOIN {bounds} b USING (key) WHERE v BETWEEN b.lo AND b.hi" if bounds else ""
    more = ", b.lo, b.hi" if bounds else ""
    return f"""q{tag} AS (
  SELECT key, {ends}, max(v) - min(v) AS ptp, count(*) AS total,
         quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3
  FROM {source} {join} GROUP BY key{more}),
e{tag} AS (SELECT key, total, CASE WHEN hi0 > lo0 THEN lo0 ELSE lo0 - 0.5 END AS lo,
  CASE WHEN hi0 > lo0 THEN hi0 ELSE hi0 + 0.5 END AS hi,
  CASE WHEN hi0 > lo0 THEN CAST(ceil((hi0 - lo0) / CASE WHEN q3 > q1
       THEN least(2 * (q3 - q1) / pow(total, 1e0 / 3), ptp / (log2(total) + 1))
       ELSE ptp / (log2(total) + 1) END) AS BIGINT) ELSE 1 END AS bins FROM q{tag}),
h{tag} AS (SELECT key, lo, hi, total, bins,
  least(CAST(floor((v - lo) / (hi - lo) * bins) AS BIGINT), bins - 1) AS bin, count(*) AS freq
  FROM {source} JOIN e{tag} USING (key) WHERE v BETWEEN lo AND hi GROUP BY ALL)"""


TRUNC = """tb AS (SELECT key, min(CASE WHEN up >= 50 THEN lo + bin * ((hi - lo) / bins) END) AS lo,
    max(CASE WHEN down >= 50 THEN lo + (bin + 1) * ((hi - lo) / bins) END) AS hi
  FROM (SELECT *, sum(freq) OVER (PARTITION BY key ORDER BY bin) AS up,
               sum(freq) OVER (PARTITION BY key ORDER BY bin DESC) AS down FROM h) GROUP BY key)"""

DIMS = f"""{SERIES}, long AS (
  SELECT 'x0' AS key, x0 AS v, trial, k FROM series UNION ALL SELECT 'x1', x1, trial, k FROM series
  UNION ALL SELECT 'x2', x2, trial, k FROM series UNION ALL SELECT 'x3', x3, trial, k FROM series)"""


def dims(spark, sf):
    """Each component of the series as one dimension."""
    return series(spark, sf).unpivot(["trial", "k"], ["x0", "x1", "x2", "x3"], "key", "v")


@query("dist1_density_histogram", f"""
WITH {DIMS}, {hist_sql("long")}
SELECT key, bins, bin, freq, round(freq / (total * ((hi - lo) / bins)), 9) AS density FROM h""")
def _(spark, sf):
    return D.histogram(dims(spark, sf), ["key"], "v").select(
        "key", "bins", "bin", "freq", F.round("density", 9).alias("density"))


@query("dist2_truncated_histogram", f"""
WITH src AS (SELECT o_orderpriority AS key, o_totalprice AS v FROM orders),
{hist_sql("src")}, {TRUNC}, {hist_sql("src", "tb", "2")}
SELECT key, round(lo, 4) AS lo, round(hi, 4) AS hi, bins, bin, freq FROM h2""")
def _(spark, sf):
    df = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("key"),
                                           F.col("o_totalprice").alias("v"))
    return D.truncated_histogram(df, ["key"], "v").select(
        "key", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"), "bins", "bin", "freq")


PRIORS = """priors AS (
  SELECT 'n' || n_nationkey AS param, c::INTEGER AS comp, n_nationkey / 10e0 AS a, (n_nationkey % 4 + 1) / 4e0 AS b,
         CASE n_nationkey % 4 WHEN 0 THEN 'normal' WHEN 1 THEN 'lognormal' WHEN 2 THEN 'dirichlet'
              ELSE 'constant' END AS dist
  FROM nation, range(2) r(c))"""


def priors(spark, sf):
    nation = table(spark, sf, "nation")
    kinds = F.array(*[F.lit(d) for d in ("normal", "lognormal", "dirichlet", "constant")])
    return nation.select(
        F.concat(F.lit("n"), F.col("n_nationkey")).alias("param"),
        F.explode(F.sequence(F.lit(0), F.lit(1))).alias("comp"),
        (F.col("n_nationkey") / 10).alias("a"), ((F.col("n_nationkey") % 4 + 1) / 4).alias("b"),
        F.get(kinds, F.col("n_nationkey") % 4).alias("dist"))


def draws_sql(n: int) -> str:
    key = "'20201115:prior:' || param || ':' || comp || ':' || d"
    ua, ub, u = (UNIFORM.format(key + " || ':a'"), UNIFORM.format(key + " || ':b'"),
                 UNIFORM.format(key))
    return f"""{PRIORS},
u AS (SELECT *, d::INTEGER AS draw, a + b * (sqrt(-2 * ln(1 - {ua})) * cos(2 * pi() * {ub})) AS z,
             -ln(1 - {u}) AS e FROM priors, range({n}) r2(d)),
draws AS (SELECT param, comp, dist, draw, CASE dist WHEN 'normal' THEN z WHEN 'lognormal' THEN exp(z)
  WHEN 'dirichlet' THEN e / sum(e) OVER (PARTITION BY param, draw) ELSE a END AS value FROM u)"""


@query("smp8_prior_samples", f"""
WITH {draws_sql(20)}
SELECT param, comp, dist, draw, round(value, 8) AS value,
       round(CASE dist WHEN 'lognormal' THEN ln(value) ELSE value END, 8) AS optim_value FROM draws""")
def _(spark, sf):
    from fitlake.operators.sampling import prior_samples
    return prior_samples(priors(spark, sf), 20, "prior").select(
        "param", "comp", "dist", "draw", F.round("value", 8).alias("value"),
        F.round("optim_value", 8).alias("optim_value"))


def poly_sql(x: str, powers) -> str:
    """Polynomial of a column, highest power last."""
    out = f"{powers[-1]!r}::DOUBLE"
    for c in reversed(powers[:-1]):
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def ratio_sql(x: str, table) -> str:
    return f"{poly_sql(x, table[0])} / {poly_sql(x, table[1])}"


#: Normal quantile z of the column p of a table ``s``.
NORMAL_SQL = f"""q AS (SELECT *, p - 0.5 AS q, 0.180625 - (p - 0.5) * (p - 0.5) AS c, sqrt(-ln(least(p, 1 - p))) - 1.6 AS r
  FROM s),
z AS (SELECT *, CASE WHEN abs(q) <= 0.425 THEN q * {ratio_sql("c", families.QUANTILE_MIDDLE)}
  ELSE sign(q) * {ratio_sql("r", families.QUANTILE_TAIL)} END AS z FROM q)"""

BELOW, ABOVE = NormalDist().cdf(-1.0), NormalDist().cdf(2.0)


@query("smp8_truncated_prior_samples", f"""
WITH t AS (SELECT 'n' || n_nationkey AS param, n_nationkey / 10e0 AS a, (n_nationkey % 4 + 1) / 4e0 AS b, d::INTEGER AS draw
  FROM nation, range(40) r(d)),
s AS (SELECT *, {BELOW!r} + {UNIFORM.format("'20201115:cut:' || param || ':0:' || draw")} * ({ABOVE!r} - {BELOW!r}) AS p FROM t),
{NORMAL_SQL}
SELECT param, draw, round(a + b * z, 7) AS value FROM z""")
def _(spark, sf):
    from fitlake.operators.sampling import prior_samples
    a, b = F.col("n_nationkey") / 10, (F.col("n_nationkey") % 4 + 1) / 4
    cut = table(spark, sf, "nation").select(
        F.concat(F.lit("n"), F.col("n_nationkey")).alias("param"), F.lit(0).alias("comp"),
        F.lit("truncnorm").alias("dist"), a.alias("a"), b.alias("b"), (a - b).alias("lo"), (a + 2 * b).alias("hi"))
    return prior_samples(cut, 40, "cut").select("param", "draw", F.round("value", 7).alias("value"))


@query("scl4_normal_quantile", f"""
WITH s AS (SELECT o_orderkey, (o_orderkey % 9973 + 0.5) / 9973e0 AS p FROM orders), {NORMAL_SQL}
SELECT o_orderkey, round(z, 10) AS z, round(p, 10) AS back FROM z""")
def _(spark, sf):
    p = (F.col("o_orderkey") % 9973 + 0.5) / 9973
    z = families.normal_quantile(p)
    return table(spark, sf, "orders").select("o_orderkey", z.alias("z")).select(
        "o_orderkey", F.round("z", 10).alias("z"), F.round(families.normal_cdf(F.col("z")), 10).alias("back"))


@query("dist3_prior_marginals", f"""
WITH {draws_sql(1000)}, src AS (SELECT param || '_' || comp AS key, value AS v FROM draws WHERE dist <> 'constant'),
{hist_sql("src")}, {TRUNC}, {hist_sql("src", "tb", "2")}
SELECT key, bins, bin, freq FROM h2""")
def _(spark, sf):
    from fitlake.operators.sampling import prior_samples
    random = priors(spark, sf).where("dist <> 'constant'")
    draws = prior_samples(random, 1000, "prior").select(
        F.concat_ws("_", "param", F.col("comp").cast("string")).alias("key"),
        F.col("value").alias("v"))
    return D.truncated_histogram(draws, ["key"], "v").select("key", "bins", "bin", "freq")


@query("dist4_smooth_density", f"""
WITH {DIMS}, s AS (SELECT key, min(v) AS lo, max(v) AS hi, stddev_samp(v) * pow(count(*), -0.2::DOUBLE) AS h
                   FROM long GROUP BY key),
g AS (SELECT *, j::INTEGER AS j, lo + (hi - lo) * (j / 31e0) AS point FROM s, range(32) r(j))
SELECT key, g.j, round(point, 6) AS point,
       round(avg(exp(-0.5 * pow((point - v) / h, 2)) / (h * sqrt(2 * pi()))), 9) AS density
FROM long JOIN g USING (key) GROUP BY ALL""")
def _(spark, sf):
    return D.smooth_density(dims(spark, sf), ["key"], "v", 32).select(
        "key", "j", F.round("point", 6).alias("point"), F.round("density", 9).alias("density"))


@query("dist5_objective_marginal", f"""
WITH {DIMS}, {hist_sql("long")},
p AS (SELECT key, least(CAST(ceil((v - lo) / ((hi - lo) / bins)) AS BIGINT) - 1, bins - 1) AS bin,
             avg(exp(-(k % 97) / 40e0)) AS p
      FROM long JOIN e USING (key) WHERE v > lo GROUP BY ALL),
f AS (SELECT e.key, n.bin, lo, hi, bins, coalesce(p.p, 0) AS p
      FROM e JOIN (SELECT key, unnest(range(bins)) AS bin FROM e) n USING (key)
      LEFT JOIN p ON p.key = e.key AND p.bin = n.bin),
t AS (SELECT key, sum((p + nxt) / 2) AS area FROM (SELECT key, p * ((hi - lo) / bins) AS p,
        lead(p * ((hi - lo) / bins)) OVER (PARTITION BY key ORDER BY bin) AS nxt FROM f) GROUP BY key)
SELECT key, bin, round(lo + (bin + 0.5) * ((hi - lo) / bins), 6) AS center, round(p / area, 8) AS p,
       CASE WHEN bins < 20 THEN 'few bins' END AS warning
FROM f JOIN t USING (key) WHERE p > 0""")
def _(spark, sf):
    df = dims(spark, sf).withColumn("logp", -(F.col("k") % 97) / 40.0)
    return D.objective_marginal(df, ["key"], "v", "logp").select(
        "key", "bin", F.round("center", 6).alias("center"), F.round("p", 8).alias("p"), "warning")


@query("dist6_at_least_as_likely_as_truth", f"""
WITH {SERIES}, l AS MATERIALIZED (SELECT trial, k, -abs(x1 - 50000) / 1000 AS lp FROM series),
t AS (SELECT trial, lp AS gt FROM l WHERE k = 7)
SELECT trial, k, round(lp, 7) AS lp, k = 7 AS is_truth,
       row_number() OVER (PARTITION BY trial ORDER BY k <> 7, lp DESC, k) - 1 AS rank
FROM l JOIN t USING (trial) WHERE lp >= gt""")
def _(spark, sf):
    df = series(spark, sf).select("trial", "k", (-F.abs(F.col("x1") - 50000) / 1000).alias("lp"))
    return D.at_least_truth(df, "trial", "lp", F.col("k") == 7, 7, ["k"])


def points(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", F.col("p_type").alias("grp"), F.col("p_size").alias("x"),
        F.col("p_retailprice").alias("y"), (-F.abs(F.col("p_retailprice") - 1000)).alias("z"))


POINTS = """points AS (SELECT p_partkey, p_type AS grp, p_size AS x, p_retailprice AS y,
            -abs(p_retailprice - 1000) AS z FROM part)"""


@query("dist7_threshold", f"WITH {POINTS} SELECT * FROM points WHERE z BETWEEN -95 AND -20")
def _(spark, sf):
    return D.threshold(points(spark, sf), "z", -95.0, -20.0)


@query("dist8_high_probability_set", f"""
WITH {POINTS}, m AS (SELECT grp, max(z) AS best FROM points GROUP BY grp)
SELECT points.* FROM points JOIN m USING (grp) WHERE z - best >= ln(1e-20::DOUBLE)""")
def _(spark, sf):
    return D.high_probability(points(spark, sf), ["grp"], "z", F.lit(1e-20))


@query("sort3_extreme_points", f"""
WITH {POINTS}, a AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY z DESC, p_partkey) AS t,
                     row_number() OVER (PARTITION BY grp ORDER BY z, p_partkey) AS l FROM points)
SELECT a.grp, a.x AS argmax_x, a.y AS argmax_y, a.z AS argmax_z, b.x AS argmin_x, b.y AS argmin_y, b.z AS argmin_z
FROM a JOIN a b ON a.grp = b.grp WHERE a.t = 1 AND b.l = 1""")
def _(spark, sf):
    return D.extreme_points(points(spark, sf), ["grp"], "z", ["x", "y"], "p_partkey")


@query("sort4_discard_lowest", f"""
WITH {POINTS}, r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY z, p_partkey) - 1 AS rn,
                     count(*) OVER (PARTITION BY grp) AS n FROM points)
SELECT p_partkey, grp, x, y, z FROM r WHERE rn >= floor(n * (1 / (1 + 30 / 5e0)))""")
def _(spark, sf):
    return D.discard_lowest(points(spark, sf), ["grp"], "z", ["p_partkey"], 0.5, 30, 5)


ODD = """odd AS (SELECT p_partkey, grp, x, y, CASE p_partkey % 9 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN NULL
  WHEN 2 THEN 'Infinity'::DOUBLE WHEN 3 THEN '-Infinity'::DOUBLE ELSE z END AS z FROM points),
good AS (SELECT * FROM odd WHERE z < 'Infinity'::DOUBLE)"""  # NaN is above infinity in SQL too


def odd_points(spark, sf):
    """Points of which some have no score, or one that is not finite."""
    kind = F.col("p_partkey") % 9
    return points(spark, sf).withColumn(
        "z", F.when(kind == 0, float("nan")).when(kind == 1, None).when(kind == 2, float("inf"))
        .when(kind == 3, float("-inf")).otherwise(F.col("z")))


@query("dist8_scores_not_finite", f"""
WITH {POINTS}, {ODD}, m AS (SELECT grp, max(z) AS best FROM good GROUP BY grp)
SELECT good.* FROM good JOIN m USING (grp) WHERE z > '-Infinity'::DOUBLE AND z - best >= ln(1e-20::DOUBLE)""")
def _(spark, sf):
    return D.high_probability(odd_points(spark, sf), ["grp"], "z", F.lit(1e-20))


@query("sort3_scores_not_finite", f"""
WITH {POINTS}, {ODD}, a AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY z DESC, p_partkey) AS t,
                     row_number() OVER (PARTITION BY grp ORDER BY z, p_partkey) AS l FROM good)
SELECT a.grp, a.x AS argmax_x, a.y AS argmax_y, b.x AS argmin_x, b.y AS argmin_y
FROM a JOIN a b ON a.grp = b.grp WHERE a.t = 1 AND b.l = 1""")
def _(spark, sf):
    out = D.extreme_points(odd_points(spark, sf), ["grp"], "z", ["x", "y"], "p_partkey")
    return out.drop("argmax_z", "argmin_z")


@query("sort4_scores_not_finite", f"""
WITH {POINTS}, {ODD}, r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY
    CASE WHEN z < 'Infinity'::DOUBLE THEN z END NULLS FIRST, p_partkey) - 1 AS rn, count(*) OVER (PARTITION BY grp) AS n FROM odd)
SELECT p_partkey, grp, x, y FROM r WHERE rn >= floor(n * (1 / (1 + 30 / 5e0)))""")
def _(spark, sf):
    return D.discard_lowest(odd_points(spark, sf), ["grp"], "z", ["p_partkey"], 0.5, 30, 5).drop("z")


@query("dist9_cached_evaluation", f"""
WITH {POINTS} SELECT p_partkey, x, y, z FROM points""")
def _(spark, sf):
    p = points(spark, sf)
    store = p.where("p_partkey % 3 = 0").select("p_partkey", "x", "y", "z")
    fresh = p.select("p_partkey", "x", "y")
    return D.evaluate_new(fresh, store, ["p_partkey"], -F.abs(F.col("y") - 1000), "z")


@query("dist10_regular_mesh", f"""
WITH {POINTS}, e AS (SELECT grp, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM points GROUP BY grp)
SELECT grp, round(x0 + (x1 - x0) * i / 4e0, 6) AS x, round(y0 + (y1 - y0) * j / 3e0, 6) AS y
FROM e, range(5) a(i), range(4) b(j)""")
def _(spark, sf):
    return D.regular_mesh(points(spark, sf), ["grp"], ["x", "y"], [5, 4]).select(
        "grp", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("dist12_text_differences", """
WITH p AS (SELECT doc_id AS b_id, lag(doc_id) OVER (PARTITION BY lang, n_chars ORDER BY doc_id) AS a_id FROM documents),
t AS (SELECT a_id, b_id, a.text AS a, b.text AS b FROM p JOIN documents a ON a.doc_id = a_id
      JOIN documents b ON b.doc_id = b_id),
c AS (SELECT a_id, b_id, unnest(string_split(a, '')) AS ca, unnest(string_split(b, '')) AS cb,
             generate_subscripts(string_split(a, ''), 1) - 1 AS i FROM t),
d AS (SELECT a_id, b_id, i, i - lag(i) OVER (PARTITION BY a_id, b_id ORDER BY i) AS gap
      FROM c WHERE ca <> cb)
SELECT a_id, b_id, i::INTEGER AS at, substr(a, greatest(i - 9, 1), 60) AS context_a,
       substr(b, greatest(i - 9, 1), 60) AS context_b
FROM d JOIN t USING (a_id, b_id) WHERE gap IS NULL OR gap > 6""")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    keys = ["lang", "n_chars"]
    placed = number(docs.select("doc_id", *keys), keys, ["doc_id"])
    pairs = frames(placed, keys, "k", {"a_id": lambda w: F.lag("doc_id").over(w)}, before=1).where(
        "a_id IS NOT NULL").select("a_id", F.col("doc_id").alias("b_id"))
    texts = docs.select("doc_id", "text")
    both = (pairs.join(texts.select(F.col("doc_id").alias("a_id"), F.col("text").alias("a")), "a_id")
            .join(texts.select(F.col("doc_id").alias("b_id"), F.col("text").alias("b")), "b_id"))
    return D.text_differences(both, "a", "b", ["a_id", "b_id"])


Z = NormalDist().inv_cdf(0.95)


@query("dist13_truth_in_prior", f"""
WITH p AS (SELECT p_partkey, p_size::DOUBLE AS mu, 2e0 AS sigma, p_retailprice / 100 AS v FROM part),
a AS (SELECT *, mu - {Z!r} * sigma AS lo0, mu + {Z!r} * sigma AS hi0 FROM p),
b AS (SELECT *, CASE WHEN v < lo0 THEN v - 0.05 * (hi0 - v) ELSE lo0 END AS lo FROM a),
c AS (SELECT *, CASE WHEN v > hi0 THEN v + 0.05 * (v - lo) ELSE hi0 END AS hi FROM b)
SELECT p_partkey, j::INTEGER AS j, round(lo + (hi - lo) * j / 99, 6) AS x,
       round(exp(-0.5 * pow((lo + (hi - lo) * j / 99 - mu) / sigma, 2)) / (sigma * sqrt(2 * pi())), 9) AS pdf
FROM c, range(100) r(j)""")
def _(spark, sf):
    df = table(spark, sf, "part").select(
        "p_partkey", F.lit("normal").alias("dist"), F.col("p_size").cast("double").alias("a"), F.lit(2.0).alias("b"),
        F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"),
        (F.col("p_retailprice") / 100).alias("v"))
    return D.truth_in_prior(df, ["p_partkey"], 100).select(
        "p_partkey", "j", F.round("x", 6).alias("x"), F.round("pdf", 9).alias("pdf"))


KINDS = ("lognormal", "uniform", "exponential", "truncnorm")


@query("dist13_truth_in_any_prior", f"""
WITH p AS (SELECT p_partkey, p_partkey % 4 AS kind, p_retailprice / 100 AS v,
    CASE p_partkey % 4 WHEN 0 THEN p_size / 20e0 ELSE p_size::DOUBLE END AS a,
    CASE p_partkey % 4 WHEN 0 THEN 0.5e0 WHEN 1 THEN p_size + 4e0 ELSE 2e0 END AS b FROM part),
e AS (SELECT *, CASE kind WHEN 1 THEN a WHEN 3 THEN a - b ELSE 0 END AS l,
    CASE kind WHEN 0 THEN exp(a + {Z!r} * b) WHEN 1 THEN b WHEN 2 THEN -a * ln(0.05e0) ELSE a + 2 * b END AS h FROM p),
c AS (SELECT *, CASE WHEN v < l THEN v - 0.05 * (h - v) ELSE l END AS lo FROM e),
d AS (SELECT *, CASE WHEN v > h THEN v + 0.05 * (v - lo) ELSE h END AS hi FROM c),
g AS (SELECT *, lo + (hi - lo) * j / 49 AS x FROM d, range(50) r(j))
SELECT p_partkey, j::INTEGER AS j, round(x, 6) AS x, round(CASE
    WHEN kind = 0 AND x > 0 THEN exp(-0.5 * pow((ln(x) - a) / b, 2)) / (x * b * sqrt(2 * pi()))
    WHEN kind = 1 AND x >= a AND x <= b THEN 1 / (b - a) WHEN kind = 2 AND x >= 0 THEN exp(-x / a) / a
    WHEN kind = 3 AND x >= l AND x <= h
    THEN exp(-0.5 * pow((x - a) / b, 2)) / (b * sqrt(2 * pi())) / ({ABOVE!r} - {BELOW!r}) ELSE 0 END, 8) AS pdf
FROM g""")
def _(spark, sf):
    kind, size = F.col("p_partkey") % 4, F.col("p_size").cast("double")
    df = table(spark, sf, "part").select(
        "p_partkey", F.get(F.array(*[F.lit(k) for k in KINDS]), kind.cast("int")).alias("dist"),
        F.when(kind == 0, size / 20).otherwise(size).alias("a"),
        F.when(kind == 0, 0.5).when(kind == 1, size + 4).otherwise(2.0).alias("b"),
        (F.col("p_retailprice") / 100).alias("v"))
    df = df.withColumns({"lo": F.col("a") - F.col("b"), "hi": F.col("a") + 2 * F.col("b")})
    return D.truth_in_prior(df, ["p_partkey"], 50).select(
        "p_partkey", "j", F.round("x", 6).alias("x"), F.round("pdf", 8).alias("pdf"))

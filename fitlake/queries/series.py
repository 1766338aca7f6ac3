"""Series: merging, slicing, batching, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from fitlake.functions import rng, scalars
from fitlake.operators import likelihood as K
from fitlake.operators import series as S
from fitlake.queries.common import SERIES
from fitlake.queries.registry import query
from fitlake.sources.tables import irregular, series, table

DAY = 86_400_000_000
LENGTHS = "lengths AS (SELECT l_suppkey AS trial, count(*) AS n_bins FROM lineitem GROUP BY 1)"


@query("join1_arrays_on_axis", """
WITH e AS (SELECT vec_id AS trial, vec_id % 7 AS first, 70::BIGINT AS n_bins, embedding AS v FROM embeddings),
a AS (SELECT trial, first + i - 1 AS k, v[i]::DOUBLE AS a FROM e, range(1, 65) r(i)),
b AS (SELECT trial, first + i - 1 AS k, CASE WHEN i % 13 <> 5 THEN v[65 - i]::DOUBLE END AS b FROM e, range(1, 65) r(i)
      WHERE i <= 40 + trial % 20),
c AS (SELECT trial, k, a AS c FROM a WHERE k >= 9),
m AS (SELECT trial, k, a, b, c FROM a LEFT JOIN b USING (trial, k) LEFT JOIN c USING (trial, k)),
l AS (SELECT trial, max(k) AS last FROM m WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL GROUP BY trial)
SELECT trial, k, a, b, c FROM m JOIN l USING (trial) WHERE k <= last""")
def _(spark, sf):
    vec = table(spark, sf, "embeddings").select(F.col("vec_id").alias("trial"), "embedding")
    axis = vec.select("trial", (F.col("trial") % 7).alias("first"), F.lit(70).cast("long").alias("n_bins"))
    gaps = F.transform(F.slice(F.reverse("embedding"), F.lit(1), (40 + F.col("trial") % 20).cast("int")),
                       lambda x, i: F.when((i + 1) % 13 != 5, x))
    a = S.arrays_on_axis(vec, "embedding", axis)
    b = S.arrays_on_axis(vec.select("trial", gaps.alias("b")), "b", axis)
    return S.merge_on_axis({"a": a, "b": b, "c": a.where("k >= 9")})


@query("join1_merge_on_axis", f"""
WITH {SERIES}, {LENGTHS}, a AS (SELECT trial, k, x0 FROM series WHERE k >= 2),
b AS (SELECT trial, k, x1 FROM series JOIN lengths USING (trial) WHERE k % 11 <> 5 AND k < n_bins - 3),
c AS (SELECT trial, k, x2 FROM series JOIN lengths USING (trial) WHERE k < n_bins - 1),
m AS (SELECT trial, k, x0 AS a, x1 AS b, x2 AS c FROM a FULL JOIN b USING (trial, k)
      FULL JOIN c USING (trial, k)),
l AS (SELECT trial, max(k) AS last FROM m WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL
      GROUP BY trial)
SELECT trial, k, a, b, c FROM m JOIN l USING (trial) WHERE k <= last""")
def _(spark, sf):
    df = series(spark, sf).join(lengths(spark, sf), "trial")

    def part(column, keep):
        return df.where(keep).select("trial", "k", F.col(column).alias("value"))

    return S.merge_on_axis({"a": part("x0", "k >= 2"), "b": part("x1", "k % 11 <> 5 AND k < n_bins - 3"),
                            "c": part("x2", "k < n_bins - 1")})


def segments(spark, sf):
    first = irregular(spark, sf).groupBy("trial").agg(F.min("us").alias("us0"))
    spans = F.array(*[F.struct(F.lit(n).alias("segment"), F.lit(a).alias("a"), F.lit(b).alias("b"))
                      for n, a, b in ((0, 3, 5), (1, 10, 2), (2, 11, 9))])
    return first.select("trial", "us0", F.inline(spans)).select(
        "trial", "segment", (F.col("us0") + F.col("a") * DAY).alias("start"),
        (F.col("us0") + (F.col("a") + F.col("b")) * DAY).alias("stop"))


SEGMENTS = f"""segments AS (
  SELECT trial, s.segment, us0 + s.a * {DAY} AS start, us0 + (s.a + s.b) * {DAY} AS stop
  FROM (SELECT user_id AS trial, min(epoch_us(ts)) AS us0 FROM events GROUP BY 1),
       (VALUES (0, 3, 5), (1, 10, 2), (2, 11, 9)) s(segment, a, b))"""


@query("join2_segment_slice", f"""
WITH {SEGMENTS}
SELECT trial, segment::INTEGER AS segment, event_id, value FROM events
JOIN segments ON trial = user_id AND epoch_us(ts) BETWEEN start AND stop""")
def _(spark, sf):
    return S.slices(irregular(spark, sf), segments(spark, sf), "trial", "us", "start", "stop",
                    width=2.0 * DAY).select("trial", "segment", "event_id", "value")


@query("smp4_segment_keys", f"""
WITH {SEGMENTS}, r AS (SELECT trial, segment, count(*) AS n_rows FROM events
  JOIN segments ON trial = user_id AND epoch_us(ts) BETWEEN start AND stop GROUP BY ALL)
SELECT trial, '(' || trial || ', ' || start || ', ' || stop || ')' AS segment_key,
       stop - start AS length, n_rows
FROM segments JOIN r USING (trial, segment)""")
def _(spark, sf):
    rows = S.slices(irregular(spark, sf), segments(spark, sf), "trial", "us", "start", "stop",
                    width=2.0 * DAY)
    key = F.format_string("(%d, %d, %d)", "trial", "start", "stop")
    return rows.groupBy("trial", "start", "stop").agg(F.count("*").alias("n_rows")).select(
        "trial", key.alias("segment_key"), (F.col("stop") - F.col("start")).alias("length"),
        "n_rows")


def lengths(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("trial")).agg(
        F.count("*").alias("n_bins"))


def batches(spark, sf):
    """Eight batches of 25 bins per trial, over its whole length."""
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("trial"), F.posexplode(F.sequence(F.lit(0), F.lit(7)))
        .alias("batch", "_n")).select(
        "trial", "batch", "_n").join(lengths(spark, sf), "trial").select(
        "trial", "batch", ((F.col("_n") * 97 + F.col("trial") * 13) % (F.col("n_bins") - 24)).alias("b"))


BATCHES = f"""{LENGTHS}, batches AS (
  SELECT trial, n::INTEGER AS batch, (n * 97 + trial * 13) % (n_bins - 24) AS b
  FROM supplier JOIN lengths ON trial = s_suppkey, range(8) r(n))"""


@query("join3_batch_rows", f"""
WITH {SERIES}, {BATCHES}
SELECT s.trial, batch, k, x1 FROM series s
JOIN batches b ON b.trial = s.trial AND k >= b AND k < b + 25""")
def _(spark, sf):
    return S.batch_rows(series(spark, sf), batches(spark, sf), "trial", 25).select(
        "trial", "batch", "k", "x1")


@query("win5_discard_padding", f"""
WITH {SERIES}, l AS (
  SELECT trial, k, 'a' AS name, x0 AS value, 0 AS pad FROM series UNION ALL
  SELECT trial, k, 'b', x1, 3 FROM series UNION ALL SELECT trial, k, 'c', x2, 1 FROM series)
SELECT trial, name, k - (3 - pad) AS k, value FROM l WHERE k >= 3 - pad""")
def _(spark, sf):
    long = S.components(series(spark, sf), {("a", 0): "x0", ("b", 0): "x1", ("c", 0): "x2"}).drop("idx")
    return S.discard_padding(long, {"a": 0, "b": 3, "c": 1}).select("trial", "name", "k", "value")


@query("scl3_time_bins", """
WITH o AS (SELECT user_id AS trial, min(epoch_us(ts)) / 1e6 AS t0 FROM events GROUP BY 1)
SELECT event_id, CAST(round((epoch_us(ts) / 1e6 - t0) / 3600e0) AS BIGINT) AS k,
       round(epoch_us(ts) / 1e6 + (0e0 - t0), 3) AS shifted
FROM events JOIN o ON trial = user_id""")
def _(spark, sf):
    df = irregular(spark, sf).withColumn("t", F.col("us") / 1e6)
    t0 = df.groupBy("trial").agg(F.min("t").alias("t0"))
    return df.join(t0, "trial").select(
        "event_id", S.to_bin(F.col("t"), F.col("t0"), 3600.0).alias("k"),
        F.round(S.shift_origin(F.col("t"), F.col("t0"), F.lit(0.0)), 3).alias("shifted"))


@query("agg13_stationary_statistics", f"""
WITH {SERIES}
SELECT trial, round(avg(x1), 2) AS mean, round(stddev_samp(x1), 2) AS std FROM series WHERE k >= 100
GROUP BY trial""")
def _(spark, sf):
    out = K.stationary(series(spark, sf), "x1", 100, ["trial"])
    return out.select("trial", F.round("mean", 2).alias("mean"), F.round("std", 2).alias("std"))


@query("agg14_window_statistics", f"""
WITH {SERIES}
SELECT trial, w::INTEGER AS width, (k - 20) // w AS win, round(avg(x1), 3) AS mean,
       round(stddev_samp(x1), 3) AS std
FROM series, (VALUES (7), (31)) v(w) WHERE k >= 20 GROUP BY ALL HAVING count(*) = w""")
def _(spark, sf):
    out = S.window_stats(series(spark, sf), "trial", "x1", [7, 31], skip=20)
    return out.select("trial", "width", "win", F.round("mean", 3).alias("mean"),
                      F.round("std", 3).alias("std"))


@query("agg15_series_integral", f"""
WITH {SERIES}
SELECT trial, round(sum(x0) * 0.125, 4) AS integral, count(*) AS n,
       round(exp(-0.5 * pow((sum(x0) * 0.125 - 25.5 * count(*) * 0.125) / (5.1 * sqrt(count(*) * 0.125)), 2))
             / (5.1 * sqrt(count(*) * 0.125) * sqrt(2 * pi())), 10) AS density
FROM series GROUP BY trial""")
def _(spark, sf):
    out = S.integral(series(spark, sf), "trial", "x0", 0.125, mu=25.5, sigma=5.1)
    return out.select("trial", F.round("integral", 4).alias("integral"), "n",
                      F.round("density", 10).alias("density"))


@query("scl1_sigmoid_leak", f"""
WITH {SERIES}
SELECT trial, k, round(1 / (1 + exp(-0.3::DOUBLE * (x0 - 20))), 8) AS rate, -x0 AS leak FROM series""")
def _(spark, sf):
    return series(spark, sf).select(
        "trial", "k", F.round(scalars.sigmoid(F.col("x0"), 0.3, 20.0), 8).alias("rate"),
        scalars.leak(F.col("x0")).alias("leak"))


@query("scl2_isclose", f"""
WITH {SERIES}
SELECT trial, k, abs(x1 - x1 * (1 + x2 / 5000)) <= 1e-8 + 1e-5 * abs(x1 * (1 + x2 / 5000)) AS close
FROM series""")
def _(spark, sf):
    a = F.col("x1")
    return series(spark, sf).select("trial", "k", scalars.isclose(
        a, a * (1 + F.col("x2") / 5000)).alias("close"))


@query("scl4_densities", """
SELECT p_partkey,
  round(exp(-0.5 * pow((p_size - 25) / 10e0, 2)) / (10 * sqrt(2 * pi())), 10) AS normal,
  round(exp(-0.5 * pow((ln(p_size) - 3) / 0.8e0, 2)) / (0.8e0 * sqrt(2 * pi())) / p_size, 10) AS lognormal,
  round(CASE WHEN p_size BETWEEN 15 AND 45 THEN
    exp(-0.5 * pow((p_size - 25) / 10e0, 2)) / (10 * sqrt(2 * pi())) / 0.8185946141203637 ELSE 0 END, 9) AS truncated
FROM part""")
def _(spark, sf):
    x = F.col("p_size").cast("double")
    return table(spark, sf, "part").select(
        "p_partkey", F.round(scalars.normal_pdf(x, 25.0, 10.0), 10).alias("normal"),
        F.round(scalars.lognormal_pdf(x, 3.0, 0.8), 10).alias("lognormal"),
        F.round(scalars.truncated_normal_pdf(x, 25.0, 10.0, 15.0, 45.0), 9).alias("truncated"))


@query("scl6_prior_transforms", """
WITH p AS (SELECT p_partkey, p_size::DOUBLE AS x, (p_size + 1) / 60e0 AS a, 1 / 5e0 AS b FROM part),
q AS (SELECT *, a * (1 - b) AS p1, b AS p0, 1 - b - a * (1 - b) AS p2 FROM p)
SELECT p_partkey, round(ln(x), 9) AS logged, round(ln((x + 1) / (60 - x)), 9) AS logit,
       round(ln(p0 / (1 - p0)) - ln(1 / 2e0), 9) AS stick0,
       round(ln((p1 / (1 - p0)) / (1 - p1 / (1 - p0))), 9) AS stick1,
       round(x, 6) AS back, round(p2, 9) AS last_share
FROM q""")
def _(spark, sf):
    x = F.col("p_size").cast("double")
    share = [F.lit(0.2), (F.col("p_size") + 1) / 60.0 * F.lit(0.8)]
    share.append(1 - share[0] - share[1])
    sticks = scalars.stick_breaking(share)
    back = scalars.from_stick_breaking(sticks)
    logit = scalars.logit_interval(x, -1.0, 60.0)
    return table(spark, sf, "part").select(
        "p_partkey", F.round(F.ln(x), 9).alias("logged"), F.round(logit, 9).alias("logit"),
        F.round(sticks[0], 9).alias("stick0"), F.round(sticks[1], 9).alias("stick1"),
        F.round(scalars.from_logit_interval(logit, -1.0, 60.0), 6).alias("back"),
        F.round(back[2], 9).alias("last_share"))


@query("scl7_batched_rule", """
SELECT p_partkey, p_size + 5 < 30 AS batched FROM part""")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", scalars.is_batched(
        F.col("p_size"), F.lit(5), F.lit(30)).alias("batched"))


UNIFORM = "(('0x' || substr(md5({}), 1, 13))::BIGINT / 4503599627370496e0)"


@query("scl9_counter_rng", f"""
SELECT p_partkey, {UNIFORM.format("'20201115:' || p_size || ':' || p_partkey || ':7'")} AS u,
       CAST(floor({UNIFORM.format("'20201115:' || p_partkey")} * 2147483648) AS BIGINT) AS seed
FROM part""")
def _(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", rng.uniform(F.col("p_size"), F.col("p_partkey"), 7).alias("u"),
        rng.seed(F.col("p_partkey")).alias("seed"))


@query("scl10_random_draws", f"""
WITH u AS (SELECT p_partkey, {UNIFORM.format("'20201115:' || p_partkey || ':a'")} AS a,
           {UNIFORM.format("'20201115:' || p_partkey || ':b'")} AS b,
           {UNIFORM.format("'20201115:' || p_partkey || ':e'")} AS e FROM part)
SELECT p_partkey, round(sqrt(-2 * ln(1 - a)) * cos(2 * pi() * b), 9) AS normal,
       round(exp(1 + 0.5 * (sqrt(-2 * ln(1 - a)) * cos(2 * pi() * b))), 8) AS lognormal,
       round(-ln(1 - e), 9) AS exponential FROM u""")
def _(spark, sf):
    key = F.col("p_partkey")
    return table(spark, sf, "part").select(
        "p_partkey", F.round(rng.normal(key), 9).alias("normal"),
        F.round(rng.lognormal(1.0, 0.5, key), 8).alias("lognormal"),
        F.round(rng.exponential(key, "e"), 9).alias("exponential"))


@query("scl11_json_round_trip", """
SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k, event_type || '=' || user_id AS pair FROM events""")
def _(spark, sf):
    packed = F.to_json(F.map_from_arrays(F.array("event_type"), F.array("user_id")))
    entry = F.map_entries(F.from_json(packed, "map<string,bigint>"))[0]
    return table(spark, sf, "events").select(
        "event_id", F.from_json("props", "k int")["k"].alias("k"),
        F.concat(entry["key"], F.lit("="), entry["value"]).alias("pair"))


@query("scl12_index_enumeration", """
WITH c AS (SELECT vec_id, i - 1 AS flat, embedding[i]::DOUBLE AS value FROM embeddings, range(1, 65) r(i))
SELECT vec_id, (flat // 8)::INTEGER AS "row", (flat % 8)::INTEGER AS col, value FROM c""")
def _(spark, sf):
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, F.lit(8)))
    df = table(spark, sf, "embeddings").select("vec_id", F.posexplode(rows).alias("row", "cells"))
    return df.select("vec_id", "row", F.posexplode("cells").alias("col", "v")).select(
        "vec_id", "row", "col", F.col("v").cast("double").alias("value"))


@query("smp9_memoryless_noise", f"""
WITH {SERIES}, u AS (SELECT trial, k, x2, {UNIFORM.format("'20201115:' || trial || ':' || k || ':a'")} AS a,
   {UNIFORM.format("'20201115:' || trial || ':' || k || ':b'")} AS b FROM series),
z AS (SELECT *, sqrt(-2 * ln(1 - a)) * cos(2 * pi() * b) AS z FROM u)
SELECT trial, k, round(0.5 + 0.2 / sqrt(0.25) * z, 8) AS noise, round(1.5 * x2 + 0.1 * z, 8) AS observed FROM z""")
def _(spark, sf):
    from fitlake.operators.sampling import observation_noise, white_noise_series
    df = white_noise_series(series(spark, sf), mu=0.5, sigma=0.2, dt=0.25)
    return observation_noise(df, "x2", gain=1.5, sigma=0.1).select(
        "trial", "k", F.round("noise", 8).alias("noise"), F.round("observed", 8).alias("observed"))

import numpy as np
import pytest
from pyspark.sql import functions as F

from fitlake.functions import rng
from fitlake.operators import sampling as S


def test_every_start_is_drawn_eventually():
    starts, odds = S.spaced_starts(100, 10, np.random.default_rng(5).random(200))
    assert set(starts) == set(range(91)) and (np.diff(starts) >= 0).all()
    assert (odds >= 0).all() and len(odds) == 91


def test_draws_avoid_each_other():
    gen = np.random.default_rng(1)
    gaps = [np.diff(S.spaced_starts(1000, 20, gen.random(10))[0]).min() for _ in range(50)]
    free = [np.diff(np.sort(gen.integers(0, 981, 10))).min() for _ in range(50)]
    assert np.mean(gaps) > 1.5 * np.mean(free)


def test_bad_sizes_are_refused():
    with pytest.raises(ValueError):
        S.spaced_starts(5, 10, np.array([0.5]))
    with pytest.raises(ValueError):
        S.spaced_starts(2_000_000, 10, np.array([0.5]))


def test_starts_do_not_depend_on_partitions(spark):
    segments = spark.range(40).select(F.col("id").alias("trial"), (F.col("id") + 60).alias("K"))
    a = S.batch_starts(segments.repartition(1), "trial", 12, 6).toPandas()
    b = S.batch_starts(segments.repartition(7), "trial", 12, 6).toPandas()
    order = ["trial", "batch"]
    assert a.sort_values(order).reset_index(drop=True).equals(b.sort_values(order).reset_index(drop=True))
    assert (a.groupby("trial").size() == 6).all() and (a["b"] <= a["trial"] + 48).all()


def test_uniform_and_normal_moments(spark):
    df = spark.range(20000).select(rng.uniform(F.col("id")).alias("u"), rng.normal(F.col("id")).alias("z"))
    pdf = df.toPandas()
    assert abs(pdf["u"].mean() - 0.5) < 0.01 and pdf["u"].between(0, 1, inclusive="left").all()
    assert abs(pdf["z"].mean()) < 0.03 and abs(pdf["z"].std() - 1) < 0.03


def test_poisson_moments(spark):
    k = spark.range(20000).select(S.poisson(3.0, F.col("id")).alias("n")).toPandas()["n"]
    assert abs(k.mean() - 3) < 0.06 and abs(k.var() - 3) < 0.2


def test_trials_are_drawn_evenly_whatever_their_length(spark):
    rows = [(0, k) for k in range(900)] + [(t, 0) for t in range(1, 10)]
    df = spark.createDataFrame(rows, "trial long, k long")
    n = S.draw_trials(df, "trial", 5000).groupBy("trial").count().toPandas()["count"]
    assert n.sum() == 5000 and len(n) == 10 and n.min() > 400 and n.max() < 600


def test_integral_of_noise_is_normal(spark):
    """100 simulations of 200 bins: the integral has mean mu * T and spread sigma * sqrt(T)."""
    df = spark.range(100 * 200).select((F.col("id") % 100).alias("trial"), F.floor(F.col("id") / 100).alias("k"))
    noise = S.white_noise_series(df, mu=0.5, sigma=0.3, dt=0.05)
    sums = noise.groupBy("trial").agg((F.sum("noise") * 0.05).alias("x")).toPandas()["x"]
    assert abs(sums.mean() - 5.0) < 0.3 and 0.7 < sums.std() / (0.3 * 10**0.5) < 1.3


def test_dirichlet_components_sum_to_one(spark):
    priors = spark.createDataFrame([("w", c, "dirichlet", 0.0, 0.0) for c in range(3)],
                                   "param string, comp int, dist string, a double, b double")
    total = S.prior_samples(priors, 50).groupBy("draw").agg(F.sum("value").alias("s")).toPandas()
    np.testing.assert_allclose(total["s"], 1.0)


def test_simulation_keys(spark):
    params = spark.createDataFrame([(0, "a"), (1, "b")], "position long, p string")
    one = spark.createDataFrame([(0, 42)], "position long, seed long")
    assert {r["seed"] for r in S.with_params(params, one).collect()} == {42}
    three = spark.createDataFrame([(i, i) for i in range(3)], "position long, seed long")
    with pytest.raises(Exception, match="position 2"):
        S.with_params(params, three).collect()
    shifted = spark.createDataFrame([(1, 7), (2, 8)], "position long, seed long")
    with pytest.raises(Exception, match="together at position"):
        S.with_params(params, shifted).collect()


def test_large_poisson_rates(spark):
    k = spark.range(4000).select(S.poisson(800.0, F.col("id")).alias("n")).toPandas()["n"]
    assert abs(k.mean() - 800) < 2 and 700 < k.var() < 900


def test_keys_with_separators_and_missing_fields_have_their_own_stream(spark):
    df = spark.createDataFrame([("a:b", "c"), ("a", "b:c"), ("a", None), ("a", "N")], "x string, y string")
    drawn = {r[0] for r in df.select(rng.uniform(F.col("x"), F.col("y"))).collect()}
    assert len(drawn) == 4 and df.limit(1).select(rng.uniform("a", 1) != rng.uniform("a")).first()[0]


def test_initial_and_final_weights(spark):
    segments = spark.createDataFrame([(1, 8, [0.0] * 5 + [1.0])], "trial long, K long, w array<double>")
    rows = S.batch_starts(segments, "trial", 3, 1, weights="w").collect()
    assert rows[0].b == 5 and len(rows[0].weights) == 6 and abs(sum(rows[0].weights) - 1) < 1e-12
    assert rows[0].weights[5] < 1e-3


def test_trials_with_text_keys_and_a_filter(spark):
    df = spark.createDataFrame([(f"s__{i}", i) for i in range(20)], "trial string, n int")
    drawn = {r.trial for r in S.draw_trials(df, "trial", 500, keep=F.col("n") < 7).collect()}
    assert drawn == {f"s__{i}" for i in range(7)}


def test_priors_of_every_kind(spark):
    rows = [("t", 0, "truncnorm", 0.0, 1.0, 0.5, 1.0), ("u", 0, "uniform", 2.0, 3.0, None, None),
            ("e", 0, "exponential", 4.0, 0.0, None, None)]
    priors = spark.createDataFrame(rows, "param string, comp int, dist string, a double, b double, lo double, hi double")
    got = S.prior_samples(priors, 400).toPandas()
    t, u = (got[got.param == p].value for p in "tu")
    assert t.between(0.5, 1.0).all() and t.nunique() > 390 and u.between(2, 3).all() and abs(u.mean() - 2.5) < 0.05
    bad = spark.createDataFrame([("b", 0, "cauchy", 0.0, 1.0)], "param string, comp int, dist string, a double, b double")
    with pytest.raises(Exception, match="unknown distribution cauchy"):
        S.prior_samples(bad, 2).collect()


def test_key_conflicts(spark):
    keys = spark.createDataFrame([([3, 2],), ([3, 2, 1],), ([4],), ([5],), ([5],)], "key array<long>")
    got = {tuple(r["key"]): (r["n"], r["n_below"]) for r in S.key_conflicts(keys, "key").collect()}
    assert got == {(3, 2): (1, 1), (5,): (2, 0)}


def test_a_count_is_drawn_from_one_digest(spark):
    axis = spark.range(3).withColumnRenamed("id", "k")
    plan = S.random_series(axis, ["k"], {"y": ("poisson", 1)})._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan[plan.index("filter("):]  # no step hashes its key anew

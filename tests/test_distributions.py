import numpy as np
import pytest
from pyspark.sql import functions as F

from fitlake.operators import distributions as D


@pytest.fixture(scope="module")
def samples():
    gen = np.random.default_rng(4)
    return {"a": gen.normal(size=3000), "b": gen.exponential(size=500), "c": np.full(20, 3.0),
            "d": gen.integers(0, 5, 800).astype(float)}


@pytest.fixture(scope="module")
def df(spark, samples):
    return spark.createDataFrame([(k, float(v)) for k, x in samples.items() for v in x], "key string, v double")


@pytest.mark.parametrize("rows", ["4000000", "50"])
def test_histograms_equal_numpy(spark, df, samples, rows):
    spark.conf.set("spark.fitlake.chunkRows", rows)
    try:
        got = D.histogram(df, ["key"], "v").toPandas()
    finally:
        spark.conf.unset("spark.fitlake.chunkRows")
    for key in "abc":
        freq, edges = np.histogram(samples[key], bins="auto")
        mine = got[got["key"] == key].set_index("bin")
        assert mine["bins"].iloc[0] == len(freq)
        np.testing.assert_array_equal(mine["freq"].reindex(range(len(freq)), fill_value=0), freq)
        np.testing.assert_allclose(mine["lo"].iloc[0], edges[0])


def test_truncation_drops_thin_tails(df, samples):
    got = D.truncated_histogram(df.where("key = 'a'"), ["key"], "v").toPandas()
    freq, edges = np.histogram(samples["a"], bins="auto")
    lo = edges[np.argmax(np.cumsum(freq) >= 50)]
    hi = edges[len(freq) - np.argmax(np.cumsum(freq[::-1]) >= 50)]
    np.testing.assert_allclose([got["lo"].iloc[0], got["hi"].iloc[0]], [lo, hi])
    inside = samples["a"][(samples["a"] >= lo) & (samples["a"] <= hi)]
    assert got["freq"].sum() == len(inside)


def test_density_integrates_to_one(df):
    got = D.smooth_density(df.where("key = 'a'"), ["key"], "v", 64).orderBy("j").toPandas()
    area = ((got["density"][1:].to_numpy() + got["density"][:-1].to_numpy()) / 2 * np.diff(got["point"])).sum()
    assert area == pytest.approx(1, abs=0.01)


def test_objective_marginal_is_normalised(df):
    scored = df.where("key IN ('a', 'b')").withColumn("logp", -F.col("v") * F.col("v") / 2)
    got = D.objective_marginal(scored, ["key"], "v", "logp").orderBy("bin").toPandas()
    for _, part in got.groupby("key"):
        b, x = part["bin"].to_numpy(), part["center"].to_numpy()
        p = np.zeros(b[-1] + 1)  # empty bins have no row
        p[b] = part["p"]
        width = (x[-1] - x[0]) / (b[-1] - b[0])
        assert (p[1:] + p[:-1]).sum() / 2 * width == pytest.approx(1)


def test_threshold_keeps_all_by_default(df):
    assert D.threshold(df, "v").count() == df.count()


def test_text_differences(spark):
    a, b = "abcdefghij" * 3, list("abcdefghij" * 3)
    b[4], b[6], b[20] = "X", "Y", "Z"
    rows = [(1, a, "".join(b)), (2, a, a), (3, "abc", "abcd"), (4, "", "x")]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    got = D.text_differences(df, "a", "b", ["id"]).orderBy("id", "at").collect()
    assert [(r["id"], r["at"]) for r in got] == [(1, 4), (1, 20)]


def test_a_far_outlier_makes_no_empty_bins(spark):
    df = spark.range(1000).select(F.lit("a").alias("key"), F.when(F.col("id") == 0, 1e12).otherwise(
        F.col("id").cast("double")).alias("v"), F.lit(-1.0).alias("lp"))
    assert D.objective_marginal(df, ["key"], "v", "lp").count() < 1000


def test_few_samples_keep_their_range(spark):
    df = spark.range(40).select(F.lit("a").alias("key"), F.col("id").cast("double").alias("v"))
    assert D.truncated_histogram(df, ["key"], "v").agg(F.sum("freq")).first()[0] == 40


SCORED = [("a", 1, 1.0), ("a", 2, -500.0), ("a", 3, float("nan")), ("a", 4, float("inf")), ("a", 5, None),
          ("a", 6, float("-inf")), ("b", 7, float("nan")), ("c", 8, float("-inf"))]


def test_scores_that_cannot_be_compared(spark):
    df = spark.createDataFrame(SCORED, "key string, id int, z double")
    high = D.high_probability(df, ["key"], "z", F.lit(0.01)).collect()
    assert {(r.key, r.id) for r in high} == {("a", 1)}
    ends = {r.key: (r.argmax_id, r.argmin_id) for r in D.extreme_points(df, ["key"], "z", ["id"], "id").collect()}
    assert ends == {"a": (1, 6), "c": (8, 8)}
    kept = D.discard_lowest(df.where("key = 'a'"), ["key"], "z", ["id"], 0.5, 6, 6).collect()
    assert {r.id for r in kept} == {1, 2, 6}
    ranked = D.at_least_truth(df, "key", "z", F.col("id").isin(2, 7), 3, ["id"]).collect()
    assert {(r.id, r["rank"]) for r in ranked} == {(2, 0), (1, 1)}


def test_priors_with_finite_ends_and_counts(spark):
    rows = [("u", "uniform", 0.0, 2.0, None, None, 1.0), ("w", "uniform", 0.0, 2.0, None, None, 5.0),
            ("c", "poisson", 3.0, None, None, None, 2.0), ("t", "truncnorm", 0.0, 1.0, 0.0, None, 0.5)]
    df = spark.createDataFrame(rows, "p string, dist string, a double, b double, lo double, hi double, v double")
    got = {}
    for r in D.truth_in_prior(df, ["p"], 21).orderBy("p", "j").collect():
        got.setdefault(r.p, []).append((r.x, r.pdf))
    assert got["u"][0] == (0.0, 0.5) and got["u"][-1] == (2.0, 0.5)
    assert got["w"][-1] == (5.25, 0.0)
    assert {x for x, _ in got["c"]} == {float(k) for k in range(7)} and dict(got["c"])[3.0] == pytest.approx(0.22404180765)
    assert got["t"][0] == (0.0, pytest.approx(0.7978845608)) and got["t"][-1][0] == pytest.approx(1.9599639845)


def test_rows_of_few_keys_are_not_shuffled_whole(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(2000).selectExpr("'a' AS key", "double(id % 40) AS v", "-double(id % 7) AS logp").write.parquet(path)
    df = spark.read.parquet(path)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a large table
    try:
        for out in (D.objective_marginal(df, ["key"], "v", "logp"), D.smooth_density(df, ["key"], "v"),
                    D.histogram(df, ["key"], "v")):
            assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_priors_of_a_short_table_unfold_in_several_tasks(spark, monkeypatch):
    from fitlake import session
    monkeypatch.setattr(session, "UNFOLDED_ROWS", 50)
    df = spark.range(20).coalesce(1).selectExpr("id", "'normal' AS dist", "double(id) AS a", "2.0D AS b",
                                                "double(null) AS lo", "double(null) AS hi", "double(id) AS v")
    out = D.truth_in_prior(df, ["id"], 10)
    assert out.rdd.getNumPartitions() == 4 and out.count() == 200

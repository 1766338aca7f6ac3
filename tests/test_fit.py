import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fitlake.functions import objectives as O
from fitlake.operators import fit as T
from fitlake.operators.likelihood import with_neighbours
from fitlake.plans.alternate import alternated_fit

DT = 0.25
W = [[0.7, -0.3], [0.2, 0.9]]


@pytest.fixture(scope="module")
def paths():
    """OU paths of two components with known parameters, and mixed observations."""
    gen = np.random.default_rng(7)
    mu, sigma, tau = np.array([1.0, -0.5]), np.array([0.3, 0.2]), np.array([1.0, 2.0])
    out = {}
    for trial in range(3):
        x = np.zeros((400, 2))
        x[0] = mu
        for k in range(1, 400):
            x[k] = x[k - 1] - (x[k - 1] - mu) * DT / tau + sigma * math.sqrt(2 * DT) * gen.normal(size=2)
        out[trial] = (x, x @ np.array(W).T + 0.1 * gen.normal(size=(400, 2)))
    return out


@pytest.fixture(scope="module")
def df(spark, paths):
    rows = [(t, k, *map(float, x[k]), *map(float, y[k])) for t, (x, y) in paths.items() for k in range(400)]
    return spark.createDataFrame(rows, "trial long, k long, x2 double, x3 double, y0 double, y1 double")


def batch_frame(spark):
    return spark.createDataFrame([(t, n, 40 * n + t) for t in range(3) for n in range(8)],
                                 "trial long, batch int, b long")


def sums_of(x, b, size):
    out = []
    for m in range(2):
        lo = max(b, 1)
        v, p = x[lo:b + size, m], x[lo - 1:b + size - 1, m]
        d = v - p
        out.append([len(d), d.sum(), p.sum(), (d * p).sum(), (p * p).sum(), (d * d).sum()])
    return np.array(out)


def test_score_matches_the_objective_column(spark, df, paths):
    theta = [0.9, math.log(0.35), math.log(1.2)]
    near = with_neighbours(df, ["x2"]).where("prev_x2 IS NOT NULL AND trial = 1")
    lp = O.ou([F.col("x2")], [F.col("prev_x2")], [theta[0]], [0.35], [1.2], DT)
    want = near.agg(F.sum(lp)).first()[0]
    score, _ = T.ou_score(np.array(theta), sums_of(paths[1][0], 0, 400)[0], DT)
    assert float(score) == pytest.approx(want, rel=1e-9)


def test_gradient_against_finite_differences(paths):
    theta, s = np.array([0.8, -1.1, 0.2]), sums_of(paths[0][0], 40, 50)[0]
    _, grad = T.ou_score(theta, s, DT)
    for i in range(3):
        e = np.zeros(3)
        e[i] = 1e-6
        slope = (T.ou_score(theta + e, s, DT)[0] - T.ou_score(theta - e, s, DT)[0]) / 2e-6
        assert grad[i] == pytest.approx(float(slope), rel=1e-5)


def test_parameter_pass_equals_a_plain_loop(spark, df, paths):
    near = with_neighbours(df, ["x2", "x3"])
    sums = T.batch_sums(near, batch_frame(spark), "trial", 40, {0: ("x2", "prev_x2"), 1: ("x3", "prev_x3")})
    settings = T.Adam(rate=0.05, clip=5.0)
    got = T.fit_parameters(sums, "trial", [0.0, 0.0, 0.0], 0.1, DT, passes=4, settings=settings).toPandas()
    for trial in range(3):
        for m in range(2):
            theta, mom, var = np.zeros(3), np.zeros(3), np.zeros(3)
            for t in range(32):
                s = sums_of(paths[trial][0], 40 * (t % 8) + trial, 40)[m]
                g = T.ou_score(theta, s, DT)[1] - 0.1 * theta / np.array([1.0, 3.0, 3.0]) ** 2
                g /= max(1.0, np.abs(g).max() / 5.0)
                mom, var = 0.9 * mom + 0.1 * g, 0.999 * var + 0.001 * g**2
                theta = theta + 0.05 * (mom / (1 - 0.9 ** (t + 1))) / (np.sqrt(var / (1 - 0.999 ** (t + 1))) + 1e-8)
            last = got[(got["trial"] == trial) & (got["comp"] == m)].set_index("step").loc[32]
            np.testing.assert_allclose(last[["mu", "log_sigma", "log_tau"]].to_numpy(float), theta, rtol=1e-7)


def test_parameters_are_recovered(spark, df):
    near = with_neighbours(df, ["x2", "x3"])
    sums = T.batch_sums(near, batch_frame(spark), "trial", 40, {0: ("x2", "prev_x2"), 1: ("x3", "prev_x3")})
    fit = T.fit_parameters(sums, "trial", [0.0, 0.0, 0.0], 0.1, DT, passes=60, settings=T.Adam(rate=0.05)).toPandas()
    end = fit[fit["step"] == fit["step"].max()].groupby("comp").mean(numeric_only=True)
    assert abs(math.exp(end["log_sigma"][0]) - 0.3) < 0.05 and abs(math.exp(end["log_sigma"][1]) - 0.2) < 0.05
    assert abs(end["mu"][0] - 1.0) < 0.3
    trace = fit.groupby("step")["mean_logp"].mean()
    assert trace.iloc[-8:].mean() > trace.iloc[:8].mean()


def numpy_gradient(x, y, model, dynamics=True):
    w = np.array(W)
    g = -2 * (x @ w.T - y) @ w
    if dynamics:
        a, c = DT / np.array(model.tau), 1 / (2 * np.array(model.sigma) ** 2 * DT)
        jump = x[1:] - x[:-1] + (x[:-1] - np.array(model.mu)) * a
        g[1:] -= c * jump
        g[:-1] += c * (1 - a) * jump
    return g


@pytest.mark.parametrize("rows", ["1000000", "13"])
def test_latent_passes_equal_numpy(spark, df, paths, rows):
    model = T.LatentModel([1.0, -0.5], [0.3, 0.2], [1.0, 2.0], W, DT)
    spark.conf.set("spark.fitlake.chunkRows", rows)
    try:
        out = T.latent_updates(df, ["trial"], ["x2", "x3"], ["y0", "y1"], model,
                               {"x2": 1e-3, "x3": 2e-3}, T.full_trace_rules(4)).toPandas()
    finally:
        spark.conf.unset("spark.fitlake.chunkRows")
    assert len(out) == 1200
    for trial, (x, y) in paths.items():
        x = x.copy()
        for _ in range(4):
            x = x + np.array([1e-3, 2e-3]) * numpy_gradient(x, y, model)
        got = out[out["trial"] == trial].sort_values("k")[["x2", "x3"]].to_numpy()
        np.testing.assert_allclose(got, x, atol=1e-10)


def test_batches_touch_exactly_their_bins(spark, df, paths):
    model = T.LatentModel([1.0, -0.5], [0.3, 0.2], [1.0, 2.0], W, DT)
    rules = T.batch_rules(F.array(F.lit(20), F.lit(100), F.lit(200)), 3, 30, 10)
    out = T.latent_updates(df, ["trial"], ["x2", "x3"], ["y0", "y1"], model,
                           {"x2": 1e-3, "x3": 1e-3}, rules).toPandas()
    x, y = paths[0][0].copy(), paths[0][1]
    touched = np.zeros(400, bool)
    for lo, hi, dynamics in ((200, 240, False), (100, 130, True), (0, 50, True)):
        x[lo:hi] += 1e-3 * numpy_gradient(x, y, model, dynamics)[lo:hi]
        touched[lo:hi] = True
    got = out[out["trial"] == 0].sort_values("k")[["x2", "x3"]].to_numpy()
    np.testing.assert_allclose(got, x, atol=1e-10)
    assert ((got != paths[0][0]).any(axis=1) == touched).all()


def test_clipped_passes_equal_numpy(spark, df, paths):
    model = T.LatentModel([1.0, -0.5], [0.3, 0.2], [1.0, 2.0], W, DT)
    out = T.clipped_latent_passes(df, ["trial"], ["x2", "x3"], ["y0", "y1"], model,
                                  {"x2": 1e-2, "x3": 1e-2}, 3, clip=0.5, every=2).toPandas()
    x, y = paths[2][0].copy(), paths[2][1]
    for _ in range(3):
        g = numpy_gradient(x, y, model)
        x = x + 1e-2 * g / max(1.0, np.abs(g).max() / 0.5)
    got = out[out["trial"] == 2].sort_values("k")[["x2", "x3"]].to_numpy()
    np.testing.assert_allclose(got, x, atol=1e-10)


def test_degeneracy_removal_keeps_the_mixed_signal(spark):
    gen = np.random.default_rng(2)
    w, latent = gen.normal(size=(2, 4)), gen.normal(size=4)
    weights = spark.createDataFrame([(1, r, m, float(w[r, m])) for r in range(2) for m in range(4)],
                                    "set_id long, row int, comp int, w double")
    comps = spark.createDataFrame([(1, m, 0.1 * m, 0.3 * (m % 3), 0.0) for m in range(4)],
                                  "set_id long, comp int, mu double, log_sigma double, log_tau double")
    nw, nc = T.remove_degeneracies(weights, comps, 4)
    nc = nc.toPandas().sort_values("new_comp")
    new = nw.toPandas().pivot(index="row", columns="new_comp", values="w").to_numpy()
    moved = (latent[nc["comp"]] * nc["factor"]).to_numpy()
    np.testing.assert_allclose(new @ moved, w @ latent)
    np.testing.assert_allclose(np.abs(new.sum(axis=0)), 1.0)
    s = nc["log_sigma"].to_numpy()
    assert s[0] >= s[1] and s[2] >= s[3] and set(nc["comp"][:2]) == {0, 1}


def test_adaptive_search_finds_the_mode(spark, df):
    def lp(p):
        return -(F.col("x2") - p[0]) * (F.col("x2") - p[0]) - (F.col("x3") - p[1]) * (F.col("x3") - p[1])

    mean = df.agg(F.avg("x2"), F.avg("x3")).first()
    found = T.densify(df, ["a", "b"], lp, [0.0, 0.0], [0.5, 0.5], per_round=10, required=15, boundary=1e-12,
                      most_rounds=8, seed=3).toPandas()
    best = found.loc[found.score.idxmax()]
    assert abs(best.a - mean[0]) < 0.15 and abs(best.b - mean[1]) < 0.15
    assert (found.groupby("round").size() == 10).all() and found.high[found.score.idxmax()]
    again = T.densify(df.repartition(5), ["a", "b"], lp, [0.0, 0.0], [0.5, 0.5], per_round=10, required=15,
                      boundary=1e-12, most_rounds=8, seed=3).toPandas()
    order = ["round", "draw"]
    np.testing.assert_allclose(found.sort_values(order)[["a", "score"]], again.sort_values(order)[["a", "score"]])


def test_alternated_fit_improves(spark, df):
    trace, latents = alternated_fit(df, "trial", ["x2", "x3"], ["y0", "y1"], W, DT, [0.0, 0.0, 0.0],
                                    {"x2": 1e-3, "x3": 1e-3}, rounds=3, Kb=40, Nb=12, latent_steps=2,
                                    settings=T.Adam(rate=0.05))
    t = trace.toPandas().groupby("round")["mean_logp"].mean()
    assert t.loc[2] > t.loc[0] and latents.count() == 1200


def test_alternated_fit_with_split_runs(spark, df):
    def fitted():
        trace, latents = alternated_fit(df, "trial", ["x2", "x3"], ["y0", "y1"], W, DT, [0.0, 0.0, 0.0],
                                        {"x2": 1e-3, "x3": 1e-3}, rounds=2, Kb=40, Nb=12, latent_steps=2)
        return (trace.orderBy("round", "trial", "comp", "step").toPandas()[["mean_logp", "mu", "log_tau"]],
                latents.orderBy("trial", "k").toPandas()[["x2", "x3"]])

    whole = fitted()
    spark.conf.set("spark.fitlake.chunkRows", "7")
    try:
        cut = fitted()
    finally:
        spark.conf.unset("spark.fitlake.chunkRows")
    for a, b in zip(whole, cut):
        np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-12)


def test_alternated_fit_makes_its_bins_once(spark, df):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        made.add(1)
        return x

    alternated_fit(df.withColumn("y0", counted("y0")), "trial", ["x2", "x3"], ["y0", "y1"], W, DT, [0.0, 0.0, 0.0],
                   {"x2": 1e-3, "x3": 1e-3}, rounds=2, Kb=40, Nb=12, latent_steps=2)[0].count()
    assert made.value == df.count()


@pytest.mark.parametrize("score", [float("nan"), None, 1.0, float("inf")])
def test_search_without_a_region_ends(spark, score):
    """Scores that are all NaN, null, infinite or equal say nothing: the search ends, and not as converged."""
    df = spark.range(3)
    found = T.densify(df, ["a"], lambda x: F.lit(score).cast("double") + 0.0 * x[0], [0.0], [1.0], per_round=4, required=6)
    rows = found.collect()
    assert len(rows) == 4 * 3 and not any(r.converged for r in rows)


def test_search_with_some_scores_missing(spark):
    """Points on one side have no score; the others are found all the same."""
    df = spark.range(1)
    found = T.densify(df, ["a"], lambda x: F.when(x[0] > 0, -x[0] * x[0]).otherwise(float("nan")), [0.5], [1.0],
                      per_round=12, required=10, boundary=0.05, most_rounds=8)
    rows = found.collect()
    assert all(r.converged for r in rows) and all(r.a > 0 for r in rows if r.high)
    assert sum(r.high for r in rows) >= 10


def test_unfolded_weights_are_never_broadcast(spark):
    from fitlake.queries import fitting
    weights, comps = T.remove_degeneracies(*fitting.mixing(spark, "/root/testdata/sf0.001"), n_comps=4)
    for df in (weights, comps):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_mixed_signals_of_many_sets_are_not_broadcast(spark, monkeypatch):
    from fitlake.queries import QUERIES, load_all
    load_all()
    monkeypatch.setattr(T, "BROADCAST_MOVES", 0)
    plan = QUERIES["fit6_mixed_signal_stays"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan

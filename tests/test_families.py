"""Distributions as expressions, against the standard library and plain sums."""

import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from fitlake.functions import families as D

N = NormalDist()


def evaluated(spark, rows, schema, **columns):
    out = spark.createDataFrame(rows, schema).select("*", *[c.alias(n) for n, c in columns.items()])
    return out.collect()


def close(x, y, rel=1e-12, tiny=1e-300):
    return x == y or abs(x - y) <= rel * max(abs(x), abs(y)) + tiny


def test_error_function_and_normal_quantile(spark):
    xs = [i / 8 for i in range(-80, 220)] + [0.46875, 4.0, -4.0, 0.0, 1e-12]
    for r in evaluated(spark, [(x,) for x in xs], "x double", e=D.erfc(F.col("x"))):
        assert close(r.e, math.erfc(r.x), 2e-13), r
    ps = [10.0 ** -e for e in range(1, 300, 7)] + [i / 64 for i in range(1, 64)] + [1 - 1e-9]
    for r in evaluated(spark, [(p,) for p in ps], "p double", z=D.normal_quantile(F.col("p"))):
        assert close(r.z, N.inv_cdf(r.p), 1e-13) or abs(r.z) < 1e-15
    odd = evaluated(spark, [(0.0,), (1.0,), (-0.1,), (1.1,), (None,)], "p double", z=D.normal_quantile(F.col("p")))
    assert [r.z for r in odd] == [-math.inf, math.inf, None, None, None]


def test_gamma(spark):
    rows = [(s, x) for s in (1.0, 2.0, 9.0, 60.0, 900.0) for x in (0.0, 0.5, 3.0, 40.0, 61.0, 850.0, 1000.0)]
    for r in evaluated(spark, rows, "s double, x double", l=D.lgamma(F.col("s")), q=D.gamma_q(F.col("s"), F.col("x"))):
        assert abs(r.l - math.lgamma(r.s)) <= 1e-12 * max(1, abs(math.lgamma(r.s)))
        n = int(r.s)  # a sum of Poisson probabilities
        want = math.fsum(math.exp(i * math.log(r.x) - r.x - math.lgamma(i + 1)) for i in range(n)) if r.x else 1.0
        assert abs(r.q - want) < 1e-10, (r, want)


CASES = [("normal", 2.0, 3.0, None, None), ("lognormal", 0.5, 0.7, None, None), ("uniform", -1.0, 4.0, None, None),
         ("exponential", 2.5, None, None, None), ("truncnorm", 0.0, 1.0, -1.0, 2.0), ("truncnorm", 5.0, 2.0, None, 4.0),
         ("truncnorm", 0.0, 1.0, 6.0, 9.0), ("truncnorm", 0.0, 1.0, -9.0, -6.0), ("truncnorm", 1.0, 2.0, None, None),
         ("truncnorm", 0.0, 1.0, 40.0, 41.0), ("truncnorm", 0.0, 1.0, -41.0, -40.0), ("truncnorm", 3.0, 0.5, 8.0, None)]
SCHEMA = "dist string, a double, b double, lo double, hi double"


def test_quantile_and_distribution_function_are_inverse(spark):
    ps = [0.001, 0.05, 0.3, 0.5, 0.8, 0.95, 0.999]
    rows = [(*c, p) for c in CASES for p in ps]
    dist = F.col("dist")
    df = spark.createDataFrame(rows, SCHEMA + ", p double").withColumn("x", D.quantile(F.col("p"), dist))
    low, high = D.support(dist)
    for r in df.select("*", D.cdf(F.col("x"), dist).alias("back"), low.alias("low"), high.alias("high")).collect():
        assert abs(r.back - r.p) < (2e-3 if abs(r.lo or 0) >= 40 or r.lo == 8 else 1e-9), r
        assert r.low <= r.x <= r.high


def test_densities_integrate_to_the_distribution_function(spark):
    """Midpoint sums of the density between two quantiles."""
    n = 4000
    df = spark.createDataFrame(CASES, SCHEMA).withColumns({
        "x0": D.quantile(F.lit(0.02), F.col("dist")), "x1": D.quantile(F.lit(0.9), F.col("dist"))})
    grid = df.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(
        "x", F.col("x0") + (F.col("x1") - F.col("x0")) * (F.col("j") + 0.5) / n)
    sums = grid.groupBy(*SCHEMA.replace(" string", "").replace(" double", "").split(", ")).agg(
        (F.sum(F.exp(D.log_density(F.col("x"), F.col("dist")))) * F.max((F.col("x1") - F.col("x0")) / n)).alias("s"))
    for r in sums.collect():
        assert abs(r.s - 0.88) < (3e-3 if abs(r.lo or 0) >= 8 else 1e-5), r


def test_counts(spark):
    for rate in (0.05, 0.7, 3.0, 25.0, 4000.0):
        ps = [1e-6, 0.05, 0.3, 0.5, 0.9, 0.95, 0.9999]
        got = evaluated(spark, [(p, rate) for p in ps], "p double, a double",
                        k=D.quantile(F.col("p"), F.lit("poisson"), b=None, lo=None, hi=None))
        total, k, probabilities = 0.0, 0, []
        while total < 0.99995:
            total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
            probabilities.append(total)
            k += 1
        assert [r.k for r in got] == [next(i for i, t in enumerate(probabilities) if t >= p) for p in ps], rate
    odd = evaluated(spark, [(-1.0,), (2.5,), (2.0,), (None,)], "x double",
                    l=D.log_density(F.col("x"), F.lit("poisson"), F.lit(3.0), None, None, None))
    assert [odd[0].l, odd[1].l, odd[3].l] == [-math.inf, -math.inf, None]
    assert odd[2].l == pytest.approx(math.log(9 / 2) - 3)


def test_outside_of_the_support(spark):
    rows = [("uniform", 0.0, 1.0, None, None, 2.0), ("lognormal", 0.0, 1.0, None, None, -1.0),
            ("exponential", 1.0, None, None, None, -1.0), ("truncnorm", 0.0, 1.0, 0.0, 1.0, 3.0),
            ("constant", 5.0, None, None, None, 4.0)]
    for r in evaluated(spark, rows, SCHEMA + ", x double", l=D.log_density(F.col("x"), F.col("dist"))):
        assert r.l == -math.inf
    with pytest.raises(Exception, match="unknown distribution cauchy"):
        evaluated(spark, [("cauchy", 0.0, 1.0, None, None, 0.0)], SCHEMA + ", x double",
                  l=D.log_density(F.col("x"), F.col("dist")))

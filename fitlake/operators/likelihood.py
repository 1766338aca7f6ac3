"""Scores of series: sums of pointwise log-likelihoods over segments, prefixes and batches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitlake.functions import families
from fitlake.operators.ordered import frames, running


def with_neighbours(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("trial",),
                    before: bool = True, after: bool = False) -> DataFrame:
    """Add ``prev_x`` and ``next_x`` from the bin before and after."""
    made = {}
    for c in columns:
        if before:
            made[f"prev_{c}"] = lambda w, c=c: F.lag(c).over(w)
        if after:
            made[f"next_{c}"] = lambda w, c=c: F.lead(c).over(w)
    return frames(df, keys, "k", made, before=int(before), after=int(after))


def segment_scores(df: DataFrame, keys: Sequence[str], terms: Mapping[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in terms.items()])


def mean_score(df: DataFrame, keys: Sequence[str], lp: Column, k0: int, K: int,
               prior: DataFrame | None = None) -> DataFrame:
    """Log-likelihood per time point of the K bins from ``k0`` on.

    ``prior`` (keys, log_prior, n_bins) adds the share of the log prior that these bins have among all
    ``n_bins`` of the series; keys without a prior drop out.
    """
    part = df.where((F.col("k") >= k0) & (F.col("k") < k0 + K))
    sums = part.groupBy(*keys).agg(F.sum(lp).alias("_lp"))
    if prior is None:
        return sums.select(*keys, (F.col("_lp") / K).alias("mean_logp"))
    share = F.col("log_prior") * K / F.col("n_bins")
    return sums.join(prior, list(keys)).select(*keys, ((F.col("_lp") + share) / K).alias("mean_logp"))


def log_prior(values: DataFrame, priors: DataFrame, keys: Sequence[str], on: Sequence[str] = ("param",)) -> DataFrame:
    """Log prior of each set: the log densities of its ``value`` under the priors of ``on`` (dist, a, b, lo, hi), summed.

    Any distribution of ``functions.families``. Values outside a support give minus infinity, null values a null sum;
    values without a prior do not count.
    """
    found = values.join(priors, list(on)).withColumn("_lp", families.log_density(
        F.col("value"), F.col("dist"), names=families.used(priors)))
    missing = F.max(F.col("_lp").isNull())
    return found.groupBy(*keys).agg(F.when(~missing, F.sum("_lp")).alias("log_prior"), F.count("*").alias("n_params"))


def partial_scores(df: DataFrame, key: str, lp: Column, starts: Sequence[int],
                   lengths: Sequence[int]) -> DataFrame:
    """Mean log-likelihood of several windows at once, in one partial aggregation."""
    pairs = list(zip(starts, lengths))
    inside = [F.sum(F.when((F.col("k") >= b) & (F.col("k") < b + n), lp)) / n for b, n in pairs]
    found = df.groupBy(key).agg(*[c.alias(f"_s{i}") for i, c in enumerate(inside)])
    cells = F.array(*[F.struct(F.lit(b).alias("start"), F.lit(n).alias("length"),
                               F.col(f"_s{i}").alias("mean_logp"))
                      for i, (b, n) in enumerate(pairs)])
    return found.select(key, F.inline(cells))


def prefix_scores(df: DataFrame, keys: Sequence[str], lp: Column) -> DataFrame:
    """Log-likelihood of every prefix of a series."""
    return running(df, keys, "k", {"logp": (lp, "sum")})


def better_than_truth(df: DataFrame, key: str, truth: Column, candidates: Sequence[Column],
                      grid: Sequence[int], as_coded: bool = False) -> DataFrame:
    """Per prefix length, how many candidate parameter sets score above the true one.

    Bins are summed between successive lengths first; the prefix sums then run over that short
    table. The whole length of a series is always the last prefix; longer ones are left out.
    ``as_coded`` divides the candidates by the full length instead of the prefix.
    """
    grid = sorted(grid)
    slot = F.size(F.filter(F.array(*[F.lit(g) for g in grid]), lambda g: g <= F.col("k")))
    sums = (df.groupBy(key, slot.alias("slot"))
            .agg(F.sum(truth).alias("_t"), *[F.sum(c).alias(f"_c{i}")
                                             for i, c in enumerate(candidates)]))
    w = Window.partitionBy(key).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    K = F.least(F.get(F.array(*[F.lit(g).cast("long") for g in grid]), F.col("slot")), F.col("_n"))
    lengths = df.groupBy(key).agg(F.count("*").alias("_n"))
    share = F.col("_n") if as_coded else K
    better = [(F.sum(f"_c{i}").over(w) / share > F.sum("_t").over(w) / K).cast("int")
              for i in range(len(candidates))]
    total = better[0]
    for b in better[1:]:
        total = total + b
    return sums.join(lengths, key).select(key, K.alias("K"), total.alias("n_better"))


def objective_terms(df: DataFrame, key: str, terms: Mapping[str, Column]) -> DataFrame:
    """Sum of each term per key, and the total of all terms."""
    cells = F.array(*[F.struct(F.lit(n).alias("term"), c.alias("value")) for n, c in terms.items()])
    rolled = (df.select(key, F.inline(cells)).rollup(key, "term")
              .agg(F.sum("value").alias("value"), F.grouping_id().alias("_g")))
    return rolled.where("_g < 3").select(
        key, F.when(F.col("_g") == 1, "total").otherwise(F.col("term")).alias("term"), "value")


def stationary(df: DataFrame, value: str, k0: int, keys: Sequence[str]) -> DataFrame:
    """Empirical mean and standard deviation after the transient."""
    return df.where(F.col("k") >= k0).groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def stationary_beside(df: DataFrame, value: str, k0: int, keys: Sequence[str], params: DataFrame, model: Column,
                      dt: float) -> DataFrame:
    """Empirical mean and standard deviation after the transient, beside the analytic ones of the keys' parameters."""
    found = stationary(df, value, k0, keys)
    known = analytic_stationary(params, model, dt).select(*keys, "stat_mean", "stat_std")
    return found.join(known, list(keys)).withColumns({
        "mean_error": F.col("mean") - F.col("stat_mean"), "std_ratio": F.col("std") / F.col("stat_std")})


# Stationary mean and standard deviation of the three processes.
STATIONARY = {
    "white noise": lambda mu, sigma, tau, dt: (mu, sigma / F.sqrt(dt)),
    "OU": lambda mu, sigma, tau, dt: (mu, sigma * F.sqrt(tau)),
    "OU finite noise": lambda mu, sigma, tau, dt: (mu, sigma),
}


def analytic_stationary(params: DataFrame, model: Column, dt: float) -> DataFrame:
    mu, sigma, tau = F.col("mu"), F.exp("log_sigma"), F.exp("log_tau")
    mean, std = F.lit(None).cast("double"), F.lit(None).cast("double")
    for name, make in STATIONARY.items():
        m, s = make(mu, sigma, tau, F.lit(dt))
        mean, std = F.when(model == name, m).otherwise(mean), F.when(model == name, s).otherwise(std)
    return params.withColumns({"stat_mean": mean, "stat_std": std})

"""Drawing trials, segments, batches and prior samples reproducibly."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from fitlake.functions import families, rng
from fitlake.operators.ordered import number


def white_noise_series(df: DataFrame, mu: float, sigma: float, dt: float) -> DataFrame:
    z = rng.normal(F.col("trial"), F.col("k"))
    return df.withColumn("noise", F.lit(mu) + sigma / dt**0.5 * z)


def observation_noise(df: DataFrame, column: str, gain: float, sigma: float) -> DataFrame:
    z = rng.normal(F.col("trial"), F.col("k"))
    return df.withColumn("observed", gain * F.col(column) + sigma * z)


def draw_trials(trials: DataFrame, key: str, n: int, stream: int | str = 0,
                keep: Column | None = None) -> DataFrame:
    """``n`` draws with equal probability per trial that passes ``keep``, whatever its length.

    Each draw hashes to a position among the numbered trials; draws and trials meet by that
    position, so neither side is collected. Numbers are placed in their order, texts by a hash.
    """
    listed = (trials if keep is None else trials.where(keep)).select(key).distinct()
    total = listed.count()
    numeric = isinstance(listed.schema[key].dataType, NumericType)
    by = F.col(key) if numeric else F.crc32(F.col(key).cast("string").cast("binary"))
    placed = number(listed.withColumns({"_all": F.lit(0), "_by": by}), ["_all"], ["_by", key],
                    name="position", start=0).drop("_all", "_by")
    draws = trials.sparkSession.range(n).withColumnRenamed("id", "draw").withColumn(
        "position", F.floor(rng.uniform(stream, F.col("draw")) * total))
    return draws.join(placed, "position").drop("position")


def random_series(axis: DataFrame, keys: Sequence[str], variables: Mapping[str, tuple],
                  seed: int = 0) -> DataFrame:
    """Independent draws at every point of a grid: per variable a distribution, a number of
    components and, for Poisson counts, a rate (1 if left out)."""
    draws, cells = {}, []
    for name, (dist, size, *rate) in variables.items():
        for i in range(size):
            key = (seed, name, i, *[F.col(k) for k in keys])
            drawn = f"_draw{len(cells)}"
            draws[drawn] = _draw(dist, key, *rate)
            cells.append(F.struct(F.lit(name).alias("name"), F.lit(i).alias("idx"), F.col(drawn).alias("value")))
    # draws are columns of their own, as a generator computes what they share anew for each
    return axis.select(*keys).withColumns(draws).select(*keys, F.inline(F.array(*cells)))


def _draw(dist: str, key: Sequence, rate: float = 1.0) -> Column:
    if dist == "normal":
        return rng.normal(*key)
    if dist == "lognormal":
        return rng.lognormal(0.0, 1.0, *key)
    if dist == "exponential":
        return rng.exponential(*key)
    if dist == "uniform":
        return rng.uniform(*key)
    if dist == "poisson":
        return poisson(rate, *key)
    raise ValueError(f"unknown distribution {dist!r}")


def poisson(rate: float, *key: Column | int | str) -> Column:
    """Poisson draw by inverting the distribution function.

    Counts of independent parts add up, so a large rate is drawn as the sum of parts of rate 8 at
    most. The steps of a part end where they no longer differ from one.
    """
    if not rate > 0:
        raise ValueError(f"rate {rate} is not positive")
    parts = math.ceil(rate / 8)
    steps, p, total, i = [], math.exp(-rate / parts), 0.0, 0
    while total + p > total:
        total += p
        steps.append(total)
        i += 1
        p *= rate / parts / i
    table = F.array(*[F.lit(s) for s in steps])

    def part(u: Column) -> Column:
        # drawn once, not for every step
        return families.let(lambda v: F.size(F.filter(table, lambda s: s <= v)), u).cast("double")

    if parts == 1:
        return part(rng.uniform(*key))
    return F.aggregate(F.sequence(F.lit(1), F.lit(parts)), F.lit(0.0),
                       lambda acc, i: acc + part(rng.uniform(*key, i)))


def spaced_starts(bins: int, width: int, uniforms: np.ndarray, least: float = 1e-6,
                  weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts of batches of ``width`` bins, one per uniform number, sorted; and the final weights.

    With w the weights of the places 0 to bins - width (equal at first, or given), a draw takes
    place j with probability least + (1 - n * least) * w[j] / sum(w) for n places. It then
    multiplies the probability of each place at a distance d below ``width`` by
    1 - exp(-d**2 / (2 * s**2)), s = width / 2.
    """
    if width > bins:
        raise ValueError(f"batch of {width} bins does not fit in {bins} bins")
    if bins * least >= 1:
        raise ValueError(f"floor {least} is too high for {bins} bins")
    places = np.arange(bins - width + 1)
    w = np.ones(len(places)) if weights is None else np.asarray(weights, dtype=float)
    chosen = []
    for u in uniforms:
        share = least + (1 - len(places) * least) * w / w.sum()
        start = min(int(np.searchsorted(np.cumsum(share), u, side="right")), len(places) - 1)
        chosen.append(start)
        d = np.abs(places - start)
        w = np.where(d < width, share * -np.expm1(-2.0 * (d / width) ** 2), share)
    return np.sort(np.array(chosen, dtype=np.int64)), w / w.sum()


def batch_starts(segments: DataFrame, key: str, Kb: int, Nb: int, p_min: float = 1e-6,
                 stream: int = 0, weights: str | None = None) -> DataFrame:
    """Batch starts for each segment ``key, K``: one row in, ``Nb`` rows out.

    The draws of one segment depend on each other, segments do not. A segment has fewer than
    ``1 / p_min`` bins, which bounds its weights; no segment data reaches the function. ``weights``
    names a column of initial weights; the final ones then come along as ``weights``, on every row.
    """
    kind = segments.schema[key].dataType.simpleString()
    # few bytes but much work per segment: a fixed number of tasks, not one sized by bytes
    tasks = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    draws = F.array(*[rng.uniform(stream, F.col(key), i) for i in range(Nb)])
    given = F.lit(None).cast("array<double>") if weights is None else F.col(weights)
    seeded = segments.select(key, "K", draws.alias("draws"), given.alias("given")).repartition(
        tasks, key)

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            drawn = [spaced_starts(int(K), Kb, u, p_min, w)
                     for K, u, w in zip(frame["K"], frame["draws"], frame["given"])]
            out = pd.DataFrame({key: np.repeat(frame[key].to_numpy(), Nb),
                                "batch": np.tile(np.arange(Nb), len(frame)),
                                "b": np.concatenate([s for s, _ in drawn]) if drawn else []})
            if weights is not None:
                out["weights"] = [w for _, w in drawn for _ in range(Nb)]
            yield out

    return seeded.mapInPandas(draw, f"{key} {kind}, batch int, b long"
                              + (", weights array<double>" if weights else ""))


def with_params(params: DataFrame, sims: DataFrame, position: str = "position") -> DataFrame:
    """Synthetic trials: parameter sets and simulation keys paired by position.

    A single simulation key is used for every set. Otherwise each position must be there on both
    sides; one that is not is an error when the trials are read.
    """
    few = sims.limit(2).collect()
    if len(few) == 1:
        only = few[0].asDict()
        return params.withColumns({k: F.lit(v) for k, v in only.items() if k != position})
    left = params.withColumn("_set", F.lit(True))
    right = sims.withColumn("_key", F.lit(True))
    message = F.concat(F.lit("no parameter set and simulation key together at position "),
                       F.col(position).cast("string"))
    whole = F.col("_set").isNotNull() & F.col("_key").isNotNull()
    paired = left.join(right, position, "full").withColumn(
        position, F.when(whole, F.col(position)).otherwise(
            F.raise_error(message).cast(params.schema[position].dataType)))
    return paired.drop("_set", "_key")


def prior_samples(priors: DataFrame, n: int, stream: int | str = 0) -> DataFrame:
    """``n`` draws of each prior component, in model space and in optimisation space.

    ``priors`` has one row per (param, comp) with dist, a, b. A Dirichlet(1) component is an
    exponential divided by the sum over the components of its parameter and draw. ``truncnorm`` is a
    normal between the columns ``lo`` and ``hi``, drawn by its quantile function; ``uniform`` runs from a to b,
    ``exponential`` has the scale a. Any other distribution is an error when it is read.
    """
    rows = priors.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    key = (stream, F.col("param"), F.col("comp"), F.col("draw"))
    normal = F.col("a") + F.col("b") * rng.normal(*key)
    raw = (F.when(F.col("dist") == "normal", normal)
           .when(F.col("dist") == "lognormal", F.exp(normal))
           .when(F.col("dist") == "dirichlet", rng.exponential(*key))
           .when(F.col("dist") == "constant", F.col("a"))
           .when(F.col("dist") == "uniform", F.col("a") + (F.col("b") - F.col("a")) * rng.uniform(*key))
           .when(F.col("dist") == "exponential", F.col("a") * rng.exponential(*key)))
    if {"lo", "hi"} <= set(priors.columns):
        raw = raw.when(F.col("dist") == "truncnorm", families.quantile(
            rng.uniform(*key), F.lit("truncnorm"), names=["truncnorm"]))
    raw = raw.otherwise(F.raise_error(F.concat(F.lit("unknown distribution "), F.col("dist"))).cast("double"))
    drawn = rows.withColumn("value", raw)
    shares = (drawn.where("dist = 'dirichlet'").groupBy("param", "draw")
              .agg(F.sum("value").alias("_sum")))
    value = F.when(F.col("dist") == "dirichlet", F.col("value") / F.col("_sum")).otherwise(
        F.col("value"))
    optim = F.when(F.col("dist") == "lognormal", F.ln(F.col("value"))).otherwise(F.col("value"))
    return (drawn.join(shares, ["param", "draw"], "left").withColumn("value", value)
            .withColumn("optim_value", optim).drop("_sum"))


def key_conflicts(keys: DataFrame, key: str) -> DataFrame:
    """Random-stream keys used twice, and keys that are an ancestor of a used key.

    Every key names its own ancestors, which are then looked up by equality.
    """
    counted = keys.groupBy(key).agg(F.count("*").alias("n"))
    n = F.size(key)
    ancestors = counted.where(n > 1).select(F.explode(F.transform(
        F.sequence(F.lit(1), n - 1), lambda i: F.slice(F.col(key), F.lit(1), i))).alias(key)
    ).groupBy(key).agg(F.count("*").alias("n_below"))
    return counted.join(ancestors, key, "left").where("n > 1 OR n_below IS NOT NULL").select(
        key, "n", F.coalesce("n_below", F.lit(0).cast("long")).alias("n_below"))

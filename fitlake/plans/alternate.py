"""Alternated fit: parameters from batches, then latents from the parameters, in turns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitlake.operators.fit import (
    Adam, LatentModel, batch_sums, fit_parameters, full_trace_rules, latent_updates,
)
from fitlake.operators.likelihood import with_neighbours
from fitlake.operators.sampling import batch_starts
from fitlake.session import checkpoint_dir, written

PARAMS = ("mu", "log_sigma", "log_tau")


def alternated_fit(
    df: DataFrame, key: str, latents: Sequence[str], seen: Sequence[str],
    weights: Sequence[Sequence[float]], dt: float, start: Sequence[float], rate: Mapping[str, float],
    rounds: int, Kb: int, Nb: int, latent_steps: int, settings: Adam = Adam(),
) -> tuple[DataFrame, DataFrame]:
    """Fit all runs at once; returns the parameter trace and the fitted latents.

    A round is two jobs whatever the number of runs: the batch sums with the parameter updates,
    and the latent updates. The bins and the state after a round go to the shared checkpoint folder, so
    the bins are made once and a lost executor costs at most one round. They are stored with the latents of
    the bin before, which a round takes from its own sort.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    columns = df.columns
    df = written(with_neighbours(df, latents, [key]), "bins")
    segments = df.groupBy(key).agg(F.count("*").alias("K")).checkpoint()
    longest = segments.agg(F.max("K")).first()[0]
    theta = None
    trace: list[DataFrame] = []
    for r in range(rounds):
        batches = batch_starts(segments, key, Kb, Nb, stream=r)
        pairs = {m: (c, f"prev_{c}") for m, c in enumerate(latents)}
        sums = batch_sums(df, batches, key, Kb, pairs).join(segments, key)
        first: Sequence = start
        if theta is not None:
            sums = sums.join(theta, [key, "comp"])
            first = [F.col(f"_last_{p}") for p in PARAMS]
        moved = fit_parameters(sums, key, first, Kb / F.col("K"), dt, settings=settings).withColumn(
            "round", F.lit(r)).checkpoint()
        trace.append(moved)
        last = moved.groupBy(key, "comp").agg(F.max_by(F.struct(*PARAMS), "step").alias("t"))
        theta = last.select(key, "comp", *[F.col(f"t.{p}").alias(f"_last_{p}") for p in PARAMS])
        wide = last.groupBy(key).agg(*[
            F.max(F.when(F.col("comp") == m, F.col(f"t.{p}"))).alias(f"_{p}_{m}")
            for m in range(len(latents)) for p in PARAMS])
        comps = range(len(latents))
        model = LatentModel([F.col(f"_mu_{m}") for m in comps],
                            [F.exp(f"_log_sigma_{m}") for m in comps],
                            [F.exp(f"_log_tau_{m}") for m in comps], weights, dt)
        more = r + 1 < rounds  # the last latents need no neighbours
        df = latent_updates(df.join(wide, key), [key], latents, seen, model, rate, full_trace_rules(latent_steps),
                            before=more, longest=longest)
        df = written(df.select(*columns, *[f"prev_{c}" for c in latents if more]), "bins")
    return reduce(DataFrame.unionByName, trace), df.select(*columns)

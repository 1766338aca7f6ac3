"""From the catalogue to batch scores: draw trials, cut segments, draw batches, score them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitlake.operators.sampling import batch_starts, draw_trials
from fitlake.operators.series import batch_rows, slices


def score_batches(series: DataFrame, objective: Column, n_segments: int, start: int, length: int,
                  Kb: int, Nb: int, stream: str = "score") -> DataFrame:
    """Mean objective of every batch of ``n_segments`` drawn segments, as one lazy plan."""
    draws = draw_trials(series, "trial", n_segments, stream).withColumns(
        {"start": F.lit(start), "stop": F.lit(start + length - 1)})
    cut = slices(series, draws, "trial", "k", "start", "stop", width=max(length, 1)).withColumn(
        "k", F.col("k") - start)
    segments = cut.groupBy("draw").agg(F.count("*").alias("K")).where(F.col("K") >= Kb)
    batches = batch_starts(segments, "draw", Kb, Nb)
    return batch_rows(cut, batches, "draw", Kb).groupBy("draw", "trial", "batch", "b").agg(
        (F.sum(objective) / Kb).alias("score"), F.count("*").alias("n_bins"))

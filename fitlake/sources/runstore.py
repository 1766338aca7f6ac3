"""Scans over the table of recorded runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The outputs a run must have to be analysed.
REQUIRED_OUTPUTS = ["log L", "Θ", "latents"]


def scan(
    runs: DataFrame, tags: Sequence[str] = (), after: str | None = None, before: str | None = None,
    on: str | None = None, reason: str | None = None, label: str | None = None,
    where: Column | None = None,
) -> DataFrame:
    """Runs with all ``tags``, from ``after`` on, earlier than ``before``, and so on."""
    kind = runs.schema["ts"].dataType  # literals take the stored type, so filters reach the scan
    for tag in tags:
        runs = runs.where(F.array_contains("tags", tag))
    if after:
        runs = runs.where(F.col("ts") >= F.lit(after).cast(kind))
    if before:
        runs = runs.where(F.col("ts") < F.lit(before).cast(kind))
    if on:
        day = F.lit(on).cast(kind)
        runs = runs.where((F.col("ts") >= day) & (F.col("ts") < day + F.expr("INTERVAL 1 DAY")))
    if reason:
        runs = runs.where(F.contains("reason", F.lit(reason)))
    if label:
        runs = runs.where(F.contains("label", F.lit(label)))
    return runs if where is None else runs.where(where)


def required_outputs(runs: DataFrame) -> DataFrame:
    """Flag runs that have every required output; the others are skipped with a warning."""
    have = F.concat_ws("\n", "outputs")
    complete = F.forall(F.array(*[F.lit(n) for n in REQUIRED_OUTPUTS]),
                        lambda name: F.contains(have, name))
    return runs.withColumn("complete", complete)

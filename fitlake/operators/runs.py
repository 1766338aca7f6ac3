"""Result tables and comparisons over ensembles of fit runs."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitlake.functions import labels
from fitlake.operators.ordered import number, order_statistics

# Marker of a run that must not be shown, and of a checked but constant field.
FAILED_MARK = "<OptimizerStatus.Failed>"
NO_DIFF = "(No diff)"


def trace_summary(traces: DataFrame) -> DataFrame:
    """One row per run; NaN values are reported apart and left out of the maximum."""
    finite = F.when(~F.isnan("logl"), F.col("logl"))
    return traces.groupBy("run").agg(
        F.max(finite).alias("max_logl"),
        F.max_by("logl", "step").alias("last_logl"),
        F.bool_or(F.isnan("logl")).alias("has_nan"),
        F.count("*").alias("n_steps"),
        F.max("step").alias("last_step"))


def run_results(runs: DataFrame, traces: DataFrame) -> DataFrame:
    found = trace_summary(traces)
    return runs.join(found, "run").select(
        "run", "split", "lam", "init_key",
        F.round("max_logl", 2).alias("max_logl"), F.round("last_logl", 2).alias("last_logl"),
        "has_nan", labels.outcome_class(F.col("outcome")).alias("outcome"),
        labels.first_line(F.col("reason")).alias("reason"),
        labels.duration_text(F.col("duration_s")).alias("duration"), "n_steps", "last_step",
    ).orderBy(F.desc("max_logl"), "run")


def without_failed(runs: DataFrame) -> DataFrame:
    return runs.where(F.coalesce(~F.col("outcome").contains(FAILED_MARK), F.lit(True)))


def varying(df: DataFrame, fields: Sequence[str]) -> list[str]:
    """Fields with more than one distinct value; one small aggregate row reaches the driver."""
    ends = df.agg(*[F.min(F.col(f).cast("string")).alias(f"lo_{f}") for f in fields],
                  *[F.max(F.col(f).cast("string")).alias(f"hi_{f}") for f in fields],
                  *[F.bool_or(F.col(f).isNull()).alias(f"null_{f}") for f in fields]).first()
    return [f for f in fields if ends[f"lo_{f}"] is not None
            and (ends[f"lo_{f}"] != ends[f"hi_{f}"] or ends[f"null_{f}"])]


def split_by(runs: DataFrame, fields: Sequence[str], drop_unused: bool = True) -> DataFrame:
    """Label each run with the fields that tell runs apart."""
    kept = varying(runs, fields) if drop_unused else list(fields)
    return runs.withColumns({
        "split_fields": F.lit(",".join(kept)),
        "split_label": labels.field_label({f: F.col(f) for f in kept})})


def counts(runs: DataFrame, by: str) -> DataFrame:
    return runs.groupBy(by).agg(F.count("*").alias("n_records"))


def run_counts(
    runs: DataFrame, lam: str, split: str, splits: Sequence[str], fields: Sequence[str],
) -> DataFrame:
    """Runs per hyperparameter set and split, beside the fields in which the sets differ."""
    differ = varying(runs, fields)
    shown = [F.first(f, ignorenulls=True).cast("string").alias(f) if f in differ
             else F.first(F.lit(NO_DIFF)).alias(f) for f in fields]
    cells = [F.count(F.when(F.col(split) == s, 1)).alias(s) for s in splits]
    return runs.groupBy(lam).agg(*shown, *cells)


def used_keys(runs: DataFrame, key: str, split: str, splits: Sequence[str]) -> DataFrame:
    """Which key and split combinations exist, also as a bar of filled and empty boxes."""
    seen = {s: F.bool_or(F.col(split) == s) for s in splits}
    out = runs.groupBy(key).agg(*[e.alias(s) for s, e in seen.items()])
    return out.withColumn("bar", F.concat(*[F.when(F.col(s), "▮").otherwise("▯") for s in splits]))


def set_labels(df: DataFrame, params: Column, seen: str, prefix: str = "Λ") -> DataFrame:
    """Short label per distinct parameter set, numbered in first-seen order.

    Sets are told apart by the whole digest, of which ten digits are shown.
    """
    first = (df.withColumn("_full", labels.digest(params, 64)).groupBy("_full")
             .agg(F.min(seen).alias("first_seen"), F.count("*").alias("n_runs"))
             .withColumn("_all", F.lit(0)))
    ranked = number(first, ["_all"], ["first_seen", "_full"], name="nr", start=1)
    return ranked.select(F.substring("_full", 1, 10).alias("digest"), "first_seen", "n_runs",
                         F.concat(F.lit(prefix), F.col("nr").cast("string")).alias("label"))


def one_run_per_key(runs: DataFrame, traces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keep the run recorded furthest; of equals, the one that came first."""
    last = traces.groupBy("run").agg(F.max("step").alias("stepi"))
    best = F.max_by(F.struct("run", "stepi"), F.struct("stepi", -F.col("run")))
    return (runs.join(last, "run").groupBy(*keys).agg(best.alias("b"), F.count("*").alias("n"))
            .select(*keys, "b.run", "b.stepi", F.col("n").alias("n_candidates")))


def shared_value(df: DataFrame, group: str, value: Column, name: str) -> DataFrame:
    """The value of a group where all members agree, else null."""
    agree = (F.min(value) == F.max(value)) & ~F.bool_or(value.isNull())
    return df.groupBy(group).agg(F.when(agree, F.min(value)).alias(name))


def field_values(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Sorted distinct values per field, one row each."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"))
                      for f in fields])
    return (df.select(F.explode(pairs).alias("p")).select("p.field", "p.value").distinct()
            .orderBy("field", "value"))


def best_per_group(df: DataFrame, group: str, score: str, key: str) -> DataFrame:
    top = F.max_by(F.struct(key, score), F.struct(score, -F.col(key)))
    return df.groupBy(group).agg(top.alias("b")).select(group, f"b.{key}", f"b.{score}")


def accent_weights(df: DataFrame, group: str, score: str) -> DataFrame:
    """Distance to the best of the group and its weight: 1 at the best, 0 from 2 on."""
    finite = F.when(~F.isnan(score) & (F.abs(score) != float("inf")), F.col(score))
    best = df.groupBy(group).agg(F.max(finite).alias("best"))
    gap = F.col("best") - F.col(score)
    return df.join(best, group).withColumn("gap", gap).withColumn(
        "weight", F.when(finite.isNull() | (gap >= 2), 0.0).otherwise(1 - gap / 2))


def clip_limits(df: DataFrame, keys: Sequence[str], value: str, lo: float, hi: float) -> DataFrame:
    """Limits ``sorted[int(q * n)]`` over the finite values, the upper index capped."""
    finite = df.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")))
    return order_statistics(finite, keys, value, {
        "ymin": lambda n: F.floor(n * F.lit(lo)),
        "ymax": lambda n: F.least(F.floor(n * F.lit(hi)), n - 1)})


def add_targets(curves: DataFrame, targets: DataFrame, on: Sequence[str]) -> DataFrame:
    return curves.join(targets, list(on), "left")


def complete_grid(df: DataFrame, row: str, axes: Mapping[str, Sequence], value: str) -> DataFrame:
    """All combinations of the observed rows with the axis values; blank where nothing was seen.

    The axes are lists that the caller declares, unfolded per observed row.
    """
    grid = df.select(row).distinct()
    for axis, values in axes.items():
        grid = grid.withColumn(axis, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid.join(df.select(row, *axes, value), [row, *axes], "left")


def select_frames(
    df: DataFrame, include: Mapping[str, Sequence], exclude: Mapping[str, Sequence],
) -> DataFrame:
    """Rows whose dimensions take the wanted values.

    Unknown dimensions are left out with a warning. Where ``latents`` is a dimension that the caller does
    not name, frames without latents are excluded.
    """
    unknown = sorted({*include, *exclude} - set(df.columns))
    if unknown:
        warnings.warn(f"unknown dimensions left out: {unknown}", stacklevel=2)
    include, exclude = ({n: v for n, v in d.items() if n in df.columns} for d in (include, exclude))
    if "latents" in df.columns and "latents" not in {*include, *exclude}:
        exclude["latents"] = [labels.EMPTY]
    for name, values in include.items():
        df = df.where(F.col(name).isin(list(values)))
    for name, values in exclude.items():
        # a row without the dimension is not one of the excluded, unless null is among them
        listed = F.col(name).isin([v for v in values if v is not None])
        df = df.where(~F.coalesce(listed, F.lit(None in values)))
    return df

"""Thinning, selection and lookup on recorded traces."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitlake.operators.ordered import frames, neighbours, number, running
from fitlake.operators.series import grid_knots
from fitlake.session import written

# Default recording intervals of parameters, log-likelihood and latents.
INTERVALS = {"Θ": 1.1, "log L": 1.05, "latents": 1.65}


def ready(step: Column, interval: float, scaling: str = "log") -> Column:
    """Whether a step is recorded: on every ``interval``-th power, or every n-th step."""
    if scaling == "linear":
        return step % int(interval) == 0
    base = math.log(interval)
    return (step < 2) | (F.floor(F.ln(step) / base) != F.floor(F.ln(step - 1) / base))


def without_repeats(df: DataFrame, keys: Sequence[str], idx: str, what: Sequence[str]) -> DataFrame:
    """Drop a row whose ``what`` equals that of the row recorded just before."""
    mark = F.struct(*what)
    return (frames(df, keys, idx, {"_prev": lambda w: F.lag(mark).over(w)}, before=1)
            .where(F.col("_prev").isNull() | (F.col("_prev") != mark)).drop("_prev"))


def first_at_targets(df: DataFrame, targets: Sequence[int]) -> DataFrame:
    """Per step, the rows where ``b`` first falls to or below a further target."""
    reached = F.size(F.filter(F.array(*[F.lit(t) for t in targets]), lambda t: t >= F.col("b")))
    within = Window.partitionBy("run", "step").orderBy("arrival")
    return (df.where(F.contains("context", F.lit("η"))).withColumn("reached", reached)
            .withColumn("_before", F.coalesce(F.lag("reached").over(within), F.lit(0)))
            .where(F.col("reached") > F.col("_before")).drop("_before"))


def decimate(df: DataFrame, key: str, idx: str, target: int = 200) -> DataFrame:
    """Thin a trace of more than twice ``target`` records to a fixed stride, ends kept."""
    sizes = df.groupBy(key).agg(F.count("*").alias("_n"))
    stride = F.floor(F.col("_n") / target)
    keep = ((F.col("_n") <= 2 * target) | (F.col(idx) % stride == 0)
            | (F.col(idx) == F.col("_n") - 1))
    return df.join(sizes, key).where(keep).drop("_n")


def increments(df: DataFrame, key: str, idx: str, value: str) -> DataFrame:
    return frames(df, [key], idx, {"diff": lambda w: F.col(value) - F.lag(value).over(w)},
                  before=1).where(F.col("diff").isNotNull())


def nearest_step(recorded: DataFrame, asked: DataFrame, key: str = "run",
                 carry: Sequence[str] = ()) -> DataFrame:
    """Recorded step closest to each ``asked`` one; of two equally close ones the earlier.

    Adds to the asked rows ``nearest``, its ``index`` in the trace, ``exact`` and the ``carry``
    columns of the record. One shuffle over both inputs: no range join, no second lookup.
    """
    record = F.struct(F.col("step").alias("at"), *carry)
    extra = [c for c in asked.columns if c not in (key, "asked")]
    both = recorded.select(key, F.col("step").alias("asked"), record.alias("_rec")).unionByName(
        asked.withColumn("_want", F.lit(True)), allowMissingColumns=True)
    near = neighbours(both, [key], "asked", F.col("_rec"), "_prev", "_next", "_seen").where("_want")
    back, ahead = F.col("asked") - F.col("_prev.at"), F.col("_next.at") - F.col("asked")
    take_next = F.col("_prev").isNull() | F.coalesce(ahead < back, F.lit(False))
    pick = F.when(take_next, F.col("_next")).otherwise(F.col("_prev"))
    return (near.withColumn("_pick", pick).where("_pick IS NOT NULL").select(
        key, "asked", *extra, F.col("_pick.at").alias("nearest"),
        F.when(take_next, F.col("_seen")).otherwise(F.col("_seen") - 1).alias("index"),
        (F.col("_pick.at") == F.col("asked")).alias("exact"),
        *[F.col(f"_pick.{c}").alias(c) for c in carry]))


def last_records(asked: DataFrame, streams: Mapping[str, DataFrame], key: str = "run",
                 step: str = "step") -> DataFrame:
    """The state of a fit at the asked steps: of each stream the last record at or before the step.

    ``streams`` maps a name to records (key, step, ...); ``asked`` has the key and the step. All streams are merged with
    the asked steps into one sorted sequence, which is numbered once and carries the last record of every stream along, in
    chunks where a run is long. Records of runs that nothing is asked of stay out of it. Adds a struct per stream (its
    columns but the key); null before its first record.
    """
    names = list(streams)
    runs = asked.select(F.col(key).alias("_run")).distinct()
    same = F.col(key).eqNullSafe(F.col("_run"))  # a null key is a run too
    marks = {n: F.struct(F.col(step).alias(step), *[F.col(c) for c in s.columns if c not in (key, step)])
             for n, s in streams.items()}
    rows = [s.join(runs, same, "left_semi").select(F.col(key), F.col(step), marks[n].alias(n))
            for n, s in streams.items()]
    extra = [c for c in asked.columns if c not in (key, step)]
    rows.append(asked.withColumn("_asked", F.lit(True)))
    merged = rows[0]
    for more in rows[1:]:
        merged = merged.unionByName(more, allowMissingColumns=True)
    # records of a step stand before the steps asked for
    order = [step, F.coalesce("_asked", F.lit(False)), F.xxhash64(*merged.columns)]
    placed = number(merged, [key], order, name="_k", start=0)
    carried = running(placed, [key], "_k", {f"_last_{n}": (F.col(n), "max") for n in names})
    return carried.where("_asked").select(key, step, *extra, *[F.col(f"_last_{n}").alias(n) for n in names])


def rebuild_state(
    latents: DataFrame, params: DataFrame, asked: DataFrame, key: str = "run",
) -> DataFrame:
    """Latent record nearest to the asked step (-1: the last) and parameters nearest to that."""
    last = latents.groupBy(key).agg(F.max("step").alias("_last"))
    want = asked.join(last, key).select(
        key, F.col("asked").alias("request"),
        F.when(F.col("asked") == -1, F.col("_last")).otherwise(F.col("asked")).alias("asked"))
    first = nearest_step(latents, want, key).select(key, "request", F.col("nearest").alias("asked"))
    first = written(first, "latent_steps")  # counted and read; one row per request
    return nearest_step(params, first, key).select(
        key, "request", F.col("asked").alias("latent_step"), F.col("nearest").alias("param_step"),
        (~F.col("exact")).alias("differs"))


def also_recorded(thetas: DataFrame, latents: DataFrame, interval: float) -> DataFrame:
    """Parameter records: the thinned ones and those at every latent record."""
    own = thetas.where(ready(F.col("step"), interval))
    forced = thetas.join(latents.select("run", "step"), ["run", "step"], "left_semi")
    return own.unionByName(forced).distinct()


def select_values(
    long: DataFrame, steps: Sequence[int] | None = None, keys: Sequence[str] | None = None,
    step_range: tuple[int, int] | None = None, index: int | None = None,
) -> DataFrame:
    """Values by key, by step, by both, by a slice of steps, or of one component."""
    if steps is not None:
        long = long.where(F.col("step").isin(list(steps)))
    if step_range is not None:
        long = long.where((F.col("step") >= step_range[0]) & (F.col("step") < step_range[1]))
    if keys is not None:
        long = long.where(F.col("key").isin(list(keys)))
    return long if index is None else long.where(F.col("idx") == index)


def missing_values(long: DataFrame, steps: Sequence[int], keys: Sequence[str]) -> DataFrame:
    """An error row for every asked (step, key) that a run has no record of.

    The asked pairs unfold per run, so only runs and their asked records meet.
    """
    asked = long.select("run").distinct().withColumn("step", F.explode(F.array(*[
        F.lit(s).cast("long") for s in steps]))).withColumn("key", F.explode(F.array(*[F.lit(k) for k in keys])))
    there = select_values(long, steps=steps, keys=keys).select("run", "step", "key").distinct()
    return asked.join(there, ["run", "step", "key"], "left_anti").withColumn("error", F.concat(
        F.lit("no record of "), "key", F.lit(" at step "), F.col("step").cast("string")))


def drop_step(df: DataFrame, step: int) -> DataFrame:
    return df.where(F.col("step") != step)


def windowed_quantile(
    traces: DataFrame, quantile: float = 0.95, window: float | None = None, points: int = 4096,
    key: str = "run", idx: str = "k",
) -> DataFrame:
    """Quantile of each trace resampled on its last ``window`` steps; -inf if not all finite.

    Only the pieces owning a grid point reach the group, so a run contributes at most ``points``
    of them however long it is.
    """
    bad = F.isnan("logl") | (F.abs("logl") == float("inf"))
    broken = traces.groupBy(key).agg(F.bool_or(bad).alias("_bad"))
    pieces = grid_knots(traces, [key], idx, "step", "logl", points, window)
    # a piece is the line level + slope * j over its grid points j0 .. j1
    slope = F.coalesce((F.col("_yb") - F.col("logl")) / (F.col("_xb") - F.col("step")), F.lit(0.0))
    level = F.col("logl") + (F.col("_from") - F.col("step")) * slope
    row = F.array(F.col("_j0").cast("double"), F.col("_j1").cast("double"), level,
                  F.col("_step") * slope)
    q = (pieces.groupBy(key).agg(F.flatten(F.collect_list(row)).alias("_p"))
         .select(key, _grid_quantile(quantile)("_p").alias("_q")))
    return q.join(broken, key).select(
        key, F.when(F.col("_bad"), float("-inf")).otherwise(F.col("_q")).alias("quantile"))


def _grid_quantile(quantile: float) -> Callable[[str], Column]:
    @F.pandas_udf("double")
    def evaluate(pieces: pd.Series) -> pd.Series:
        out = np.empty(len(pieces))
        for i, flat in enumerate(pieces):
            p = np.asarray(flat).reshape(-1, 4)
            j0, j1, level, slope = p[np.argsort(p[:, 0])].T
            times = (j1 - j0 + 1).astype(int)
            values = np.repeat(level, times) + np.repeat(slope, times) * np.arange(times.sum())
            at = (len(values) - 1) * quantile
            lo, hi = int(np.floor(at)), int(np.ceil(at))
            values.partition((lo, hi))
            out[i] = values[lo] + (values[hi] - values[lo]) * (at - lo)
        return pd.Series(out)

    return evaluate

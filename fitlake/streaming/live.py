"""Streaming forms of thinning, convergence, final records, catalogue refresh and statistics."""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fitlake.operators.traces import ready
from fitlake.session import checkpoint_dir


def read_files(spark: SparkSession, folder: str, pattern: str, schema=None,
               per_trigger: int | None = None) -> DataFrame:
    """Stream of the Parquet files of a folder; ``per_trigger`` bounds a micro-batch."""
    if schema is None:
        schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


def work_folder(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def run_to_table(stream: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Process what is available, append it to a table in the shared folder and read that.

    Called again with the same ``folder``, it goes on after the last finished micro-batch.
    """
    spark = stream.sparkSession
    out = folder or work_folder(spark, name)
    query = (stream.writeStream.format("parquet").outputMode("append")
             .option("checkpointLocation", os.path.join(out, "state")).trigger(availableNow=True)
             .start(os.path.join(out, "rows")))
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(os.path.join(out, "rows"))


def thinned(steps: DataFrame, interval: float, time: str, delay: str = "1 hour") -> DataFrame:
    """Steps due for recording; a step delivered twice within ``delay`` is kept once."""
    return (steps.where(ready(F.col("step"), interval)).withWatermark(time, delay)
            .dropDuplicatesWithinWatermark(["run", "step"]))


STATE = "last_step long, seen long, first double, recent array<double>, status int"
CHANGES = "run long, step long, status int"


def live_status(steps: DataFrame, n: int, tol: float, fall: float, silent: int | None = None) -> DataFrame:
    """Status changes per run: constant cost over the last ``n`` values, a change from the first value
    that is not finite, or a fall by more than ``fall`` from it after ten steps.

    State per run is the first value, the last n - 1 values and the status; it goes once a run has
    been silent for ``silent`` milliseconds. A step at or below the last one seen is ignored.
    """

    def update(key: tuple, chunks: Iterator[pd.DataFrame],
               state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, seen, first, recent, status = (
            state.get if state.exists else (-1, 0, float("nan"), [], 0))
        recent = list(recent)
        rows = pd.concat(list(chunks)).sort_values("step")
        changes = []
        for step, value in zip(rows["step"].tolist(), rows["value"].tolist()):
            if step <= last:
                continue
            first = value if seen == 0 else first
            new = 0
            if len(recent) == n - 1 and max(abs(value - v) for v in recent) < tol:
                new = 3
            if not math.isfinite(value - first) or (seen >= 10 and first - value > fall):
                new = -1
            if status | new != status:
                status |= new
                changes.append((key[0], step, status))
            recent = [*recent, value][-(n - 1):]
            last, seen = step, seen + 1
        state.update((last, seen, first, recent, status))
        if silent:
            state.setTimeoutDuration(silent)
        if changes:
            yield pd.DataFrame(changes, columns=["run", "step", "status"])

    return steps.groupBy("run").applyInPandasWithState(
        update, CHANGES, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if silent else GroupStateTimeout.NoTimeout)


#: Milliseconds of event time after which the state of a silent run goes.
DAY = 86_400_000
TEST_STATE = "last_step long, seen long, first double, recent array<double>, status int, ended boolean"


@dataclass(frozen=True)
class LiveTests:
    """The tests of ``operators.convergence`` for streams, each on its own columns; None leaves one out.

    ``diverging`` is (column, maximize, tol), ``cost`` (column, n, tol), ``params`` (columns, n, rtol).
    """

    diverging: tuple[str, bool, float] | None = None
    cost: tuple[str, int, float] | None = None
    params: tuple[Sequence[str], int, float] | None = None

    def columns(self) -> list[str]:
        named = [self.diverging[0]] if self.diverging else []
        named += [self.cost[0]] if self.cost else []
        return list(dict.fromkeys([*named, *(self.params[0] if self.params else [])]))

    def before(self) -> int:
        return max([t[1] for t in (self.cost, self.params) if t], default=1) - 1


def _windows(x: np.ndarray, n: int, new: int) -> np.ndarray:
    """The n records up to each of the last ``new`` ones; NaN where there are fewer."""
    have = x[max(0, len(x) - new - n + 1):]
    padded = np.concatenate([np.full(new + n - 1 - len(have), np.nan), have])
    return np.lib.stride_tricks.sliding_window_view(padded, n)


def _status_of(tests: LiveTests, at: dict[str, int], rows: np.ndarray, k: np.ndarray, first: float) -> dict[str, np.ndarray]:
    """Status of each test at the last ``len(k)`` of the rows (step, values)."""
    new, out = len(k), {}
    if tests.diverging:
        name, maximize, tol = tests.diverging
        change = rows[-new:, at[name]] - first
        worse = -change if maximize else change
        out["div"] = np.where(~np.isfinite(change) | ((k >= 10) & (worse > tol)), -1, 0)
    if tests.cost:
        name, n, tol = tests.cost
        w = _windows(rows[:, at[name]], n, new)
        v, before = w[:, -1], w[:, :-1]
        still = (before.max(axis=1) - v < tol) & (v - before.min(axis=1) < tol) if n > 1 else np.ones(new, bool)
        out["cost"] = np.where((k >= n - 1) & still, 3, 0)
    if tests.params:
        names, n, rtol = tests.params
        steps = _windows(rows[:, 0], n, new)
        x = steps - steps.mean(axis=1, keepdims=True)
        still = k >= n - 1
        for name in names:
            w = _windows(rows[:, at[name]], n, new)
            y = w - w[:, :1]  # a constant stays exactly constant
            slope = (x * (y - y.mean(axis=1, keepdims=True))).sum(axis=1) / (x * x).sum(axis=1)
            step = steps[:, -1]
            now = w[:, 0] + y.mean(axis=1) + slope * x[:, -1]
            still &= (slope == 0) | (np.abs(slope * step) <= rtol * np.abs(now))
        out["par"] = np.where(still, 1, 0)
    return out


def live_tests(steps: DataFrame, tests: LiveTests, stop: bool = True, time: str | None = None, silent: int = DAY) -> DataFrame:
    """Status of each test (``div``, ``cost``, ``par``) at every record, its number ``k``, and ``run_status``, their bitwise
    OR so far: what ``evaluate`` and ``run_status`` give for the whole traces.

    The state of a run is the first cost, as many records as a test looks back, and the status; a micro-batch is tested as
    arrays, without a loop over its rows. With ``stop`` the records after the end of a run (failed or converged) are
    ignored and its state shrinks to that mark. With a column ``time`` (of a watermarked stream) the state goes once the
    watermark is ``silent`` milliseconds past the run's last record. Records at or below the last step are ignored, null
    values count as NaN.
    """
    columns, before = tests.columns(), tests.before()
    shown = [n for n, t in (("div", tests.diverging), ("cost", tests.cost), ("par", tests.params)) if t]
    at = {c: i + 1 for i, c in enumerate(columns)}

    def update(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, seen, first, recent, status, ended = (
            state.get if state.exists else (None, 0, float("nan"), [], 0, False))
        frame = pd.concat(list(chunks)).sort_values("step", kind="stable").drop_duplicates("step")
        frame = frame if last is None else frame[frame["step"] > last]
        out = None
        if len(frame) and not ended:
            new = frame[["step", *columns]].to_numpy(dtype=float)
            rows = np.concatenate([np.array(recent, float).reshape(-1, 1 + len(columns)), new])
            k = seen + np.arange(len(new))
            if not seen and tests.diverging:
                first = float(new[0, at[tests.diverging[0]]])
            found = _status_of(tests, at, rows, k, first)
            merged = np.bitwise_or.reduce([found[n] for n in shown])
            merged[0] |= status
            running = np.bitwise_or.accumulate(merged)
            done = np.flatnonzero((running == -1) | (running & 3 == 3))
            count = len(new)
            if stop and len(done):
                ended, count = True, int(done[0]) + 1
            out = pd.DataFrame({"run": key[0], "step": frame["step"].to_numpy()[:count], "k": k[:count],
                                **{n: found[n][:count] for n in shown}, "run_status": running[:count]})
            recent = [] if ended or not before else rows[-before:].ravel().tolist()
            last, seen, status = int(frame["step"].iloc[-1]), seen + len(new), int(running[count - 1])
        state.update((last, seen, first, recent, status, ended))
        if time:
            at_ms = max(int(pd.to_datetime(frame[time]).max().timestamp() * 1000) if len(frame) else 0,
                        state.getCurrentWatermarkMs())
            state.setTimeoutTimestamp(at_ms + silent)
        if out is not None:
            yield out

    kind = steps.schema["run"].dataType.simpleString()
    given = ", ".join(f"{n} int" for n in [*shown, "run_status"])
    return steps.select("run", "step", *columns, *[time] * bool(time)).groupBy("run").applyInPandasWithState(
        update, f"run {kind}, step long, k long, {given}", TEST_STATE, "append",
        GroupStateTimeout.EventTimeTimeout if time else GroupStateTimeout.NoTimeout)


def merge_catalogue(stream: DataFrame, keys: Sequence[str], name: str, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Catalogue extended by new files, and the rows that were refused because their trial is known already.

    A micro-batch adds the rows of new keys under its own version; a row whose key an earlier version has, or that is not the
    smallest row of its key in the batch, is written to the refused ones with the reason. Each batch reads the keys of earlier
    versions only and overwrites its own folder, so a repeated batch gives the same again; with the same ``folder`` a
    later call goes on where this ended. Null keys are keys.
    """
    spark = stream.sparkSession
    out = folder or work_folder(spark, name)
    rows, refused = os.path.join(out, "rows"), os.path.join(out, "refused")
    names = stream.columns

    def known(version: int) -> DataFrame | None:
        try:
            return spark.read.parquet(rows).where(F.col("version") < version).select(*keys).distinct()
        except AnalysisException:  # the first version
            return None

    def add(batch: DataFrame, version: int) -> None:
        # equal rows are told apart by a count, so that all but one of them are refused
        counted = batch.groupBy(*names).agg(F.count("*").alias("_n"))
        first = counted.groupBy(*keys).agg(F.min(F.struct(*names)).alias("_first"))
        marked = _same(counted, first, keys).withColumn("_is_first", F.struct(*names).eqNullSafe(F.col("_first")))
        earlier = known(version)
        if earlier is None:
            marked = marked.withColumn("_known", F.lit(False))
        else:
            marked = _same(marked, earlier.withColumn("_known", F.lit(True)), keys, "left").withColumn(
                "_known", F.coalesce("_known", F.lit(False)))
        marked.where("_is_first AND NOT _known").select(*names).write.mode("overwrite").parquet(
            f"{rows}/version={version}")
        gone = F.col("_n") - F.when(F.col("_is_first") & ~F.col("_known"), 1).otherwise(0)
        marked.where(gone > 0).select(
            *names, F.when(F.col("_known"), "trial already present").otherwise("trial given twice").alias("reason"),
            gone.cast("long").alias("n_rows")).write.mode("overwrite").parquet(f"{refused}/version={version}")

    query = (stream.writeStream.foreachBatch(add).option("checkpointLocation", os.path.join(out, "state"))
             .trigger(availableNow=True).start())
    query.awaitTermination()

    def read(path: str, schema: str) -> DataFrame:
        try:
            spark.read.parquet(path)
        except AnalysisException:  # nothing has arrived yet
            return spark.createDataFrame([], f"{schema}, version int")
        return spark.read.schema(f"{schema}, version int").parquet(path)

    given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    return read(rows, given), read(refused, f"{given}, reason string, n_rows long")


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys of which null is one."""
    side = right.withColumnsRenamed({k: f"_to_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_to_{k}"))
    return left.join(side, on, how).drop(*[f"_to_{k}" for k in keys])


def last_records(stream: DataFrame, key: str, step: str, name: str, folder: str | None = None) -> DataFrame:
    """Final record of each run: a micro-batch adds its own final records, and reading keeps the last.

    Each batch writes a folder of its own, named by the batch, so a repeated batch writes the same again
    and earlier ones are not touched. With the same ``folder`` a later call goes on where this ended.
    """
    spark = stream.sparkSession
    out = folder or work_folder(spark, name)
    columns = [c for c in stream.columns if c != key]
    last = F.max_by(F.struct(*columns), step).alias("r")

    def add(batch: DataFrame, epoch: int) -> None:
        batch.groupBy(key).agg(last).select(key, "r.*").write.mode("overwrite").parquet(
            os.path.join(out, "rows", f"batch={epoch}"))

    query = (stream.writeStream.foreachBatch(add).option("checkpointLocation", os.path.join(out, "state"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    try:
        rows = spark.read.schema(stream.schema).parquet(os.path.join(out, "rows"))
    except AnalysisException:  # nothing has arrived yet
        rows = spark.createDataFrame([], stream.schema)
    return rows.groupBy(key).agg(last).select(key, "r.*")


def refresh_catalogue(stream: DataFrame, keys: Sequence[str], name: str, folder: str | None = None) -> DataFrame:
    """Catalogue extended by the trials of new files; known trials are left alone.

    The keys seen so far are state of the stream, so a micro-batch reads no earlier one. With the same
    ``folder`` a later call goes on where this ended.
    """
    return run_to_table(stream.dropDuplicates(list(keys)), name, folder)


def tumbling_stats(stream: DataFrame, key: str, value: str, time: str, width: str,
                   delay: str) -> DataFrame:
    """Mean, spread and count per key and tumbling window, once the watermark has passed it."""
    return (stream.withWatermark(time, delay)
            .groupBy(key, F.window(time, width).alias("w"))
            .agg(F.count("*").alias("n"), F.avg(value).alias("mean"),
                 F.stddev_samp(value).alias("std"))
            .select(key, F.unix_seconds("w.start").alias("start"), "n", "mean", "std"))

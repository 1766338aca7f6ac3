"""Series on a time axis: long form, merging, segments, batches, resampling, padding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitlake.functions.scalars import normal_pdf
from fitlake.operators.ordered import frames


def components(wide: DataFrame, columns: Mapping[tuple[str, int], str],
               keys: Sequence[str] = ("trial", "k")) -> DataFrame:
    """Long form with one row per key, history ``name`` and component ``idx``."""
    cells = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(idx).alias("idx"),
                               F.col(column).alias("value"))
                      for (name, idx), column in columns.items()])
    return wide.select(*keys, F.inline(cells))


def include_exclude(
    long: DataFrame, include: Mapping[str, Sequence[int] | None] | None = None,
    exclude: Mapping[str, Sequence[int] | None] | None = None,
) -> DataFrame:
    """Select components by name, or by name and indices; an excluded one stays out."""

    def matches(spec: Mapping[str, Sequence[int] | None]) -> Column:
        tests = [(F.col("name") == name) if idx is None
                 else (F.col("name") == name) & F.col("idx").isin(list(idx))
                 for name, idx in spec.items()]
        return reduce(lambda a, b: a | b, tests)

    if include:
        long = long.where(matches(include))
    if exclude:
        long = long.where(~matches(exclude))
    return long


def grid_report(long: DataFrame, keys: Sequence[str], time: str = "t") -> DataFrame:
    """Per history the start, stop and number of bins of its time axis, and a digest of its stops."""
    return long.groupBy(*keys, "name").agg(
        F.min(time).alias("t_min"), F.max(time).alias("t_max"), F.count("*").alias("n_bins"),
        F.sum(F.xxhash64(time).cast("decimal(38,0)")).alias("stops"))


def same_grid(long: DataFrame, keys: Sequence[str], time: str = "t", unit: str | None = None) -> DataFrame:
    """Per key whether all histories share every time stop, and the unit where a column names it."""
    axis = F.struct("t_min", "t_max", "n_bins", "stops")
    out = grid_report(long, keys, time).groupBy(*keys).agg(
        F.count("*").alias("n_hists"), (F.min(axis) == F.max(axis)).alias("consistent"))
    if unit is None:
        return out
    units = long.groupBy(*keys).agg(((F.min(unit) == F.max(unit)) & ~F.bool_or(F.col(unit).isNull())).alias("_unit"))
    return out.join(units, list(keys)).withColumn(
        "consistent", F.col("consistent") & F.coalesce("_unit", F.lit(False))).drop("_unit")


def merge_on_axis(
    parts: Mapping[str, DataFrame], keys: Sequence[str] = ("trial",), bin_: str = "k",
) -> DataFrame:
    """Full outer merge of single-value series on (key, bin), cut after the last complete bin.

    A union and one aggregation by (key, bin) instead of a chain of outer joins.
    """
    names = list(parts)
    stacked = reduce(DataFrame.unionByName, [
        df.select(*keys, bin_, *[(F.col("value") if n == name else F.lit(None).cast("double"))
                                 .alias(n) for n in names])
        for name, df in parts.items()])
    # dealt here: a union of joined tables may claim a partitioning that adaptive execution then changes
    merged = stacked.repartition(*keys, bin_).groupBy(*keys, bin_).agg(*[F.max(n).alias(n) for n in names])
    complete = reduce(lambda a, b: a & b, [F.col(n).isNotNull() & ~F.isnan(n) for n in names])
    last = merged.groupBy(*keys).agg(F.max(F.when(complete, F.col(bin_))).alias("_last"))
    return merged.join(last, list(keys)).where(F.col(bin_) <= F.col("_last")).drop("_last")


def arrays_on_axis(df: DataFrame, values: str, axis: DataFrame, keys: Sequence[str] = ("trial",),
                   bin_: str = "k") -> DataFrame:
    """Plain arrays as single-value series for ``merge_on_axis``: the first value stands at the first bin of the axis.

    ``axis`` has the keys, ``first`` and ``n_bins``. Values that are missing at the end of a shorter array are missing bins; an
    array longer than its axis is an error when it is read. A null array has no bins; null and NaN values are missing.
    """
    placed = df.join(axis.select(*keys, "first", "n_bins"), list(keys))
    size = F.size(values)
    message = F.concat(F.lit("array of "), size.cast("string"), F.lit(" values on an axis of "),
                       F.col("n_bins").cast("string"), F.lit(" bins"))
    checked = F.when(size > F.col("n_bins"), F.raise_error(message).cast(dict(df.dtypes)[values])).otherwise(F.col(values))
    cells = placed.select(*keys, "first", F.posexplode(checked).alias("_at", "value"))
    return cells.where(F.col("value").isNotNull() & ~F.isnan("value")).select(
        *keys, (F.col("first") + F.col("_at")).cast("long").alias(bin_), F.col("value").cast("double").alias("value"))


def slices(
    df: DataFrame, segments: DataFrame, key: str, at: str, start: str, stop: str, width: float,
) -> DataFrame:
    """Rows of each segment, both ends included.

    ``width`` is the bucket size of the range join: rows and segments meet on (key, bucket), so
    a long trial is spread over its buckets and no pair outside a common bucket is compared.
    """
    bucket = F.floor(F.col(at).cast("double") / width)
    covers = F.sequence(F.floor(F.col(start).cast("double") / width),
                        F.floor(F.col(stop).cast("double") / width))
    spread = segments.withColumn("_bucket", F.explode(covers))
    return (df.withColumn("_bucket", bucket).join(spread, [key, "_bucket"])
            .where(F.col(at).between(F.col(start), F.col(stop))).drop("_bucket"))


def batch_rows(df: DataFrame, batches: DataFrame, key: str, size: int) -> DataFrame:
    """Rows ``b <= k < b + size`` of each batch; batches may overlap.

    Each batch touches at most two buckets of ``size`` bins.
    """
    spread = batches.withColumn("_bucket", F.explode(F.sequence(
        F.floor(F.col("b") / size), F.floor((F.col("b") + size - 1) / size))))
    return (df.withColumn("_bucket", F.floor(F.col("k") / size)).join(spread, [key, "_bucket"])
            .where((F.col("k") >= F.col("b")) & (F.col("k") < F.col("b") + size))
            .drop("_bucket"))


def grid_knots(
    df: DataFrame, keys: Sequence[str], idx: str, x: str, y: str, n: int,
    window: float | None = None,
) -> DataFrame:
    """Pieces of a curve that own at least one of ``n`` regular grid points.

    Grid point ``j`` lies at ``_from + j * _step``; a piece owns ``_j0 .. _j1`` inclusive. The
    grid runs over the whole curve, or over its last ``window`` units of ``x``.
    """
    ends = df.groupBy(*keys).agg(F.min(x).alias("_x0"), F.max(x).alias("_xn"))
    first = F.col("_x0").cast("double")
    if window is not None:
        first = F.greatest(first, F.col("_xn") - F.lit(float(window)))
    ends = ends.select(*keys, first.alias("_from"),
                       ((F.col("_xn") - first) / (n - 1)).alias("_step"))
    pieces = frames(df.select(*keys, idx, x, y), keys, idx, {
        "_xb": lambda w: F.lead(x).over(w), "_yb": lambda w: F.lead(y).over(w)}, after=1)

    def upto(at: Column) -> Column:
        return F.when(F.col("_step") > 0, F.ceil((at - F.col("_from")) / F.col("_step") - 1e-9)
                      ).otherwise(0)

    stop = F.when(F.col("_xb").isNull(), F.lit(n)).otherwise(upto(F.col("_xb")))
    flat = (F.col("_step") == 0) & F.col("_xb").isNull()
    return (
        pieces.join(ends, list(keys))
        .withColumns({"_j0": F.when(flat, 0).otherwise(F.greatest(upto(F.col(x)), F.lit(0))),
                      "_j1": F.least(stop, F.lit(n)) - 1})
        .where(F.col("_j0") <= F.col("_j1")))


def at_grid(j: Column, x: Column, y: Column, xb: Column, yb: Column, start: Column,
            step: Column) -> Column:
    at = start + j * step
    return F.when(xb.isNull(), y).otherwise(y + (at - x) * (yb - y) / (xb - x))


def resample(
    df: DataFrame, keys: Sequence[str], idx: str, x: str, y: str, n: int,
    window: float | None = None,
) -> DataFrame:
    """Linear interpolation on ``n`` regular points from first to last ``x``; the ends clamp."""
    knots = grid_knots(df, keys, idx, x, y, n, window)
    points = knots.withColumn("j", F.explode(F.sequence("_j0", "_j1")))
    value = at_grid(F.col("j"), F.col(x), F.col(y), F.col("_xb"), F.col("_yb"), F.col("_from"),
                    F.col("_step"))
    return points.select(*keys, "j", (F.col("_from") + F.col("j") * F.col("_step")).alias("at"),
                         value.alias("value"))


def discard_padding(long: DataFrame, pads: Mapping[str, int]) -> DataFrame:
    """Drop leading bins so that all histories start where the most padded one does."""
    most = max(pads.values())
    pad = F.create_map(*[c for name, p in pads.items() for c in (F.lit(name), F.lit(p))])
    lead = F.lit(most) - F.element_at(pad, F.col("name"))
    return long.where(F.col("k") >= lead).withColumn("k", F.col("k") - lead)


def to_bin(t: Column, t0: Column, dt: float) -> Column:
    return F.round((t - t0) / dt).cast("long")


def shift_origin(t: Column, t0: Column, t0_new: Column) -> Column:
    return t + (t0_new - t0)


def window_stats(df: DataFrame, key: str, value: str, widths: Sequence[int],
                 skip: int = 0) -> DataFrame:
    """Mean and standard deviation over consecutive full windows of each width, in bins."""
    cut = df.where(F.col("k") >= skip).withColumn(
        "width", F.explode(F.array(*[F.lit(w) for w in widths])))
    slot = F.floor((F.col("k") - skip) / F.col("width"))
    return (cut.groupBy(key, "width", slot.alias("win")).agg(
        F.count("*").alias("_n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
        .where(F.col("_n") == F.col("width")).drop("_n"))


def integral(df: DataFrame, key: str, value: str, dt: float, mu: float, sigma: float) -> DataFrame:
    """Integral of each series over its length T, and its density under Normal(mu T, sigma sqrt(T)).

    That is the law of the integral of white noise with mean ``mu`` and spread ``sigma / sqrt(dt)``.
    """
    T = F.col("n") * dt
    return (df.groupBy(key).agg((F.sum(value) * dt).alias("integral"), F.count("*").alias("n"))
            .withColumn("density", normal_pdf(F.col("integral"), mu * T, sigma * F.sqrt(T))))

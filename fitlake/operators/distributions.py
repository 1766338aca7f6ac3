"""Histograms, densities and point selections over evaluated samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitlake.functions import families
from fitlake.operators.ordered import count_values, counted_summary, number
from fitlake.operators.tags import resolve
from fitlake.session import shuffle_join, spread, written

#: Rows of a table with one row per key that may be broadcast; longer ones are joined by shuffle.
BROADCAST_KEYS = 200_000


def bin_count(lo: Column, hi: Column, ptp: Column, n: Column, q1: Column, q3: Column) -> Column:
    """Automatic number of equal bins: the finer of Sturges' and Freedman–Diaconis' width."""
    sturges = ptp / (F.log2(n) + 1)
    spread = 2 * (q3 - q1) / F.pow(n, F.lit(1.0) / 3)
    width = F.when(q3 > q1, F.least(spread, sturges)).otherwise(sturges)
    return F.when(hi > lo, F.ceil((hi - lo) / width)).otherwise(F.lit(1)).cast("long")


def with_key_rows(df: DataFrame, settled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the columns of a written table that has one row per key.

    A short table is broadcast, as a shuffle by few keys would send all rows of a key to one task.
    """
    if settled.count() <= BROADCAST_KEYS:
        return df.join(F.broadcast(settled), list(keys))
    return shuffle_join(df, settled, keys)


def bin_edges(counted: DataFrame, keys: Sequence[str], value: str,
              fixed: bool = False) -> DataFrame:
    """Range, size and automatic bin count per key of a table of distinct values with counts.

    With ``fixed`` the range comes from the columns lo and hi of the table.
    """
    stats = counted_summary(counted, keys, value, {"_q1": 0.25, "_q3": 0.75})
    low, high = F.col("lowest"), F.col("highest")
    if fixed:
        bounds = counted.groupBy(*keys).agg(F.max("lo").alias("lo"), F.max("hi").alias("hi"))
        stats = stats.join(bounds, list(keys))
    else:
        stats = stats.withColumns({"lo": low, "hi": high})
    lo, hi = F.col("lo"), F.col("hi")
    bins = bin_count(lo, hi, high - low, F.col("rows"), F.col("_q1"), F.col("_q3"))
    return stats.withColumn("bins", bins).select(
        *keys, F.when(hi > lo, lo).otherwise(lo - 0.5).alias("lo"),
        F.when(hi > lo, hi).otherwise(hi + 0.5).alias("hi"), F.col("rows").alias("total"), "bins")


def histogram(df: DataFrame, keys: Sequence[str], value: str,
              bounds: DataFrame | None = None) -> DataFrame:
    """Counts and density per (key, bin); bins are half open but for the last. Empty bins are out.

    Range, quartiles and bins all come from one table of distinct values with counts, so the
    data is scanned and shuffled once. ``bounds`` (keys, lo, hi) fixes the range.
    """
    return histogram_of_counts(count_values(df, keys, value), keys, value, bounds)


def histogram_of_counts(counted: DataFrame, keys: Sequence[str], value: str,
                        bounds: DataFrame | None = None) -> DataFrame:
    v, lo, hi = F.col(value), F.col("lo"), F.col("hi")
    if bounds is not None:
        counted = with_key_rows(counted, written(bounds, "bounds"), keys).where(v.between(lo, hi))
    edges = written(bin_edges(counted, keys, value, fixed=bounds is not None), "bins")
    slot = F.least(F.floor((v - lo) / (hi - lo) * F.col("bins")), F.col("bins") - 1).cast("long")
    width = (hi - lo) / F.col("bins")
    return (with_key_rows(counted.select(*keys, value, "n"), edges, keys)
            .groupBy(*keys, "lo", "hi", "total", "bins", slot.alias("bin"))
            .agg(F.sum("n").alias("freq"))
            .withColumn("density", F.col("freq") / (F.col("total") * width)))


def truncation_bounds(hist: DataFrame, keys: Sequence[str], least: int = 50) -> DataFrame:
    """Range left after dropping tail bins until each side has held ``least`` samples.

    A key with too few samples for that keeps its full range.
    """
    w = Window.partitionBy(*keys).orderBy("bin")
    up = F.sum("freq").over(w.rowsBetween(Window.unboundedPreceding, 0))
    down = F.sum("freq").over(w.rowsBetween(0, Window.unboundedFollowing))
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    whole = [F.min("lo").alias("_lo"), F.max("hi").alias("_hi")]
    return (hist.withColumns({"_up": up, "_down": down}).groupBy(*keys).agg(
        F.min(F.when(F.col("_up") >= least, F.col("lo") + F.col("bin") * width)).alias("lo2"),
        F.max(F.when(F.col("_down") >= least,
                     F.col("lo") + (F.col("bin") + 1) * width)).alias("hi2"), *whole)
        .select(*keys, *[F.when(F.col("lo2") < F.col("hi2"), F.col(f"{c}2")).otherwise(F.col(f"_{c}")).alias(c)
                         for c in ("lo", "hi")]))


def truncated_histogram(df: DataFrame, keys: Sequence[str], value: str,
                        least: int = 50) -> DataFrame:
    counted = count_values(df, keys, value)
    bounds = truncation_bounds(histogram_of_counts(counted, keys, value), keys, least)
    return histogram_of_counts(counted, keys, value, bounds)


def smooth_density(df: DataFrame, keys: Sequence[str], value: str, points: int = 32) -> DataFrame:
    """Gaussian kernel density (Scott's bandwidth) at regular points over the data range.

    The grid is a fixed number of aggregates, so no sample row is multiplied.
    """
    stats = df.groupBy(*keys).agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi"),
        F.nullif(F.stddev_samp(value) * F.pow(F.count("*"), F.lit(-0.2)), F.lit(0.0)).alias("_h"))
    at = [F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (j / (points - 1)) for j in range(points)]
    z = [(a - F.col(value)) / F.col("_h") for a in at]
    kernel = [F.exp(-0.5 * x * x) / (F.col("_h") * (2 * 3.141592653589793) ** 0.5) for x in z]
    sums = (with_key_rows(df, written(stats, "stats"), keys).groupBy(*keys, "_lo", "_hi")
            .agg(*[F.avg(k).alias(f"_d{j}") for j, k in enumerate(kernel)]))
    cells = F.array(*[F.struct(F.lit(j).alias("j"), at[j].alias("point"),
                               F.col(f"_d{j}").alias("density")) for j in range(points)])
    return sums.select(*keys, F.inline(cells))


def objective_marginal(df: DataFrame, keys: Sequence[str], value: str, logp: str) -> DataFrame:
    """Mean probability per histogram bin, normalised by the trapezoid integral over the centres.

    Bins are open on the left and closed on the right, so a sample on the lowest edge is out.
    Empty bins count as zero and give no row, so a far outlier makes no table of empty bins.
    """
    edges = written(bin_edges(count_values(df, keys, value), keys, value), "bins")
    lo, width = F.col("lo"), (F.col("hi") - F.col("lo")) / F.col("bins")
    slot = F.least(F.ceil((F.col(value) - lo) / width) - 1, F.col("bins") - 1)
    means = (with_key_rows(df, edges, keys).withColumn("bin", slot.cast("long")).where("bin >= 0")
             .groupBy(*keys, "bin").agg(F.avg(F.exp(logp)).alias("_p")))
    full = edges.join(means, list(keys)).withColumns({
        "p": F.col("_p"), "center": lo + (F.col("bin") + 0.5) * width})
    inner = F.when((F.col("bin") == 0) | (F.col("bin") == F.col("bins") - 1), 0.5).otherwise(1.0)
    area = full.groupBy(*keys).agg(
        F.nullif(F.sum(F.col("p") * inner) * F.max(width), F.lit(0.0)).alias("_area"))
    note = F.when(F.col("bins") == 1, "all samples equal").when(F.col("bins") < 20, "few bins")
    return full.join(area, list(keys)).select(
        *keys, "bin", "center", (F.col("p") / F.col("_area")).alias("p"), note.alias("warning"))


def usable(score: Column) -> Column:
    """A score that can be compared: neither null, NaN nor plus infinity. Minus infinity is a probability of zero."""
    return score.isNotNull() & ~F.isnan(score) & (score < float("inf"))


def at_least_truth(df: DataFrame, key: str, logp: str, truth: Column, digits: int, order: Sequence[str] = ()) -> DataFrame:
    """Points no less likely than the true one of their key, with their ``rank``: the true one 0, then by descending score.

    Ties go by the columns ``order``. Points with a score that cannot be compared are left out, and so are keys whose
    true point has none.
    """
    good = df.where(usable(F.col(logp)))
    gt = good.where(truth).groupBy(key).agg(F.max(logp).alias("_gt"))
    kept = good.join(gt, key).where((F.col(logp) >= F.col("_gt")) | truth).withColumns({
        "is_truth": truth, "_behind": ~truth, "_down": -F.col(logp)})
    ranked = number(kept, [key], ["_behind", "_down", *order], name="rank")
    return ranked.withColumn(logp, F.round(logp, digits)).drop("_gt", "_behind", "_down")


def threshold(df: DataFrame, z: str, zmin: float = float("-inf"),
              zmax: float = float("inf")) -> DataFrame:
    return df.where(F.col(z).between(zmin, zmax))


def high_probability(df: DataFrame, keys: Sequence[str], z: str, boundary: Column) -> DataFrame:
    """Points whose probability relative to the best of their key reaches ``boundary``.

    Scores that cannot be compared (null, NaN, plus infinity) are no points and no best.
    """
    good = df.where(usable(F.col(z)))
    best = good.groupBy(*keys).agg(F.max(z).alias("_best"))
    near = (F.col("_best") > float("-inf")) & (F.col(z) - F.col("_best") >= F.ln(boundary))
    return good.join(best, list(keys)).where(near).drop("_best")


def discard_lowest(df: DataFrame, keys: Sequence[str], z: str, order: Sequence[str],
                   fraction: float, required: int, per_iter: int) -> DataFrame:
    """Drop the ``int(fraction * n)`` lowest points; the fraction is capped so enough remain.

    Scores that cannot be compared are the lowest of all.
    """
    fraction = min(fraction, 1 / (1 + required / per_iter))
    placed = df.withColumn("_z", F.when(usable(F.col(z)), F.col(z)))  # nulls come first
    ranked = number(placed, keys, ["_z", *order], name="_rank", start=0)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return ranked.join(sizes, list(keys)).where(
        F.col("_rank") >= F.floor(F.col("_n") * F.lit(fraction))).drop("_rank", "_n", "_z")


def extreme_points(df: DataFrame, keys: Sequence[str], z: str, point: Sequence[str],
                   tie: str) -> DataFrame:
    """Points of the highest and the lowest score that can be compared; of equals, the lowest ``tie``."""
    good = df.where(usable(F.col(z)))
    top = F.max_by(F.struct(*point, z), F.struct(z, -F.col(tie)))
    low = F.min_by(F.struct(*point, z), F.struct(z, tie))
    out = good.groupBy(*keys).agg(top.alias("_t"), low.alias("_l"))
    return out.select(*keys, *[F.col(f"_t.{c}").alias(f"argmax_{c}") for c in [*point, z]],
                      *[F.col(f"_l.{c}").alias(f"argmin_{c}") for c in [*point, z]])


def regular_mesh(df: DataFrame, keys: Sequence[str], axes: Sequence[str],
                 sizes: Sequence[int]) -> DataFrame:
    """Regular evaluation grid over the data range, ``sizes`` points per axis."""
    ends = df.groupBy(*keys).agg(*[f(a).alias(f"_{n}_{a}") for a in axes
                                   for n, f in (("lo", F.min), ("hi", F.max))])
    for axis, size in zip(axes, sizes):
        lo, hi = F.col(f"_lo_{axis}"), F.col(f"_hi_{axis}")
        ends = ends.withColumn(f"_j_{axis}", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
        ends = ends.withColumn(axis, lo + (hi - lo) * F.col(f"_j_{axis}") / (size - 1))
    return ends.select(*keys, *axes)


def evaluate_new(points: DataFrame, store: DataFrame, on: Sequence[str], score: Column,
                 name: str) -> DataFrame:
    """Score the points missing in the store and return the store with them."""
    fresh = points.join(store, list(on), "left_anti").withColumn(name, score)
    return store.unionByName(fresh.select(*store.columns))


def text_differences(df: DataFrame, a: str, b: str, keys: Sequence[str]) -> DataFrame:
    """Where two texts start to differ, with context, once per run of differences.

    A run ends after six equal characters. Equal texts are left out first. The two texts are compared character by character
    inside the row; nothing is shuffled.
    """
    differs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y) & (x != "") & (y != ""))
    spots = F.filter(F.transform(differs, lambda d, i: F.when(d, i)), lambda i: i.isNotNull())
    before = F.concat(F.array(F.lit(-100)), spots)
    starts = F.filter(F.zip_with(spots, before, lambda p, q: F.when(p - q > 6, p)),
                      lambda p: p.isNotNull())
    return (df.where(F.col(a) != F.col(b)).select(*keys, a, b, F.explode(starts).alias("at"))
            .withColumns({
                "context_a": F.substr(F.col(a), F.greatest(F.col("at") - 9, F.lit(1)), F.lit(60)),
                "context_b": F.substr(F.col(b), F.greatest(F.col("at") - 9, F.lit(1)), F.lit(60))})
            .drop(a, b))


def compose_prior(priors: DataFrame, selectors: Mapping[str, Sequence[str]],
                  overrides: Mapping[str, float] | None = None) -> DataFrame:
    """Prior of a composite model: the selected priors of each submodel, names prefixed by it."""
    chosen = resolve(priors, dict(sorted(selectors.items()))).withColumn(
        "param", F.concat_ws(".", "selector", "param"))
    if overrides:
        table = F.create_map(*[F.lit(x) for pair in overrides.items() for x in pair])
        chosen = chosen.withColumn("scale", F.coalesce(F.try_element_at(table, F.col("param")),
                                                       "scale"))
    return chosen


def truth_in_prior(df: DataFrame, keys: Sequence[str], points: int = 100) -> DataFrame:
    """Density of a prior on ``points`` places of its range, the range widened to show the true value ``v``.

    ``df`` has the columns of ``functions.families`` (dist, a, b, lo, hi) and ``v``. The range runs between the ends of the
    support; where there is none, from the 5 % or to the 95 % quantile. Counts are shown at the whole number below a place.
    """
    dist, names = F.col("dist"), families.used(df)
    low, high = families.support(dist, names=names)
    ends = df.withColumns({"_l": low, "_h": high})
    ends = ends.withColumns({
        "_l": F.when(F.col("_l") == float("-inf"), families.quantile(0.05, dist, names=names)).otherwise(F.col("_l")),
        "_h": F.when(F.col("_h") == float("inf"), families.quantile(0.95, dist, names=names)).otherwise(F.col("_h"))})
    v, low, high = F.col("v"), F.col("_l"), F.col("_h")
    ends = ends.withColumn("_lo", F.when(v < low, v - 0.05 * (high - v)).otherwise(low))
    ends = ends.withColumn("_hi", F.when(v > high, v + 0.05 * (v - F.col("_lo"))).otherwise(high))
    grid = spread(ends, points).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn(
        "x", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("j") / (points - 1))
    grid = grid.withColumn("x", F.when(dist == "poisson", F.floor("x").cast("double")).otherwise(F.col("x")))
    return grid.select(*keys, "j", "x", F.exp(families.log_density(F.col("x"), dist, names=names)).alias("pdf"))

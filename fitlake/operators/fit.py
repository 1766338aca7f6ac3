"""Fitting as Spark jobs: parameter passes, latent passes, adaptive search.

The scores are quadratic in the data, so their gradient over a batch needs six sums per
component. One job reduces every batch of every run to those sums; the sequential updates then
run per run on that short table, all runs at once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitlake.functions import rng
from fitlake.functions.scalars import total
from fitlake.operators.distributions import discard_lowest, high_probability, usable
from fitlake.operators.ordered import CHUNK, chunk_rows, frames, number
from fitlake.operators.series import batch_rows
from fitlake.session import checkpoint_dir, shuffle_join, written

#: Components in a table of moves that may be broadcast; larger tables are joined by shuffle.
BROADCAST_MOVES = 200_000
SUMS = ("n", "s_d", "s_p", "s_dp", "s_pp", "s_dd")


def clip_gradients(df: DataFrame, columns: Sequence[str], clip: float) -> DataFrame:
    """Rescale the gradients of a row together so that none exceeds ``clip``."""
    rescale = F.greatest(F.lit(1.0), *[F.abs(F.col(c) / clip) for c in columns])
    return df.withColumn("_r", rescale).withColumns(
        {c: F.col(c) / F.col("_r") for c in columns}).drop("_r")


def clip_over(df: DataFrame, keys: Sequence[str], column: str, clip: float) -> DataFrame:
    """Same over all gradients of an update, which may span many rows."""
    most = df.groupBy(*keys).agg(
        F.greatest(F.lit(1.0), F.max(F.abs(column) / clip)).alias("_r"))
    return df.join(most, list(keys)).withColumn(column, F.col(column) / F.col("_r")).drop("_r")


def scaled_rates(stats: DataFrame, rate: float) -> DataFrame:
    """Learning rate of each latent, scaled by its stationary standard deviation."""
    return stats.withColumn("rate", rate * F.col("stat_std"))


def batch_sums(df: DataFrame, batches: DataFrame, key: str, size: int,
               pairs: Mapping[int, tuple[str, str]]) -> DataFrame:
    """Sums of each (run, batch, component) over jumps ``d = x - prev`` and previous values."""
    rows = batch_rows(df, batches, key, size)
    cells = F.array(*[F.struct(F.lit(m).alias("comp"), (F.col(x) - F.col(p)).alias("d"),
                               F.col(p).alias("p")) for m, (x, p) in pairs.items()])
    long = rows.select(key, "batch", "b", F.inline(cells)).where("d IS NOT NULL")
    d, p = F.col("d"), F.col("p")
    return long.groupBy(key, "batch", "b", "comp").agg(
        F.count("*").cast("double").alias("n"), F.sum(d).alias("s_d"), F.sum(p).alias("s_p"),
        F.sum(d * p).alias("s_dp"), F.sum(p * p).alias("s_pp"), F.sum(d * d).alias("s_dd"))


def ou_score(theta: np.ndarray, s: np.ndarray, dt: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood of a batch and its gradient in (mu, log sigma, log tau), from the sums.

    ``theta`` has shape (..., 3) and ``s`` (..., 6); leading axes are independent fits.
    """
    mu, log_sigma, log_tau = np.moveaxis(theta, -1, 0)
    n, s_d, s_p, s_dp, s_pp, s_dd = np.moveaxis(s, -1, 0)
    a, c = dt * np.exp(-log_tau), 1 / (4 * np.exp(2 * log_sigma) * dt)
    level = s_pp - 2 * mu * s_p + n * mu * mu
    quad = s_dd + 2 * a * (s_dp - mu * s_d) + a * a * level
    score = -n * (log_sigma + 0.5 * math.log(2 * dt)) - c * quad
    by_mu = -c * (-2 * a * s_d + 2 * a * a * (n * mu - s_p))
    by_sigma = -n + 2 * c * quad
    by_tau = c * a * (2 * (s_dp - mu * s_d) + 2 * a * level)
    return score, np.stack([by_mu, by_sigma, by_tau], axis=-1)


@dataclass(frozen=True)
class Adam:
    """Settings of the parameter updates; ``prior`` holds (mean, spread) per parameter."""

    rate: float = 0.02
    b1: float = 0.9
    b2: float = 0.999
    eps: float = 1e-8
    clip: float | None = None
    prior: Sequence[tuple[float, float]] = field(
        default_factory=lambda: ((0.0, 1.0), (0.0, 3.0), (0.0, 3.0)))


def climb(theta: np.ndarray, batches: np.ndarray, share: float, dt: float, passes: int,
          settings: Adam) -> np.ndarray:
    """Adam ascent of many fits side by side: (fits, batches, 6) to (fits, steps, 4)."""
    mean, spread = np.array(settings.prior, dtype=float).T
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    trace = np.empty((len(theta), passes * batches.shape[1], 4))
    for t in range(trace.shape[1]):
        s = batches[:, t % batches.shape[1]]
        score, grad = ou_score(theta, s, dt)
        grad = grad - share * (theta - mean) / spread**2
        if settings.clip:
            grad = grad / np.maximum(1.0, np.abs(grad).max(axis=1, keepdims=True) / settings.clip)
        m = settings.b1 * m + (1 - settings.b1) * grad
        v = settings.b2 * v + (1 - settings.b2) * grad**2
        step = m / (1 - settings.b1 ** (t + 1))
        step /= np.sqrt(v / (1 - settings.b2 ** (t + 1))) + settings.eps
        theta = theta + settings.rate * step
        trace[:, t, 0] = score / np.maximum(s[:, 0], 1.0)
        trace[:, t, 1:] = theta
    return trace


def fit_parameters(sums: DataFrame, key: str, start: Sequence[float] | Sequence[Column],
                   share: float | Column, dt: float, passes: int = 1,
                   settings: Adam = Adam()) -> DataFrame:
    """Gradient ascent of each (run, component), batch after batch in order of their start.

    ``share`` is the batch length over the length of the run's segment, the weight of the prior. A fit is one
    row with six sums per batch, never the data itself; fits of an Arrow batch move together.
    """

    @F.pandas_udf("array<double>")
    def run(batches: pd.Series, mu: pd.Series, log_sigma: pd.Series,
            log_tau: pd.Series, weight: pd.Series) -> pd.Series:
        theta = np.stack([mu, log_sigma, log_tau], axis=1).astype(float)
        out: list = [None] * len(batches)
        lengths = np.array([len(b) for b in batches])
        for length in np.unique(lengths):
            at = np.flatnonzero(lengths == length)
            data = np.stack([batches.iloc[i] for i in at]).reshape(len(at), -1, len(SUMS))
            for i, row in zip(at, climb(theta[at], data, weight.to_numpy()[at][:, None], dt, passes, settings)):
                out[i] = row.ravel()
        return pd.Series(out)

    ordered = F.sort_array(F.collect_list(F.struct("b", "batch", *SUMS)))
    first = [c if isinstance(c, Column) else F.lit(float(c)) for c in start]
    fits = sums.groupBy(key, "comp").agg(
        F.flatten(F.transform(ordered, lambda s: F.array(*[s[c] for c in SUMS]))).alias("_s"),
        *[F.max(c).alias(f"_t{i}") for i, c in enumerate(first)],
        F.max(share if isinstance(share, Column) else F.lit(float(share))).alias("_w"))
    flat = fits.select(key, "comp", run("_s", "_t0", "_t1", "_t2", "_w").alias("_f"))
    steps = F.transform(F.sequence(F.lit(1), F.floor(F.size("_f") / 4).cast("int")), lambda t: F.struct(
        t.alias("step"), *[F.get("_f", 4 * t - 4 + i).alias(name) for i, name in enumerate(
            ("mean_logp", "mu", "log_sigma", "log_tau"))]))
    return flat.select(key, "comp", F.inline(steps))


@dataclass(frozen=True)
class LatentModel:
    """Fixed parameters behind a latent update: dynamics per component and the mixing."""

    mu: Sequence[float | Column]
    sigma: Sequence[float | Column]
    tau: Sequence[float | Column]
    weights: Sequence[Sequence[float]]
    dt: float

    def gradient(self, m: int, x: Sequence[Column], prev: Column, nxt: Column,
                 seen: Sequence[Column], dynamics: bool = True) -> Column:
        """Derivative of the forward score and the mixing error in component ``m`` of this bin."""
        misfit = [total([F.lit(float(w)) * v for w, v in zip(row, x)]) - y
                  for row, y in zip(self.weights, seen)]
        grad = total([-2 * float(row[m]) * e for row, e in zip(self.weights, misfit)])
        if not dynamics:
            return grad
        a, c = self.dt / self.tau[m], 1 / (2 * self.sigma[m] ** 2 * self.dt)
        here = x[m] - prev + (prev - self.mu[m]) * a
        after = nxt - x[m] + (x[m] - self.mu[m]) * a
        return (grad - c * F.coalesce(here, F.lit(0.0))
                + c * (1 - a) * F.coalesce(after, F.lit(0.0)))


Rule = tuple[Column, bool]


def latent_updates(df: DataFrame, keys: Sequence[str], latents: Sequence[str],
                   seen: Sequence[str], model: LatentModel, rate: Mapping[str, float],
                   rules: Sequence[Rule], before: bool = False,
                   longest: int | None = None) -> DataFrame:
    """Apply latent updates one after the other: each moves the rows of its condition along
    the gradient, with or without the dynamics term. With ``before``, ``prev_x`` is the moved
    value of the bin before, from the same sort.

    An update looks one bin to either side, so a halo of one bin per update makes the whole
    sequence local to a chunk: all updates share one shuffle and one sort. Where the bins of the
    ``longest`` trace are known and fit a chunk, nothing has to be copied.
    """
    n = len(rules) + int(before)
    size = max(chunk_rows(df), 2 * n)
    split = longest is None or longest > size
    here, within = F.floor(F.col("k") / size), F.pmod(F.col("k"), F.lit(size))
    copies = F.array_compact(F.array(here, F.when(within >= size - n, here + 1),
                                     F.when((within < n) & (here > 0), here - 1)))
    w = Window.partitionBy(*keys, *[CHUNK] * split).orderBy("k")
    out = df.withColumn(CHUNK, F.explode(copies)) if split else df
    for condition, dynamics in rules:
        x, y = [F.col(c) for c in latents], [F.col(c) for c in seen]
        moved = {c: F.when(condition, F.col(c) + rate[c] * model.gradient(
            m, x, F.lag(c).over(w), F.lead(c).over(w), y, dynamics)).otherwise(F.col(c))
            for m, c in enumerate(latents)}
        out = out.withColumns(moved)
    if before:
        out = out.withColumns({f"prev_{c}": F.lag(c).over(w) for c in latents})
    return out.where(F.col(CHUNK) == F.floor(F.col("k") / size)).drop(CHUNK) if split else out


def full_trace_rules(n: int) -> list[Rule]:
    return [(F.lit(True), True)] * n


def batch_rules(starts: Column, n: int, size: int, relax: int) -> list[Rule]:
    """Batches from right to left: the last one with its relaxation bins and without dynamics,
    the first one extended to the start of the trace. ``starts`` is a sorted array of ``n``."""
    k = F.col("k")
    rules: list[Rule] = [((k >= starts[n - 1]) & (k < starts[n - 1] + size + relax), False)]
    rules += [((k >= starts[i]) & (k < starts[i] + size), True) for i in range(n - 2, 0, -1)]
    return [*rules, (k < starts[0] + size, True)]


def clipped_latent_passes(df: DataFrame, keys: Sequence[str], latents: Sequence[str],
                          seen: Sequence[str], model: LatentModel, rate: Mapping[str, float],
                          n: int, clip: float, every: int = 5) -> DataFrame:
    """Whole-trace updates with clipping; the largest gradient of a trace needs its own
    aggregate per update, and lineage is cut in the shared folder every few updates."""
    checkpoint_dir(df.sparkSession)
    for i in range(n):
        out = frames_gradient(df, keys, latents, seen, model)
        most = out.groupBy(*keys).agg(F.greatest(F.lit(1.0), *[
            F.max(F.abs(f"_g_{c}")) / clip for c in latents]).alias("_r"))
        out = out.join(most, list(keys))
        df = out.withColumns({c: F.col(c) + rate[c] * F.col(f"_g_{c}") / F.col("_r")
                              for c in latents}).select(*df.columns)
        if (i + 1) % every == 0:
            df = df.checkpoint()
    return df


def frames_gradient(df: DataFrame, keys: Sequence[str], latents: Sequence[str],
                    seen: Sequence[str], model: LatentModel) -> DataFrame:
    x, y = [F.col(c) for c in latents], [F.col(c) for c in seen]
    return frames(df, keys, "k", {
        f"_g_{c}": lambda w, m=m, c=c: model.gradient(m, x, F.lag(c).over(w), F.lead(c).over(w), y)
        for m, c in enumerate(latents)}, before=1, after=1)


def remove_degeneracies(weights: DataFrame, comps: DataFrame, n_comps: int) -> tuple[DataFrame, DataFrame]:
    """Scale the columns of each mixing matrix to unit absolute sum and order the components.

    ``weights`` is (set_id, row, comp, w); ``comps`` is (set_id, comp, mu, log_sigma, log_tau).
    The factor moves into the spread and mean of the component. Within each half, components
    follow descending spread. A column that sums to zero keeps its scale. Returns both tables with the new component index.
    """
    if n_comps % 2:
        raise ValueError("the number of components must be even")
    scale = weights.groupBy("set_id", "comp").agg(F.coalesce(F.nullif(F.abs(F.sum("w")), F.lit(0.0)), F.lit(1.0)).alias("factor"))
    half = F.floor(F.col("comp") / (n_comps // 2))
    order = Window.partitionBy("set_id", "half").orderBy(F.desc("log_sigma"), "comp")
    scaled = (shuffle_join(comps, scale, ["set_id", "comp"])
              .withColumns({"log_sigma": F.col("log_sigma") + F.ln("factor"),
                            "mu": F.col("mu") * F.col("factor"), "half": half})
              .withColumn("new_comp", (F.col("half") * (n_comps // 2)
                                       + F.row_number().over(order) - 1).cast("int")))
    moved = shuffle_join(weights, scaled.select("set_id", "comp", "new_comp", "factor"), ["set_id", "comp"])
    return (moved.select("set_id", "row", "new_comp", (F.col("w") / F.col("factor")).alias("w")),
            scaled.select("set_id", "comp", "new_comp", "factor", "mu", "log_sigma", "log_tau"))


def moves(comps: DataFrame, n_comps: int) -> DataFrame:
    """(set_id, moves): per set the new place and the factor of each component, as an array by the old place.

    ``comps`` is the second table of ``remove_degeneracies``. One short row per set, however long its series are.
    """
    cell = F.struct(F.col("comp").alias("comp"), F.col("new_comp").alias("to"), F.col("factor").alias("factor"))
    return comps.groupBy("set_id").agg(F.array_sort(F.collect_list(cell)).alias("moves"))


def _with_moves(rows: DataFrame, moved: DataFrame) -> DataFrame:
    """Rows with the moves of their set; the table of moves is settled first, so that its cells can be counted."""
    found = written(moved, "moves")
    cells = found.agg(F.sum(F.size("moves"))).first()[0] or 0
    if cells <= BROADCAST_MOVES:
        return rows.join(F.broadcast(found), "set_id")
    return shuffle_join(rows, found, ["set_id"])


def moved_rows(rows: DataFrame, moved: DataFrame, times: Sequence[str] = (), over: Sequence[str] = ()) -> DataFrame:
    """Long rows (set_id, comp, ...) at their new component; the columns ``times`` grow by the factor, ``over`` shrink by it.

    For latents, means and spreads as for mixing weights and signs: with latents times and weights over the factor, the mixed
    signal and every score of it stay.
    """
    found = _with_moves(rows, moved)
    own = F.element_at("moves", F.col("comp").cast("int") + 1)
    scaled = {c: F.col(c) * own["factor"] for c in times} | {c: F.col(c) / own["factor"] for c in over}
    return found.withColumns({**scaled, "comp": own["to"]}).select(*rows.columns)


def moved_arrays(rows: DataFrame, moved: DataFrame, values: str) -> DataFrame:
    """The same for rows with one array of all components: permuted and times the factor, without taking it apart."""
    found = _with_moves(rows, moved)
    order = F.array_sort(F.transform("moves", lambda m: F.struct(m["to"].alias("to"), m["comp"].alias("comp"),
                                                                 m["factor"].alias("factor"))))
    return found.withColumn(values, F.transform(order, lambda m: F.get(F.col(values), m["comp"]) * m["factor"])).select(
        *rows.columns)


def densify(
    df: DataFrame, names: Sequence[str], lp: Callable[[Sequence[Column]], Column], centre: Sequence[float],
    spread: Sequence[float], per_round: int, required: int, boundary: float = 0.01, shrink: float = 0.6,
    discard: float = 0.5, most_rounds: int | None = None, seed: int = 0, patience: int = 3,
) -> DataFrame:
    """Fill the region of high probability with points, round by round.

    A round proposes ``per_round`` points from normals of spread ``spread * shrink**round`` around
    the centre, scores them all in one pass over ``df`` (``lp`` gives a row's score for coordinates
    in the columns ``names``), drops the lowest share of what is kept, and takes one of the points
    whose probability is at least ``boundary`` times the best as the next centre. It ends
    once ``required`` points are that probable, or after ``most_rounds``. Scores that cannot be compared (null, NaN, plus
    infinity) count as the lowest. A round stalls if no score can be compared, if all of them are equal, or if neither
    the best score nor the number of probable points grew; after ``patience`` such rounds on end the search ends, not converged.

    Returns round, draw, the coordinates, ``score``, ``high`` and ``converged`` of every point.
    Points live in tables of the shared folder; draws are hashes of (seed, round, draw, axis).
    """
    if not 0 < shrink <= 1 or required < 1 or per_round < 1:
        raise ValueError("shrink must be in (0, 1], required and per_round at least 1")
    spark = df.sparkSession
    key = ["round", "draw"]
    at = spark.range(1).select(*[F.lit(float(c)).alias(f"_c{i}") for i, c in enumerate(centre)])
    seen = kept = None
    number_of, converged, stalled, last = 0, False, 0, (-math.inf, 0)
    while not converged and stalled < patience and (most_rounds is None or number_of < most_rounds):
        width = [float(w) * shrink**number_of for w in spread]
        drawn = at.select(F.explode(F.sequence(F.lit(0), F.lit(per_round - 1))).alias("draw"), "*").select(
            F.lit(number_of).alias("round"), "draw",
            *[(F.col(f"_c{i}") + w * rng.normal(seed, number_of, F.col("draw"), i)).alias(n)
              for i, (n, w) in enumerate(zip(names, width))])
        points = written(drawn, "proposed")
        # one row with the round's few points rides along each data row as a scalar
        asked = points.agg(F.array_sort(F.collect_list(F.struct("draw", *names))).alias("p")).scalar()
        sums = df.withColumn("_p", asked).agg(*[
            F.sum(lp([F.col("_p")[j][n] for n in names])).alias(f"s{j}") for j in range(per_round)])
        scores = sums.select(F.posexplode(F.array(*[f"s{j}" for j in range(per_round)])).alias("draw", "score"))
        new = written(points.join(scores, "draw").select(*key, *names, "score"), "scored")
        seen = new if seen is None else seen.unionByName(new)
        pool = new if kept is None else kept.drop("_all").unionByName(new)
        pool = pool.withColumn("_all", F.lit(0))
        kept = written(discard_lowest(pool, ["_all"], "score", key, discard, required, per_round), "kept")
        high = high_probability(kept, ["_all"], "score", F.lit(boundary))
        n, best = high.agg(F.count("*"), F.max("score")).first()
        lowest = kept.where(usable(F.col("score"))).agg(F.min("score")).first()[0]
        flat = n > 1 and lowest == best
        converged = n >= required and not flat
        grew = n > 0 and not flat and (best > last[0] or n > last[1])
        stalled = 0 if grew else stalled + 1
        last = (best, n) if n else last
        ranked = number(high, ["_all"], ["score", *key], name="_nr", start=0)
        pick = F.floor(rng.uniform(seed, number_of, "centre") * n)
        if n:  # else the next round starts from the same centre
            at = ranked.where(F.col("_nr") == pick).select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(names)])
        number_of += 1
    best = seen.where(usable(F.col("score"))).agg(F.max("score")).scalar()
    return seen.withColumns({"high": usable(F.col("score")) & F.coalesce(
        F.col("score") - best >= math.log(boundary), F.lit(False)),
                             "converged": F.lit(converged)})

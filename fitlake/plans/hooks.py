"""Where user functions plug in. A hook returns Columns or a DataFrame, so it runs in the plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitlake.functions import rng
from fitlake.functions.objectives import Objective
from fitlake.operators.runs import without_failed

Callback = Callable[[DataFrame], Mapping[str, Column]]
NAMED_FILTERS: dict[str, Callable[[DataFrame], DataFrame]] = {"nofail": without_failed}
OBJECTIVES: dict[str, Objective] = {}


def record(steps: DataFrame, callback: Callback, condition: Column | None = None) -> DataFrame:
    """Recorder: the values of ``callback`` at the steps that meet ``condition``."""
    due = steps if condition is None else steps.where(condition)
    return due.select("run", "step", *[c.alias(n) for n, c in callback(due).items()])


def filter_fits(fits: DataFrame, test: str | Column | Callable[[DataFrame], Column]) -> DataFrame:
    """Filter by name, by a condition, or by a function that makes one."""
    if isinstance(test, str):
        return NAMED_FILTERS[test](fits)
    return fits.where(test if isinstance(test, Column) else test(fits))


def add_field(runs: DataFrame, name: str, get: Callable[[DataFrame], Column]) -> DataFrame:
    """Field to split runs by, computed from their record."""
    return runs.withColumn(name, get(runs))


def register_objective(name: str, make: Callable[..., Column], *tags: str) -> None:
    OBJECTIVES[name] = Objective(make, frozenset(tags))


def objective(name: str, **options) -> Objective:
    """Registered objective with keyword overrides."""
    return OBJECTIVES[name].with_options(**options)


def update_rates(latents: DataFrame, stats: DataFrame,
                 update: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Hyperparameter update: a function of the latents and their statistics."""
    return update(latents, stats)


def custom_draws(df: DataFrame, name: str, draw: Callable[[np.random.Generator], float],
                 *key: str, stream: int | str = 0) -> DataFrame:
    """Column of draws from a user's generator, seeded per row by its key."""
    seeded = df.withColumn("_seed", rng.seed(stream, *[F.col(k) for k in key]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values = [float(draw(np.random.default_rng(int(s)))) for s in frame["_seed"]]
            yield frame.drop(columns="_seed").assign(**{name: values})

    return seeded.mapInPandas(fill, f"{schema}, `{name}` double")


def weigh(curves: DataFrame, weight: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Weights of curves by a function over all of them, in place of a colour function."""
    return weight(curves)

"""From the run store to result tables: filter, keep one run per key, split, summarise, rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitlake.operators import runs as R
from fitlake.operators.ordered import linear_quantiles


def compare_fits(runs: DataFrame, traces: DataFrame, keys: Sequence[str],
                 split_fields: Sequence[str], quantile: float = 0.95) -> DataFrame:
    """Best fit per split: failed runs out, one run per key, ranked by a log-likelihood quantile."""
    fits = R.one_run_per_key(R.without_failed(runs), traces, keys)
    labelled = R.split_by(runs.join(fits.select("run", "stepi"), "run"), split_fields)
    scores = linear_quantiles(traces.select("run", "logl"), ["run"], "logl", {"score": quantile})
    best = R.best_per_group(labelled.drop("score").join(scores.drop("rows"), "run"),
                            "split_label", "score", "run")
    size = labelled.groupBy("split_label").agg(F.count("*").alias("n_fits"))
    return best.join(size, "split_label")

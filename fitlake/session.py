"""Session used by the tests and the benchmark; a cluster brings its own."""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Rows that a task of an unfolded table is to make.
UNFOLDED_ROWS = 1_000_000


def local_session(cores: int | str = 8, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("fitlake")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", os.environ.get("FITLAKE_SHUFFLE", "8"))
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster; where none is named, one in the warehouse."""
    named = spark.conf.get(CHECKPOINT_CONF, None) or (
        spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a Parquet table in the shared folder.

    For results that several later steps read: they are computed once, survive lost executors,
    and each step reads only the columns it needs.
    """
    path = os.path.join(checkpoint_dir(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join that never broadcasts a side.

    For rows unfolded from shorter ones and for well packed tables: Spark takes them for as small as the file they come
    from, and would gather all of them in the driver.
    """
    return left.join(right.hint("merge"), list(on))


def spread(df: DataFrame, times: int) -> DataFrame:
    """Rows dealt evenly over tasks before each of them is unfolded into ``times`` rows.

    A short table is read by few tasks, and all that its rows unfold into would stay with these.
    """
    tasks = math.ceil(df.count() * times / UNFOLDED_ROWS)
    return df.repartition(tasks) if tasks > 1 else df

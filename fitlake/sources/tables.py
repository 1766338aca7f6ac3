"""The canonical tables of the engine, bound to the star-schema and event tables.

``series``  trial, k, one column per component      from lineitem
``irregular`` trial, t, name, value                 from events
``traces``  run, step, logl, context                from orders
``runs``    run, label, split, lam, init_key, ...   from customer
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitlake.operators.ordered import number

COMPONENTS = {"x0": "l_quantity", "x1": "l_extendedprice", "x2": "l_discount", "x3": "l_tax"}
LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
              "l_extendedprice"]

# The outcome text a run record carries for each final status.
OUTCOMES = {
    "F": "Status: <OptimizerStatus.Converged>",
    "O": "Status: <OptimizerStatus.NotConverged>",
    "P": "Status: <OptimizerStatus.Failed>",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = number(table(spark, sf_dir, "lineitem"), ["l_suppkey"], LINE_ORDER, name="k", start=0)
    return lines.select(
        F.col("l_suppkey").alias("trial"), "k",
        *[(F.col(source) + 0.0).alias(name) for name, source in COMPONENTS.items()])


def irregular(spark: SparkSession, sf_dir: str) -> DataFrame:
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("trial"), F.col("ts").alias("t"),
        F.timestamp_diff("MICROSECOND", epoch, F.col("ts")).alias("us"), "event_id",
        F.col("event_type").alias("name"), "value")


def traces(spark: SparkSession, sf_dir: str, with_nan: bool = False) -> DataFrame:
    orders = number(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"],
                    name="step", start=1)
    value = F.col("o_totalprice")
    if with_nan:
        value = F.when(F.col("o_orderkey") % 97 == 0, F.lit(float("nan"))).otherwise(value)
    return orders.select(F.col("o_custkey").alias("run"), "step", value.alias("logl"),
                         F.col("o_orderpriority").alias("context"),
                         F.col("o_orderstatus").alias("status"), "o_orderkey")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = (
        table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("run"))
        .agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"))
    )
    outcome = F.lit(None).cast("string")
    for code, text in OUTCOMES.items():
        outcome = F.when(F.col("status") == code, text).otherwise(outcome)
    init_key = F.format_string("(%d, %d)", F.col("c_nationkey"), F.col("c_custkey") % 7)
    return (
        table(spark, sf_dir, "customer").withColumn("run", F.col("c_custkey"))
        .join(last, "run", "left")
        .select(
            "run", F.col("c_name").alias("label"), F.col("c_mktsegment").alias("split"),
            F.concat(F.lit("n"), F.col("c_nationkey")).alias("lam"),
            F.col("c_nationkey").alias("nation"), init_key.alias("init_key"),
            F.concat(F.lit("Init params: "), init_key, F.lit("\nsegment "),
                     F.col("c_mktsegment")).alias("reason"),
            outcome.alias("outcome"),
            (F.col("c_custkey") * 977 % 200000).alias("duration_s"),
            F.col("c_acctbal").alias("score"))
    )

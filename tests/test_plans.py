import numpy as np
import pytest
from pyspark.sql import functions as F

from fitlake.plans import hooks
from fitlake.plans.scoring import score_batches
from fitlake.queries import QUERIES, load_all

load_all()


def plan_text(df):
    return df._jdf.queryExecution().toString()


def test_batch_scores_equal_brute_force(spark):
    gen = np.random.default_rng(0)
    value = {t: gen.normal(size=80) for t in range(4)}
    df = spark.createDataFrame([(t, k, float(v)) for t, x in value.items() for k, v in enumerate(x)],
                               "trial long, k long, v double")
    got = score_batches(df, F.col("v") * F.col("v"), 25, start=10, length=60, Kb=8, Nb=5).toPandas()
    assert len(got) == 125 and (got["n_bins"] == 8).all() and got["b"].between(0, 52).all()
    for r in got.itertuples():
        part = value[r.trial][10 + r.b:10 + r.b + 8]
        assert r.score == pytest.approx((part**2).mean())


def test_custom_draws_repeat(spark):
    df = spark.range(200).withColumnRenamed("id", "key")
    a = hooks.custom_draws(df.repartition(1), "v", lambda g: g.gamma(2.0), "key").toPandas()
    b = hooks.custom_draws(df.repartition(5), "v", lambda g: g.gamma(2.0), "key").toPandas()
    assert a.set_index("key")["v"].sort_index().equals(b.set_index("key")["v"].sort_index())
    assert abs(a["v"].mean() - 2) < 0.4


def test_filters_and_columns_reach_the_scan(spark):
    text = plan_text(QUERIES["src8_run_store_filters"](spark, "/root/testdata/sf0.001"))
    assert "GreaterThanOrEqual(o_orderdate" in text and "LessThan(o_orderdate" in text
    scan = [line for line in plan_text(QUERIES["lik1_white_noise"](spark, "/root/testdata/sf0.001"))
            .split("== Physical Plan ==")[1].splitlines() if "FileScan" in line and "l_discount" in line]
    assert scan and all("l_returnflag" not in line for line in scan)


@pytest.mark.parametrize("name", ["join2_segment_slice", "join3_batch_rows", "join4_nearest_step",
                                  "join12_complete_grid", "join14_better_than_truth", "tag8_resolve_selectors"])
def test_no_nested_loops(spark, name):
    text = plan_text(QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text

"""Every registered query against its SQL, on the smallest tables."""

import pytest

from fitlake.queries import QUERIES, SQL, load_all
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
load_all()
LONG_RUNS = ["agg1_run_results", "agg7_set_labels", "win1_without_repeats", "win8_decimate",
             "win9_increments", "win6_resample_75", "win10_pooled_limits", "trc2_windowed_quantile",
             "join4_nearest_step", "join5_rebuild_state", "win4_prefix_scores",
             "lik5_ou_backward_smoother", "cnv3_constant_params", "cnv5_sticky_result",
             "cnv6_run_status", "cnv7_regression_report", "dist1_density_histogram",
             "dist2_truncated_histogram", "sort4_discard_lowest", "fit2_latent_pass"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        assert compare(df, con, SQL[name]) is None
    else:
        assert df.count() > 0


@pytest.mark.parametrize("name", LONG_RUNS)
def test_query_with_split_runs(spark, con, tiny_chunks, name):
    assert compare(QUERIES[name](spark, SF), con, SQL[name]) is None


def test_names_follow_the_inventory():
    assert all(name == name.lower() for name in QUERIES)
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__
    df = __spark_entry__.entry(spark)
    assert df.columns[0] == "run" and df.count() > 0


@pytest.mark.parametrize("name", ["join5_rebuild_state", "lik14_terms_of_recorded_steps"])
def test_lines_are_numbered_once(spark, name):
    """All uses of the series read the numbered rows, not the lines again."""
    assert not [f for f in QUERIES[name](spark, SF).inputFiles() if f.endswith("lineitem.parquet")]

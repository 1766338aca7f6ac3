import os

import pytest
from pyspark.sql import functions as F

from fitlake.streaming import live


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Steps of three runs arriving in six files."""
    path = str(tmp_path_factory.mktemp("steps"))
    rows = spark.range(900).select(
        (F.col("id") % 3).alias("run"), F.floor(F.col("id") / 3).alias("step"),
        (10 * F.exp(-F.floor(F.col("id") / 3) / 30.0) * (1 + F.sin(F.floor(F.col("id") / 3)))
         + F.col("id") % 3).alias("value"),
        F.timestamp_micros((F.col("id") + 1440) * 60_000_000).alias("at"))
    seen: set[str] = set()
    for i in range(6):
        rows.where((F.col("step") >= 50 * i) & (F.col("step") < 50 * (i + 1))).coalesce(1).write.mode(
            "append").parquet(path)
        for name in set(os.listdir(path)) - seen:  # the source reads files by their time
            os.utime(os.path.join(path, name), (1_700_000_000 + 100 * i,) * 2)
        seen = set(os.listdir(path))
    return path, rows


def stream(spark, folder):
    return live.read_files(spark, folder[0], "*.parquet", per_trigger=1)


def test_thinned_stream_equals_batch(spark, folder):
    got = live.run_to_table(live.thinned(stream(spark, folder), 1.3, "at"), "t").toPandas()
    from fitlake.operators.traces import ready
    want = folder[1].where(ready(F.col("step"), 1.3)).toPandas()
    assert sorted(zip(got["run"], got["step"])) == sorted(zip(want["run"], want["step"]))


def test_status_over_many_batches_equals_one_loop(spark, folder):
    got = live.run_to_table(live.live_status(stream(spark, folder), 6, 2**-7, 100.0), "s").toPandas()
    pdf = folder[1].toPandas().sort_values("step")
    for run, part in pdf.groupby("run"):
        v, status, changes = part["value"].tolist(), 0, []
        for i in range(len(v)):
            new = 3 if i >= 5 and max(abs(v[i] - x) for x in v[i - 5:i]) < 2**-7 else 0
            if status | new != status:
                status |= new
                changes.append((i, status))
        mine = got[got["run"] == run].sort_values("step")
        assert list(zip(mine["step"], mine["status"])) == changes and changes


def test_last_records_and_catalogue(spark, folder):
    last = live.last_records(stream(spark, folder).select("run", "step", "value"), "run", "step", "l")
    assert sorted((r["run"], r["step"]) for r in last.collect()) == [(0, 299), (1, 299), (2, 299)]
    trials = live.refresh_catalogue(stream(spark, folder).select("run"), ["run"], "c")
    assert sorted(r["run"] for r in trials.collect()) == [0, 1, 2]


def test_streams_go_on_in_their_folder(spark, folder, tmp_path):
    """Stopped after two files and started again, the streams end as in one go."""
    path, rows = folder
    part, out = str(tmp_path / "files"), str(tmp_path / "out")
    for step, limit in enumerate((100, 100, 300)):
        rows.where((F.col("step") >= (0, 100, 100)[step]) & (F.col("step") < limit)).coalesce(1).write.mode(
            "append").parquet(part)
        read = lambda: live.read_files(spark, part, "*.parquet", per_trigger=1)
        last = live.last_records(read().select("run", "step", "value"), "run", "step", "l", out + "/l")
        known = live.refresh_catalogue(read().select("run"), ["run"], "c", out + "/c")
        status = live.run_to_table(live.live_status(read(), 6, 2**-7, 100.0), "s", out + "/s")
        assert {r.step for r in last.collect()} == {limit - 1} and known.count() == 3
    want = live.run_to_table(live.live_status(stream(spark, folder), 6, 2**-7, 100.0), "s")
    assert sorted(map(tuple, status.collect())) == sorted(map(tuple, want.collect()))


def test_a_cost_that_is_not_finite_fails_at_once(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, float("nan")), (2, 0, 1.0), (2, 1, 1.5)], "run int, step long, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    steps = live.read_files(spark, str(tmp_path / "in"), "*.parquet")
    got = live.run_to_table(live.live_status(steps, 9, 0.1, 5.0), "s").collect()
    assert [tuple(r) for r in got] == [(1, 1, -1)]


def test_tumbling_statistics_equal_batch(spark, folder):
    stats = live.tumbling_stats(stream(spark, folder), "run", "value", "at", "1 hour", "10 minutes")
    got = live.run_to_table(stats, "w").toPandas()
    want = (folder[1].groupBy("run", (F.floor(F.unix_seconds("at") / 3600) * 3600).alias("start"))
            .agg(F.count("*").alias("n"), F.avg("value").alias("mean")).toPandas())
    both = got.merge(want, on=["run", "start"], suffixes=("", "_w"))
    assert len(both) == len(got) >= len(want) - 6 and (both["n"] == both["n_w"]).all()
    assert (abs(both["mean"] - both["mean_w"]) < 1e-9).all()


def test_live_tests_equal_the_batch_tests(spark, folder):
    """All three tests over six micro-batches, against the batch operators on the same rows."""
    from fitlake.operators import convergence as C
    path, rows = folder
    batch = rows.select("run", "step", F.col("step").alias("k"), "value")
    tests = {"div": C.diverging_cost("value", maximize=False, tol=9.0), "cost": C.constant_cost("value", n=6),
             "par": C.constant_params(["value"], n=4, rtol=0.2)}
    want = {(r.run, r.step): (r.k, r.div, r.cost, r.par) for r in C.evaluate(batch, tests).collect()}
    live_ = live.LiveTests(("value", False, 9.0), ("value", 6, 2**-7), (["value"], 4, 0.2))
    got = live.run_to_table(live.live_tests(stream(spark, folder), live_, stop=False), "t").collect()
    assert {(r.run, r.step): (r.k, r.div, r["cost"], r.par) for r in got} == want
    assert {s for v in want.values() for s in v[2:]} == {0, 1, 3}
    stopped = live.run_to_table(live.live_tests(stream(spark, folder), live_), "t").collect()
    ends = {run: min(r.step for r in got if r.run == run and (r.run_status == -1 or r.run_status & 3 == 3)) for run in (0, 1, 2)}
    assert {(r.run, r.step, r.run_status) for r in stopped} == {
        (r.run, r.step, r.run_status) for r in got if r.step <= ends[r.run]}


def test_state_of_a_silent_run_goes(spark, tmp_path):
    """Run 1 is silent for over a second of event time: its state goes, and it starts anew; run 2 goes on."""
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i, rows in enumerate([[(1, 0, 0), (2, 0, 0)], [(2, 1, 60)], [(2, 2, 120)], [(2, 3, 180), (1, 1, 180)]]):
        df = spark.createDataFrame(rows, "run int, step long, at int").select(
            "run", "step", F.lit(1.0).alias("v"), F.timestamp_seconds(F.col("at") + 1000).alias("at"))
        df.coalesce(1).write.mode("append").parquet(path)
        steps = live.read_files(spark, path, "*.parquet", per_trigger=1).withWatermark("at", "1 second")
        got = live.run_to_table(live.live_tests(steps, live.LiveTests(cost=("v", 9, 0.1)), time="at", silent=1000), "t", out)
    assert sorted((r.run, r.step, r.k) for r in got.collect()) == [
        (1, 0, 0), (1, 1, 0), (2, 0, 0), (2, 1, 1), (2, 2, 2), (2, 3, 3)]


def test_live_tests_of_values_not_finite(spark, tmp_path):
    rows = [(1, 0, 1.0), (1, 1, None), (1, 2, 2.0), (2, 0, 5.0), (2, 1, 5.0), (2, 1, 7.0), (2, 2, 5.0), (2, 3, float("inf"))]
    spark.createDataFrame(rows, "run int, step long, v double").coalesce(1).write.parquet(str(tmp_path / "in"))
    steps = live.read_files(spark, str(tmp_path / "in"), "*.parquet")
    tests = live.LiveTests(("v", True, 1e9), None, (["v"], 2, 0.1))
    got = {(r.run, r.step): (r.div, r.par, r.run_status) for r in live.run_to_table(
        live.live_tests(steps, tests, stop=False), "t").collect()}
    assert got[1, 1] == (-1, 0, -1) and got[1, 2] == (0, 0, -1)
    assert got[2, 1] == (0, 1, 1) and got[2, 3] == (-1, 0, -1)


def test_merge_refuses_known_trials(spark, tmp_path):
    """A trial that comes again in a later file, or twice in one, is reported; a repeated call adds nothing."""
    path, out = str(tmp_path / "files"), str(tmp_path / "out")
    files = [[("a", 1), ("b", 1), ("b", 2), (None, 5)], [("a", 9), ("c", 1), ("c", 1)], [(None, 6), ("d", 0)]]
    seen: set[str] = set()
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, "trial string, v int").coalesce(1).write.mode("append").parquet(path)
        for name in set(os.listdir(path)) - seen:
            os.utime(os.path.join(path, name), (1_700_000_000 + 100 * i,) * 2)
        seen = set(os.listdir(path))
        if i == 1:  # stopped here and started again
            live.merge_catalogue(live.read_files(spark, path, "*.parquet", per_trigger=1), ["trial"], "m", out)
    for _ in range(2):
        kept, refused = live.merge_catalogue(live.read_files(spark, path, "*.parquet", per_trigger=1), ["trial"], "m", out)
        assert {(r.trial, r.v, r.version) for r in kept.collect()} == {
            ("a", 1, 0), ("b", 1, 0), (None, 5, 0), ("c", 1, 1), ("d", 0, 2)}
        assert {(r.trial, r.v, r.reason, r.n_rows) for r in refused.collect()} == {
            ("b", 2, "trial given twice", 1), ("c", 1, "trial given twice", 1), ("a", 9, "trial already present", 1),
            (None, 6, "trial already present", 1)}


def test_a_large_stream_is_written_as_several_files_a_part(spark, monkeypatch):
    from fitlake.queries import QUERIES, SQL, load_all, streams
    from tests.compare import compare, duck
    load_all()
    monkeypatch.setattr(streams, "FILE_ROWS", 40)
    sf = "/root/testdata/sf0.001"
    con = duck(sf)
    n = con.execute("select count(*) from events").fetchone()[0]
    sizes = []
    read = streams.live.read_files
    monkeypatch.setattr(streams.live, "read_files", lambda spark, folder, *a, **k: sizes.append(
        (len(spark.read.parquet(folder).inputFiles()), k["per_trigger"])) or read(spark, folder, *a, **k))
    assert compare(QUERIES["str2_live_convergence"](spark, sf), con, SQL["str2_live_convergence"]) is None
    assert sizes[0][0] > streams.PARTS and sizes[0][1] == -(-n // (streams.PARTS * 40))

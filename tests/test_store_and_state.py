"""Series store, state of a fit, moved components, nested selectors, origins and arrays on an axis."""

import pytest
from pyspark.sql import functions as F

from fitlake.operators import fit as T
from fitlake.operators import tags as G
from fitlake.operators.ordered import CHUNK_ROWS_CONF
from fitlake.operators.series import arrays_on_axis, merge_on_axis
from fitlake.operators.traces import last_records
from fitlake.sources import catalog as C


def test_a_long_trial_spreads_over_files_and_loads_prune_them(spark, tmp_path):
    rows = spark.range(40_000).select(F.lit("long").alias("trial"), F.col("id").alias("k"), F.rand(1).alias("v"))
    rows = rows.unionByName(spark.range(300).select(
        F.concat(F.lit("t"), F.col("id") % 30).alias("trial"), F.floor(F.col("id") / 30).alias("k"), F.lit(0.5).alias("v")))
    path = str(tmp_path / "store")
    C.write_series(rows, path, by="trial", span=5000, slots=4)
    whole = C.read_series(spark, path)
    assert sorted(whole.columns) == ["k", "trial", "v"] and whole.count() == 40_300
    files = whole.select("trial", F.input_file_name().alias("f")).groupBy("trial").agg(F.count_distinct("f").alias("n"))
    spread = {r.trial: r.n for r in files.collect()}
    assert spread["long"] >= 8 and all(n == 1 for t, n in spread.items() if t != "long")
    wanted = spark.createDataFrame([("long",), ("nowhere",)], "trial string")
    part = C.read_series(spark, path, wanted, first=12_000, last=13_999)
    assert part.agg(F.count("*"), F.min("k"), F.max("k")).first()[:] == (2000, 12_000, 13_999)
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_range" in plan.split("PartitionFilters: [")[1][:400]
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(k,12000)" in plan
    near = C.read_series(spark, path, first=12_000, last=13_999)
    assert {r.f.split("_range=")[1][0] for r in near.select(F.input_file_name().alias("f")).distinct().collect()} == {"2"}
    with pytest.raises(ValueError, match="no store of series"):
        rows.write.parquet(str(tmp_path / "plain"))
        C.read_series(spark, str(tmp_path / "plain"))


@pytest.mark.parametrize("rows", ["1000000", "5"])
def test_last_records(spark, rows):
    params = spark.createDataFrame([(1, 0, "a"), (1, 10, "b"), (1, 20, None), (2, 5, "c")], "run int, step int, mu string")
    latents = spark.createDataFrame([(1, s, float(s)) for s in range(3, 40, 4)], "run int, step int, x double")
    asked = spark.createDataFrame([(1, s, i) for i in range(3) for s in (0, 2, 3, 10, 22, 99)] + [(2, 4, 7), (3, 1, 8)],
                                  "run int, step int, id int")
    spark.conf.set(CHUNK_ROWS_CONF, rows)
    try:
        got = {(r.run, r.step): (r.p and (r.p.step, r.p.mu), r.x and r.x.x) for r in last_records(
            asked, {"p": params, "x": latents}).collect()}
        n = last_records(asked, {"p": params, "x": latents}).count()
    finally:
        spark.conf.unset(CHUNK_ROWS_CONF)
    assert n == 20 and got == {
        (1, 0): ((0, "a"), None), (1, 2): ((0, "a"), None), (1, 3): ((0, "a"), 3.0), (1, 10): ((10, "b"), 7.0),
        (1, 22): ((20, None), 19.0), (1, 99): ((20, None), 39.0), (2, 4): (None, None), (3, 1): (None, None)}


def test_moved_rows_keep_what_is_mixed(spark):
    comps = spark.createDataFrame([(1, 0, 1, 2.0), (1, 1, 0, 4.0), (2, 0, 0, 1.0), (2, 1, 1, 0.5)],
                                  "set_id int, comp int, new_comp int, factor double")
    moved = T.moves(comps, 2)
    latents = spark.createDataFrame([(1, 0, 3.0), (1, 1, 5.0), (2, 0, 7.0), (2, 1, 8.0)], "set_id int, comp int, v double")
    weights = latents.withColumnRenamed("v", "w")
    assert sorted(map(tuple, T.moved_rows(latents, moved, times=["v"]).collect())) == [
        (1, 0, 20.0), (1, 1, 6.0), (2, 0, 7.0), (2, 1, 4.0)]
    assert sorted(map(tuple, T.moved_rows(weights, moved, over=["w"]).collect())) == [
        (1, 0, 1.25), (1, 1, 1.5), (2, 0, 7.0), (2, 1, 16.0)]
    arrays = spark.createDataFrame([(1, [3.0, 5.0]), (2, [7.0, 8.0])], "set_id int, v array<double>")
    assert {r.set_id: r.v for r in T.moved_arrays(arrays, moved, "v").collect()} == {1: [20.0, 6.0], 2: [7.0, 4.0]}


def test_nested_selectors(spark):
    flat = G.flat_selectors([{"a": [{"b": ("x", {"s": 1})}, {"y", "z"}]}, "w", ("v", {"s": 2}, {"t": "q"})])
    assert flat == [("a.b", ["x"], {"s": 1}), ("a", ["y", "z"], {}), ("", ["w"], {}), ("", ["v"], {"s": 2, "t": "q"})]
    items = spark.createDataFrame([(1, ["x"], None), (2, ["x", "w"], "own"), (3, ["u"], None)],
                                  "id int, tags array<string>, submodel string")
    got = [(r.nr, r.name, r.submodel, r.keywords, r.n_found) for r in G.resolve_nested(
        items, [{"a": ("x", {"s": 1})}, "w"]).orderBy("nr", "id").collect()]
    assert got == [(0, "a.1", "a", {"s": "1"}, 2), (0, "a.own.2", "a.own", {"s": "1"}, 2), (1, "own.2", "own", {}, 1)]


def test_origins(spark):
    rows = [("m/OU/OU.py", "model", "OUModel", "1", None), ("m/OU/rich.paramset", "paramset", "p", "2", ["t"]),
            ("m/WC/wc.py", "paramset", "default", "2", None), ("m/OU/priors.py", "prior", "f", "3", None),
            ("m/OU/priors.py", "prior", "g", "4", ["rich"]), ("m/_old/x.py", "model", "X", "5", None),
            ("m/.git/x.py", "objective", "y", "6", ["q"]), ("m/skip/x.py", "model", "Z", "7", None),
            ("top.py", "model", "T", "8", None)]
    items = spark.createDataFrame(rows, "path string, kind string, name string, d string, tags array<string>")
    got = {(r.kind, r.name): r.tags for r in G.collect_tagged(items, F.col("d"), skipped=["skip"]).collect()}
    assert got == {("model", "OUModel"): ["OU", "OUModel"], ("prior", "g"): ["OU", "rich"],
                   ("paramset", "default"): ["OU", "WC", "default", "rich", "t"]}


def test_arrays_on_axis(spark):
    axis = spark.createDataFrame([("t", 3, 4), ("u", 0, 2)], "trial string, first long, n_bins long")
    df = spark.createDataFrame([("t", [1.0, float("nan"), None, 4.0]), ("u", None)], "trial string, v array<double>")
    long = arrays_on_axis(df, "v", axis)
    assert sorted(map(tuple, long.collect())) == [("t", 3, 1.0), ("t", 6, 4.0)]
    other = arrays_on_axis(spark.createDataFrame([("t", [7.0, 8.0])], "trial string, v array<double>"), "v", axis)
    assert sorted(map(tuple, merge_on_axis({"a": long, "b": other}).collect())) == [("t", 3, 1.0, 7.0)]
    with pytest.raises(Exception, match="array of 3 values on an axis of 2 bins"):
        arrays_on_axis(spark.createDataFrame([("u", [1.0, 2.0, 3.0])], "trial string, v array<double>"), "v", axis).collect()

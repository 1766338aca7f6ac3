import pytest
from pyspark.sql import functions as F

from fitlake.functions import labels as L
from fitlake.operators import graphs, params, tags
from fitlake.sources import catalog as C


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_scan_directory(spark, tmp_path):
    for name in ("ann_2020-01-02_1.dat", "bob_2020-01-03_2.dat", "notes.txt"):
        (tmp_path / name).write_text("x")
    got = C.scan_directory(spark, str(tmp_path), "dat", {
        "subject": r"/([^_/]+)_[^/]*$", "session": r"_(\d+)\.dat$"}).collect()
    assert [(r["subject"], r["session"]) for r in got] == [("ann", "1"), ("bob", "2")]


def test_present_trials_are_refused(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "trial long, label string")
    assert C.add_trials(a, spark.createDataFrame([(3, "z")], a.schema), ["trial"]).count() == 3
    with pytest.raises(ValueError):
        C.add_trials(a, spark.createDataFrame([(2, "z")], a.schema), ["trial"])


def test_partitioned_series_prune(spark, tmp_path):
    df = spark.createDataFrame([(t, k, 1.0) for t in range(4) for k in range(5)], "trial long, k long, v double")
    C.write_series(df, str(tmp_path / "s"), "trial")
    wanted = spark.createDataFrame([(1,), (3,)], "trial int")
    assert C.load(spark.read.parquet(str(tmp_path / "s")), wanted, ["trial"]).count() == 10


def test_description_errors(spark):
    trials = spark.createDataFrame([("a", "f1")], "key string, filename string")
    desc = C.to_desc(trials, "mine", "Acc", ["key", "filename"])
    assert C.from_desc(desc, "mine", ["key", "filename"], trials, "filename").count() == 1
    for bad in (lambda: C.from_desc(desc, "other", ["key", "filename"]),
                lambda: C.from_desc(desc, "mine", ["key"])):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(FileNotFoundError):
        C.from_desc(desc, "mine", ["key", "filename"], trials.where("false"), "filename")


def test_metadata_must_exist_when_required(spark):
    files = spark.createDataFrame([("ann", "root/x/1"), ("ann", "root/x/2"), ("bob", "root/y")],
                                  "subject string, folder string")
    listing = spark.createDataFrame([("root/x/ann.meta",)], "path string")
    name = F.concat("subject", F.lit(".meta"))
    found = {r["subject"]: (r["metadata"], r["exists"]) for r in C.metadata_files(
        files, ["subject"], "folder", name, listing).collect()}
    assert found == {"ann": ("root/x/ann.meta", True), "bob": ("root/y/bob.meta", False)}
    with pytest.raises(FileNotFoundError):
        C.metadata_files(files, ["subject"], "folder", name, listing, required=True)


def test_tuple_strings(spark):
    assert one(spark, L.tuple_text(F.lit("(5,4)"))) == one(spark, L.tuple_text(F.lit("(5, 4)"))) == "(5, 4)"
    assert one(spark, L.tuple_text(F.lit("( 7 )"))) == "(7,)"
    assert one(spark, L.tuple_order(F.lit("(5,4)")) < L.tuple_order(F.lit("(5,10)")))
    assert not one(spark, L.tuple_text(F.lit("(5, 4)")) == L.tuple_text(F.lit("(5, 4, 3)")))


@pytest.mark.parametrize("text, want", [
    ("Status: <OptimizerStatus.NotConverged>", "Not converged"), ("not converged", "Not converged"),
    ("Status: <OptimizerStatus.Converged>", "Converged"), ("Status: <OptimizerStatus.Failed>", "Failed"),
    ("stopped", "stopped")])
def test_outcome_classes(spark, text, want):
    assert one(spark, L.outcome_class(F.lit(text))) == want


@pytest.mark.parametrize("s, want", [(0, "00s"), (64, "01m 04s"), (3600, "01h 00m 00s"),
                                     (93784, "1D 02h 03m 04s")])
def test_durations(spark, s, want):
    assert one(spark, L.duration_text(F.lit(s))) == want


def test_digest_ignores_order(spark):
    a = F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))
    b = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    assert one(spark, L.digest(a)) == one(spark, L.digest(b)) and len(one(spark, L.digest(a))) == 10


def test_deep_nesting_fails_loudly(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": {"c": 1}}, "d": 2}')], "id int, p string")
    flat = {r["path"]: r["value"] for r in params.flatten_json(df, ["id"], "p", 3).collect()}
    assert flat == {"a.b.c": "1", "d": "2"}
    with pytest.raises(Exception, match="nested deeper"):
        params.flatten_json(df, ["id"], "p", 2).collect()


def test_update_refuses_unknown_paths(spark):
    base = spark.createDataFrame([(1, "a.x", "1"), (1, "a.y", "2")], "set_id int, path string, value string")
    good = spark.createDataFrame([(1, "a.x", "9")], base.schema)
    assert sorted(r["value"] for r in params.update(base, good).collect()) == ["2", "9"]
    with pytest.raises(KeyError):
        params.update(base, spark.createDataFrame([(1, "a.z", "9")], base.schema))


def test_tag_collection(spark):
    items = spark.createDataFrame([(1, ["alpha", "contiguous"]), (2, ["num", "contiguous"]), (3, ["num"])],
                                  "id int, tags array<string>")
    ids = lambda *sel: sorted(r["id"] for r in tags.select(items, sel).collect())
    assert ids("num") == [2, 3] and ids("num", "!contiguous") == [3] and ids("contiguous", "num") == [2]
    assert tags.squeeze(tags.select(items, ["alpha"], remove=True)).first()["is_unique"]
    with pytest.raises(ValueError):
        tags.select(items, ["beta"])


def test_cycles_are_found(spark):
    line = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "src string, dst string")
    loop = line.union(spark.createDataFrame([("c", "a")], line.schema))
    unknown = line.union(spark.createDataFrame([("a", None), (None, "a")], line.schema))
    assert graphs.is_acyclic(line) and not graphs.is_acyclic(loop) and graphs.is_acyclic(unknown)
    assert graphs.is_acyclic(line.limit(0))


def test_malformed_and_empty_objects_stay(spark):
    df = spark.createDataFrame([(1, '{"a": "{oops", "b": 1, "c": {}, "d": {"e": 2}}')], "id int, p string")
    got = {r.path: r.value for r in params.flatten_json(df, ["id"], "p", 3).collect()}
    assert got == {"a": "{oops", "b": "1", "c": "{}", "d.e": "2"}


def test_long_numbers_keep_their_order(spark):
    a, b = "(" + "1" * 30 + ",)", "(2" + "0" * 29 + ",)"
    assert one(spark, L.tuple_order(F.lit(a)) < L.tuple_order(F.lit(b)))
    assert one(spark, L.tuple_order(F.lit("(007, 1)")) == L.tuple_order(F.lit("(7, 1)")))


def test_equal_ends_do_not_make_an_equal_axis(spark):
    from fitlake.operators.series import same_grid
    rows = [(1, "a", t, "s") for t in (0.0, 1.0, 4.0)] + [(1, "b", t, "s") for t in (0.0, 3.0, 4.0)]
    rows += [(2, n, t, u) for n, u in (("a", "s"), ("b", "ms")) for t in (0.0, 1.0)]
    df = spark.createDataFrame(rows, "trial int, name string, t double, unit string")
    assert {r.trial: r.consistent for r in same_grid(df, ["trial"]).collect()} == {1: False, 2: True}
    assert not any(r.consistent for r in same_grid(df, ["trial"], unit="unit").collect())


def test_frames_without_latents_are_left_out(spark):
    from fitlake.operators.runs import select_frames
    df = spark.createDataFrame([(1, "a", L.EMPTY), (2, "a", "x"), (3, "b", "x")], "run int, split string, latents string")
    with pytest.warns(UserWarning, match="nowhere"):
        got = select_frames(df, {"split": ["a"], "nowhere": [1]}, {})
    assert [r.run for r in got.collect()] == [2]
    assert select_frames(df, {"latents": [L.EMPTY]}, {}).count() == 1


def test_digest_tells_separators_and_nulls_apart(spark):
    def of(**params):
        pairs = [x for k, v in params.items() for x in (F.lit(k), F.lit(v).cast("string"))]
        return one(spark, L.digest(F.create_map(*pairs)))

    sets = [{"a": "1;b=2"}, {"a": "1", "b": "2"}, {"a": "1\\;b=2"}, {"a": None}, {"a": "\\N"}, {"a": ""}, {"a=": ""},
            {"a": "1", "b": None}, {"a": "1"}]
    assert len({of(**s) for s in sets}) == len(sets)

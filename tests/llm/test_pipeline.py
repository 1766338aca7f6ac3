"""The pipeline against plain versions of its stages, stage by stage."""

import zlib

import corpus_pipeline
from fitlake.llm import quality
from tests.llm.test_decontaminate import plain as plain_windows
from tests.llm.test_line_dedup import plain as plain_lines
from tests.llm.test_near_dedup import plain as plain_groups
from tests.llm.test_packing import best_fit

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        path = str(tmp_path / name)
        out.write.parquet(path)
        out = spark.read.parquet(path)
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        if number < 4:
            assert [c for c in out.columns] == docs.columns
            got = {r.doc_id: r.text for r in out.collect()}
        if number == 0:
            wrong = sum((d in got) != bool(labels[d]) for d, _ in rows if d in labels)
            assert wrong <= 0.05 * len(labels) and len(got) < len(rows)
        elif number == 1:
            assert got == {d: kept for d, _, _, kept in plain_lines(rows, 10, 1)}
            assert all(r.n_chars == len(r.text) for r in out.collect())
        elif number == 2:
            assert set(got) == {d for d, _, _, kept in plain_groups(rows, 5, 80) if kept}
        elif number == 3:
            assert set(got) == {d for d, t in rows if not plain_windows(t, items, 10)[1]}
        else:
            pieces = out.collect()
            assert {r.doc_id for r in pieces} == {d for d, _ in rows}
            assert len({r.sequence_id for r in pieces}) == best_fit([r.length for r in pieces], 2048)
        docs = out


def test_clashing_columns_pass_through(spark):
    df = spark.createDataFrame([(i, f"line {i}\nsame", "k", 3, "h") for i in range(12)],
                               "doc_id long, text string, kept string, n_lines int, n_hit string")
    lines = corpus_pipeline.drop_lines(spark, df, SF)
    assert lines.columns == df.columns
    assert {tuple(r)[1:] for r in lines.collect()} == {(f"line {i}", "k", 3, "h") for i in range(12)}
    clean = corpus_pipeline.clean_of_tests(spark, lines, SF)
    assert clean.columns == df.columns and clean.count() == 12


def test_remainder_is_that_of_the_text_form(spark):
    got = spark.createDataFrame([(5,), (None,)], "doc_id long").select(quality.remainder(3)).collect()
    assert [r[0] for r in got] == [zlib.crc32(b"5") % 3, zlib.crc32(b"") % 3]

"""Line deduplication: the perfect hash, the index, and whole documents."""

from collections import defaultdict

import numpy as np
import pytest

from fitlake.llm import common as K
from fitlake.llm import line_dedup as D


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_places_are_a_permutation(n):
    keys = K.mixed(np.arange(n, dtype=np.uint64), 9)
    levels = D.perfect_hash(keys)
    assert sorted(D.place(levels, keys)) == list(range(n))
    other = K.mixed(np.arange(n, dtype=np.uint64), 10)
    at = D.place(levels, other)
    assert ((at >= -1) & (at < max(n, 1))).all()


def test_repeated_keys_are_refused():
    with pytest.raises(ValueError):
        D.perfect_hash(np.array([5, 5], np.uint64))


def plain(rows, least, chars):
    blank = " \t\n\x0b\f\r"
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(blank))
    seen = defaultdict(int)
    for _, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            seen[k] += 1
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(key(x)) < chars or seen[key(x)] < least]
        out.append((doc, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


ROWS = [(i, f"Shared line \nonly {i}\n\n\tSHARED LINE \nÉa") for i in range(12)] + [
    (20, None), (21, ""), (22, "\n\n"), (None, "shared line"), (None, "shared line"), (23, "\x0bÉA\r\nx" * 300),
    (24, "z\n" * 2000), (25, "shared  line")] + [(30, "dup\ndup\nsame")] * 4


@pytest.mark.parametrize("least,chars", [(10, 1), (2, 1), (3, 5), (1, 1)])
def test_documents(spark, least, chars):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "'x' AS kept", "1 AS block")
    out = D.dedup_lines(df, min_chars=chars, min_docs=least)
    assert out.columns == ["doc_id", "text", "block", "n_lines", "n_dropped", "kept"]
    got = sorted((tuple(r) for r in out.select("doc_id", "n_lines", "n_dropped", "kept").collect()), key=str)
    assert got == plain(ROWS, least, chars)


def test_empty_table(spark):
    assert D.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []

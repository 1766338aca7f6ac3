"""Decontamination against a plain search of word windows."""

import random
import re

import pytest

from fitlake.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def plain(text, items, size):
    words = list(WORD.finditer(fold(text)))
    own = [w[0] for w in words]
    hit, ids = [False] * len(own), set()
    for item, body in items:
        cut = WORD.findall(fold(body))
        for i in range(max(1, len(cut) - size + 1) if cut else 0):
            window = cut[i:i + size]
            for j in range(len(own) - len(window) + 1):
                if own[j:j + len(window)] == window:
                    hit[j:j + len(window)] = [True] * len(window)
                    if item is not None:
                        ids.add(str(item))
    spans, at = [], 0
    while at < len(hit):
        if hit[at]:
            end = at
            while end + 1 < len(hit) and hit[end + 1]:
                end += 1
            spans.append((words[at].start(), words[end].end()))
            at = end
        at += 1
    return len(own), sum(hit), spans, sorted(ids)


def fixture():
    rng = random.Random(2)
    some = ["a", "B", "été", "x1", "日本", "the"]
    items = [(i, " ".join(rng.choice(some) for _ in range(rng.randint(3, 9)))) for i in range(12)]
    items += [(12, "..."), (13, None), (14, ""), (None, "zz yy xx"), (3, "qq rr"), (3, "qq rr"), (15, "solo")]
    docs = [(i, " , ".join(rng.choice(some) for _ in range(rng.randint(0, 80)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "—Été a­b"), (103, "Zz-yy;XX solo"), (103, "Zz-yy;XX solo"),
             (None, "QQ\nrr!"), (104, "solo " * 5000)]
    return docs, items


@pytest.mark.parametrize("windows", [400_000, 7])
def test_windows(spark, monkeypatch, windows):
    """One automaton, and several passes, find what a plain search finds."""
    monkeypatch.setattr(D, "AUTOMATON_WINDOWS", windows)
    docs, items = fixture()
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "7 AS n_hit", "'t' AS lang")
    out = D.scan(df, spark.createDataFrame(items, "item_id long, text string"), window=4, item_bytes=40)
    assert out.columns == ["doc_id", "text", "lang", *D.ADDED]
    got = sorted(((r.doc_id, r.n_words, r.n_hit, [tuple(s) for s in r.spans], r["items"], r.contaminated)
                  for r in out.collect()), key=str)
    want = []
    for doc, text in docs:
        n, hit, spans, ids = plain(text, items, 4)
        want.append((doc, n, hit, spans, ids, hit > 0))
    assert got == sorted(want, key=str)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in D.scan(docs, none).collect()] == [False]
    assert D.scan(docs.limit(0), none).collect() == []

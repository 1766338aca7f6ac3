"""Ranked lexical search against a plain version."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fitlake.llm import lexical as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string"
FOLD = str.maketrans({c: c.lower() for c in map(chr, range(65, 91))})


def plain_terms(text):
    return TERM.findall((text or "").translate(FOLD))


def plain(docs, items, k=10):
    cut = [(i, Counter(plain_terms(t))) for i, t in docs]
    n_docs, total = sum(1 for _, c in cut if c), sum(sum(c.values()) for _, c in cut)
    df = Counter(t for _, c in cut for t in c)
    out = []
    for item, text in items:
        rows = []
        for i, c in cut:
            m = 10 + 90 * sum(c.values()) * n_docs // total if c else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(plain_terms(text)) if t in c)
            if score > 0:
                rows.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(rows)[:k])]
    return Counter(out)


def got(spark, docs, items, **kw):
    df = L.search(spark.createDataFrame(docs, SCHEMA + ", bag string, row int").drop("x"),
                  spark.createDataFrame(items, "item_id long, text string"), **kw)
    return Counter(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


@given(st.text(alphabet="aZ09 \n\t.-_éß漢İ \x00\x7f@[`{", max_size=40))
@settings(max_examples=300, deadline=None)
def test_terms(text):
    assert [t.decode() for t in L.terms(text)] == plain_terms(text)


WORDS = "Sun moon, star x9 Été 漢字 the THE the of a_b of sky sea".split()


def table(n=300, seed=5):
    gen = np.random.default_rng(seed)
    docs = [(int(i), " ".join(gen.choice(WORDS, int(gen.integers(0, 25))))) for i in gen.permutation(n)]
    docs += [(n + i, "the moon the copy") for i in range(60)] + [(None, "the moon the copy"), (None, None), (5, "")]
    docs += [(5, "moon star"), (5, "moon star"), (None, "sun sun sun"), (4000, "sun " * 50_000 + "rare")]
    return docs


ITEMS = [(1, "the moon"), (2, "sun of Star, star"), (3, "rare 漢字"), (4, "nowhere"), (5, None), (5, ""),
         (6, "copy"), (6, "copy"), (None, "x9 été"), (7, "a b"), (8, "e" * 200 + " sky")]


@pytest.mark.parametrize("part_terms", [None, 3])
def test_against_plain(spark, part_terms):
    docs = table() + [(9000, "e" * 200)]
    rows = [(i, t, "own", 1) for i, t in docs]
    assert got(spark, rows, ITEMS, part_terms=part_terms) == plain(docs, ITEMS)


def test_blocks_and_large_classes(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_POSTINGS", 7)
    docs = [(i, "one two" if i % 3 else "two") for i in range(500)] + [(1000 + i, f"one w{i}") for i in range(200)]
    items = [(1, "one"), (2, "two"), (3, "one two"), (4, "w7 w9")]
    assert got(spark, [(i, t, "", 0) for i, t in docs], items, k=25) == plain(docs, items, 25)


def test_exact_sums():
    values = np.array([(1 << 52) + 1, (1 << 52) + 3, 5, 1 << 40], np.int64)
    assert L.class_scores(values, np.array([0, 0, 0, 2]), 3).tolist() == [(1 << 53) + 9, 0, 1 << 40]


def test_empty_tables(spark):
    rows = [(1, "a", "", 0)]
    assert not got(spark, [], ITEMS) and not got(spark, rows, [])
    assert not got(spark, [(1, None, "", 0), (2, " .", "", 0)], ITEMS) and not got(spark, rows, [(1, None)])

"""Language model: gradients, whole documents, base scores and held-out gain."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fitlake.llm import gru, lm_scoring


def documents(seed=0, n=7):
    rng = np.random.default_rng(seed)
    return [rng.integers(0, 100 + gru.KINDS, rng.integers(1, 40)).astype(np.int32) for _ in range(n)]


def test_state_runs_through_a_document_and_not_between():
    shape, docs = gru.Shape(100), documents()
    flat = gru.initial(shape) * 3
    together = gru.score(shape, flat, docs, width=3, window=5)
    alone = [gru.score(shape, flat, [d], width=1, window=64)[0] for d in docs]
    assert np.allclose(together, alone, atol=1e-3)


def test_probabilities_sum_to_one():
    shape = gru.Shape(100)
    flat = gru.initial(shape)
    total = sum(math.exp(gru.score(shape, flat, [np.array([5, t], np.int32)])[0]
                         - gru.score(shape, flat, [np.array([5], np.int32)])[0]) for t in range(100 + gru.KINDS))
    assert abs(total - 1) < 1e-4


def test_training_follows_the_gradient():
    """One small step lowers the loss by the squared gradient's share, measured by differences."""
    shape, docs = gru.Shape(70), documents(1)
    docs = [np.minimum(d, 69 + gru.KINDS) for d in docs]
    flat = gru.initial(shape)
    loss = lambda w: -sum(gru.score(shape, w, docs))
    new, seen = gru.train(shape, flat, docs, 0.01, width=3, window=8, rounds=20)
    assert seen == sum(map(len, docs)) and loss(new) < 0.8 * loss(flat)


def tokens(text):
    blank = " \t\n\x0b\f\r"
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in "".join(" " if c in blank else c for c in low).split(" ") if w] + [""]


def test_documents_of_every_kind(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["the", "Cat", "sat", "été", "on\tmats.", f"w{i}"]) for _ in range(rng.randint(0, 60))))
            for i in range(120)] + [(200, None), (201, ""), (202, "the " * 5000), (None, "the cat"), (7, "again"), (7, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 AS score")
    out, total = lm_scoring.score(df, carry=["doc_id", "text"])
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    count = Counter(w for d, t in rows if not held(d) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    got = out.collect()
    assert total == n and len(got) == len(rows)
    for r in got:
        own = tokens(r.text)
        assert (r.n_tokens, r.n_known) == (len(own), sum(count[w] > 0 for w in own))
        assert abs(r.base_score - sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)) < 1e-6 * len(own)
        assert -1e6 < r.score < 0


def test_held_out_texts_gain(spark):
    from fitlake.llm.queries import QUERIES

    rows = QUERIES["op8_gru_lm_scores"](spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r.held_out]
    base, own = (sum(getattr(r, c) for r in held) / sum(r.n_tokens for r in held) for c in ("base_score", "score"))
    assert len(rows) == 1000 and own > base + 0.2


@pytest.mark.parametrize("rows", [[], [(1, "a b")]])
def test_few_rows(spark, rows):
    out, _ = lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out.count() == len(rows)


def plain_kind(word):
    if any(0x30 <= b <= 0x39 for b in word):
        return gru.KINDS - 1
    pairs = {word[i] << 8 | word[i + 1] for i in range(len(word) - 1)}
    script = next((s + 1 for s, own in enumerate(gru._SCRIPTS) if pairs & own), 0)
    last = word[-1] if word else 0x61
    mark = 0 if 0x61 <= last <= 0x7A or last >= 0x80 else 1 if last in b".," else 2
    return (script * 3 + mark) * 2 + (len(word) > 6)


def test_kinds_are_those_of_single_words():
    rng = random.Random(2)
    words = [b"", b"a", b"\xc3", "é".encode(), "ñandú.".encode(), b"x" * 7, b"7", b"a!", "größe,".encode(), b"\x00"]
    words += ["".join(rng.choice("abz09.,!éñöß\0") for _ in range(rng.randint(0, 9))).encode() for _ in range(3000)]
    for own in (words, words[:1], [], [b"", b""]):
        assert gru.kinds_of(own).tolist() == [plain_kind(w) for w in own]


def test_one_very_long_text_takes_memory_by_its_tokens():
    """A million tokens beside short texts: no lane is padded, and the state runs through the whole text."""
    rng = np.random.default_rng(3)
    long = rng.integers(0, 100, 1_000_000).astype(np.int32)
    docs = [long, *(rng.integers(0, 100, 30).astype(np.int32) for _ in range(2000))]
    s = gru.Streams.of(docs, 200, 512)
    total = sum(map(len, docs))
    assert len(s.token) == len(s.source) == total and s.steps == len(long)
    assert sorted(s.place[:5].tolist() + s.place[-5:].tolist())[-1] < total and len(np.unique(s.place)) == total
    assert s.token[np.argsort(s.place)].tolist() == np.concatenate(docs).tolist()
    shape = gru.Shape(100)
    flat = gru.initial(shape) * 3
    part = [long[:3000], *docs[1:40]]
    assert np.allclose(gru.score(shape, flat, part), [gru.score(shape, flat, [d])[0] for d in part], rtol=1e-4)


def test_counts_are_the_start_of_the_network():
    shape = gru.Shape(70)
    counts = np.arange(1, 71 + gru.KINDS - 1 + 1)[:70 + gru.KINDS].astype(float)
    flat = gru.initial(shape, counts=counts)
    gru.unpack(shape, flat)["x"][...] = 0
    got = np.array([gru.score(shape, flat, [np.array([t], np.int32)])[0] for t in range(70 + gru.KINDS)])
    assert np.allclose(got, np.log((counts + 0.5) / (counts + 0.5).sum()), atol=2e-2)


def test_every_training_document_is_learnt_from_once(spark):
    """The rounds part the training documents, and no sample stands in for them."""
    rows = [(i, f"w{i} a b") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    average = lm_scoring._averaged

    def spy(got, weights):
        got = got.collect()
        seen.append(sum(r.seen for r in got if r.part == 0))
        return weights

    try:
        lm_scoring._averaged = spy
        _, total = lm_scoring.score(df)
    finally:
        lm_scoring._averaged = average
    assert len(seen) == len(lm_scoring.RATES) and sum(seen) == total


def test_tokens_are_words_and_ends():
    """White space at the edges gives no word, other blanks part none, and equal words share a number over all chunks."""
    rng = random.Random(6)
    texts = [None, "", " ", " a", "b ", "A\x1cB c", "É Ab\x85", " \x0b\x0c\r\n\t"]
    texts += ["".join(rng.choice(" \t\n\x0b\x0c\r\x1c\x1f\x85\xa0 AbÉé9.") for _ in range(rng.randint(0, 20))) for _ in range(300)]
    whole = pa.array(texts, pa.string())
    bad = pa.Array.from_buffers(pa.string(), 1, [None, pa.py_buffer(np.array([0, 4], np.int32)), pa.py_buffer(b"A \xffB")])
    for column in (whole, whole[3:9], pa.chunked_array([whole[:7], whole[7:]]), whole[:0], pa.chunked_array([], pa.string())):
        words, ids, lengths = lm_scoring.tokens_of(column)
        own = [[words[i].decode() for i in d] for d in lm_scoring._by_text(ids, lengths)]
        assert own == [tokens(t) for t in column.to_pylist()] and len(set(words)) == len(words)
    assert lm_scoring.tokens_of(bad)[0] == [b"a", b"\xffb", b""]


def test_a_few_long_lanes_are_not_scored_in_small_windows(monkeypatch):
    """Work per window is not paid every 32 steps where only one lane is left."""
    sizes, outputs = [], gru._outputs
    monkeypatch.setattr(gru, "_outputs", lambda *a: sizes.append(len(a[3])) or outputs(*a))
    shape, docs = gru.Shape(100), [np.arange(20_000, dtype=np.int32) % 100, *documents()]
    gru.score(shape, gru.initial(shape), docs)
    assert len(sizes) < 10 and sum(sizes) == sum(map(len, docs)) and max(sizes) < 10_000


def test_slopes_where_lanes_end_within_a_window():
    """The first step of training goes against the slope found by differences, for every kind of weight."""
    shape = gru.Shape(100)
    docs = [d[:n] for d, n in zip(documents(5, 9), (1, 3, 30, 8, 8, 20, 2, 31, 5))]
    flat = gru.initial(shape) * 3
    new, _ = gru.train(shape, flat, docs, 1e-3, width=6, window=64)
    loss = lambda w: -sum(gru.score(shape, w.astype(np.float32), docs)) / sum(map(len, docs))
    at, seen = 0, 0
    rng = np.random.default_rng(8)
    for size in shape.arrays().values():
        n = int(np.prod(size))
        for i in rng.choice(np.arange(at, at + n), min(n, 60), replace=False):
            step = np.zeros(len(flat))
            step[i] = 0.01
            slope = (loss(flat + step) - loss(flat - step)) / 0.02
            if abs(slope) > 3e-4:
                seen += 1
                assert np.sign(new[i] - flat[i]) == -np.sign(slope)
        at += n
    assert seen > 60


def test_softmax_without_its_largest_entry(monkeypatch):
    """It is left out only where weights exclude an overflow, and changes no score."""
    shape, docs = gru.Shape(100), documents()
    plain, huge = gru.initial(shape) * 3, gru.initial(shape) * 3000
    assert all(map(gru._small, gru._heads(gru.unpack(shape, plain))))
    assert not any(map(gru._small, gru._heads(gru.unpack(shape, huge))))
    own = gru.score(shape, plain, docs)
    assert np.isfinite(gru.score(shape, huge, docs)).all()
    monkeypatch.setattr(gru, "_small", lambda weights: False)
    assert np.allclose(own, gru.score(shape, plain, docs), rtol=1e-5)

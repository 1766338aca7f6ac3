"""Best-fit packing: tokens, places and the number of sequences."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from fitlake.llm import packing as P


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.tokenizer_path())


ODD = ["", " ", "a", "It's  the\tlast word.\r\n\nNew  line", "ÀÉ é ñ", "<|endoftext|> x<|startoftext|>", "日本語 テスト",
       "I'll we'd 12345 !!?? a_b", " x　y", "ΑΣ ΣΑΣ", "x" * 5000, "İstanbul ŉ"]


def test_ids_by_words_are_those_of_whole_texts(tokenizer, monkeypatch):
    monkeypatch.setattr(P, "CACHE_WORDS", 5)
    texts = ODD + [" ".join(ODD[3:9])]
    for got, text in zip(P.encode(texts, P.tokenizer_path()), texts):
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def best_fit(sizes, capacity):
    """Plain best-fit decreasing: the number of sequences."""
    gaps = []
    for size in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= size]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - size)
        else:
            gaps.append(capacity - size)
    return len(gaps)


@pytest.mark.parametrize("seed", range(8))
def test_runs_are_best_fit_decreasing(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([64, rng.randint(1, 64), rng.randint(1, 8)]) for _ in range(400)]
    counts = {s: sizes.count(s) for s in set(sizes)}
    runs = P.fill_runs(counts, 64)
    place, seen = defaultdict(list), defaultdict(set)
    by_size = {s: runs[runs[:, 0] == s] for s in counts}
    for s, n in counts.items():
        own = by_size[s][np.argsort(by_size[s][:, 1])]
        for rank in range(n):
            r = own[np.searchsorted(own[:, 1], rank, "right") - 1]
            step = rank - r[1]
            place[int(r[2] + step // r[3])].append((int(r[4] + step % r[3] * s), s))
    for parts in place.values():
        at = 0
        for begin, size in sorted(parts):
            assert begin == at
            at += size
        assert at <= 64
    assert sum(map(len, place.values())) == 400
    assert len(place) == best_fit(sizes, 64)
    assert not seen


def check(rows, texts, tokenizer, size):
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(docs[doc], key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(ids), size)) and [r.piece for r in own] == list(range(len(own)))
        for r in own:
            part = ids[r.start:r.start + size]
            assert r.length == len(part) and r.ids_crc32 == zlib.crc32(part.tobytes())
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    assert len(sequences) == best_fit([r.length for r in rows], size)


def test_pieces_are_placed_whole(spark, tokenizer):
    rng = random.Random(1)
    texts = {i: t for i, t in enumerate(ODD)} | {50: None, 51: "a", 52: "a"}
    texts |= {100 + i: " ".join(rng.choice(["the", "house", "von", "zzzz"]) for _ in range(rng.randint(1, 90)))
              for i in range(150)}
    df = spark.createDataFrame([(i, t, 7) for i, t in texts.items()], "doc_id long, text string, length int")
    check(P.pack(df, size=64).collect(), texts, tokenizer, 64)


def test_repeated_and_missing_ids_keep_all_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (None, "x")], "doc_id int, text string")
    rows = P.pack(df, size=8, keep_ids=True).collect()
    assert len(rows) == 4 and sum(r.length for r in rows) == 3 + 3 + 1 + 2
    assert all(len(r.ids) == 4 * r.length for r in rows) and len({r.sequence_id for r in rows}) == 2


def test_empty_table(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_on_whole_table(spark, tokenizer):
    from fitlake.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check(QUERIES["op7_best_fit_packing"](spark, sf).collect(), texts, tokenizer, 2048)

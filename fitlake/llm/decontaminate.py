"""Benchmark decontamination with one automaton over the word windows of all test items.

The items' windows of consecutive words form one Aho-Corasick automaton over word numbers, so a
document is read once, whatever the number of items, and matches give word positions that map back
to code points of the original text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitlake.llm import common as K
from fitlake.session import written

ADDED = ("n_words", "n_hit", "spans", "items", "contaminated")
ADDED_DDL = ("n_words long, n_hit long, spans array<struct<start:long,end:long>>, items array<string>, "
             "contaminated boolean")
#: Windows in one automaton (some 10 nodes each); more are searched in further passes.
AUTOMATON_WINDOWS = 400_000
#: Bytes of test text that the driver takes to cut into windows at a time.
ITEM_BYTES = 32 << 20
#: Lower-case letters, digits and every byte of a non-ASCII character stay, all else is a blank.
FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20
             for b in range(256))
_BUILT: dict[int, tuple] = {}


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def windows_of(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    """Runs of ``size`` consecutive words; fewer words, but not none, are one window."""
    if not words:
        return []
    return [tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]


def _automaton(windows: dict[tuple[bytes, ...], list[str]], token: int) -> tuple:
    """The automaton, the numbers of words, and windows' items; built once in a worker."""
    if token not in _BUILT:
        import ahocorasick

        _BUILT.clear()
        numbers: dict[bytes, int] = {}
        auto = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, items in windows.items():
            auto.add_word(tuple(numbers.setdefault(w, len(numbers) + 1) for w in window), (len(window), items))
        auto.make_automaton()
        _BUILT[token] = (auto, numbers)
    return _BUILT[token]


def spans_of(text: bytes, hit: np.ndarray) -> list[dict]:
    """Runs of hit words as code points of the text, end exclusive."""
    at = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(FOLD))]
    edge = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0]))
    out, done, points = [], 0, 0
    for first, end in zip(edge[::2], edge[1::2]):
        begin, stop = at[first][0], at[end - 1][1]
        points += len(text[done:begin].decode("utf-8", "replace"))
        length = len(text[begin:stop].decode("utf-8", "replace"))
        out.append({"start": points, "end": points + length})
        points, done = points + length, stop
    return out


def _scan(windows: dict, names: list[str], token: int, again: bool):
    def run(batches):
        K.cache("automaton", dict)  # caches of earlier stages go
        auto, numbers = _automaton(windows, token)
        number = numbers.get
        for batch in batches:
            earlier = batch.column("__hit").to_pylist() if again else [None] * batch.num_rows
            named = batch.column("items").to_pylist() if again else [None] * batch.num_rows
            n_words, n_hit, spans, items, packed = [], [], [], [], []
            for text, before, known in zip(K.as_bytes(batch.column("text")), earlier, named):
                words = words_of(text)
                hit, own = None, set(known or ())
                if before is not None:
                    hit = np.unpackbits(np.frombuffer(before, np.uint8), count=len(words)).astype(bool)
                if len(words) and len(numbers):
                    marks = None
                    for last, (size, ids) in auto.iter(tuple([number(w, 0) for w in words])):
                        if marks is None:
                            marks = np.zeros(len(words) + 1, np.int64)
                        marks[last - size + 1] += 1
                        marks[last + 1] -= 1
                        own.update(ids)
                    if marks is not None:
                        new = np.cumsum(marks[:-1]) > 0
                        hit = new if hit is None else hit | new
                n_words.append(len(words))
                n_hit.append(0 if hit is None else int(hit.sum()))
                spans.append([] if hit is None else spans_of(text, hit))
                items.append(sorted(own))
                packed.append(None if hit is None else np.packbits(hit).tobytes())
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            new = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(spans, span),
                   pa.array(items, pa.list_(pa.string())), pa.array([n > 0 for n in n_hit], pa.bool_()),
                   pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + new,
                                             names=[*names, *ADDED, "__hit"])

    return run


def item_windows(benchmark: DataFrame, size: int, item_bytes: int) -> list[dict[tuple[bytes, ...], list[str]]]:
    """Windows with their items' ids, in parts that one automaton holds.

    The items come to the driver in parts of about ``item_bytes``, chosen by a hash of the text, so
    what it holds at a time is bounded however many items there are.
    """
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("text IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // item_bytes))
    out: list[dict] = []
    current: dict[tuple[bytes, ...], set] = {}
    for part in range(parts):
        chosen = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part)
        for item, text in chosen.collect():
            for window in windows_of(words_of(text.encode()), size):
                current.setdefault(window, set()).update([] if item is None else [item])
            if len(current) >= AUTOMATON_WINDOWS:
                out.append(current)
                current = {}
    if current or not out:
        out.append(current)
    return [{w: sorted(ids) for w, ids in part.items()} for part in out]


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 10, carry: list[str] | None = None,
         item_bytes: int = ITEM_BYTES) -> DataFrame:
    """Mark in every document the words that lie inside an occurrence of a test item's window.

    Words are runs of digits, ASCII letters (lower-cased) and non-ASCII characters. Returns the columns
    ``carry`` of ``docs`` (all by default; those named like an added one are replaced) with
    ``n_words``, ``n_hit``, ``spans`` (runs of hit words as code points of the original text, end
    exclusive), ``items`` (ids of items with occurring windows, as strings, sorted) and ``contaminated``.

    A null or empty text has no words and is never hit. Items without words match nothing; an item
    without id marks words but is not listed; repeated items count once. An empty benchmark leaves
    every document clean.
    """
    names = [c for c in (carry or docs.columns) if c.lower() not in ADDED and c != "__hit"]
    parts = item_windows(benchmark, window, item_bytes)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*names).schema)
    out = docs
    for number, windows in enumerate(parts):
        last = number == len(parts) - 1
        hold = names if last or "text" in names else [*names, "text"]
        kinds = schema if hold is names else f"{schema}`text` string, "
        token = hash((number, len(windows), next(iter(windows), None), id(windows)))
        out = out.select(*dict.fromkeys([*names, "text"]), *(["items", "__hit"] if number else [])).mapInArrow(
            _scan(windows, hold, token, number > 0), f"{kinds}{ADDED_DDL}, __hit binary")
        if not last:
            out = written(out, "windows")
    return out.drop("__hit")

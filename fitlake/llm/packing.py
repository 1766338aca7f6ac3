"""Best-fit packing of token sequences in bulk-synchronous steps over equal sizes.

Lengths are whole numbers up to the sequence length, so the documents, sorted by size, are at most
that many runs of equal documents, and the open sequences, sorted by gap, runs of equal gaps. Each
step takes the largest unplaced size, sweeps the gaps upwards from it (successor by successor),
lets the documents of the run fill them by rank, and updates the gaps; when no gap is wide enough,
it opens as many sequences as the rest of the run needs. The steps need the counts per size only (never the
documents), and give a table of rank intervals of a size that does not grow with the corpus. The
documents are ranked within their size by a distributed sort and take their place by one search in
that table.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fitlake.llm import common as K
from fitlake.session import written

#: Words in a worker's cache of token ids; beyond that, those not met since the last turn are forgotten.
CACHE_WORDS = 500_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
class _Ids(dict):
    """Token ids of words, as little-endian unsigned 32-bit numbers; each distinct word is encoded once."""

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.old = Tokenizer.from_file(path), {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = ids
        return ids

    def turn(self) -> None:
        if len(self) > CACHE_WORDS:
            self.old = dict(self)
            self.clear()


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(texts: list[str], path: str) -> list[bytes]:
    """Token ids of each text as little-endian unsigned 32-bit numbers.

    The vocabulary never crosses white space, so texts are encoded blank by blank and each distinct
    word once; a word that holds other kinds of white space is left to the tokenizer as it is.
    """
    cache = K.cache(("token ids", path), lambda: _Ids(path))
    cache.turn()
    return [b"".join(map(cache.__getitem__, t.replace("\n", " ").split(" "))) for t in texts]


def _pieces(path: str, size: int, keep_ids: bool):
    width = 4 * size

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows: list[tuple] = []
                ids = encode([t or "" for t in batch.column("text").to_pylist()], path)
                for doc, body in zip(batch.column("doc_id").to_pylist(), ids):
                    body += bytes(4)
                    for number, begin in enumerate(range(0, len(body), width)):
                        part = body[begin:begin + width]
                        rows.append((doc, number, begin // 4, len(part) // 4, zlib.crc32(part), part))
                columns = list(zip(*rows)) or [()] * 6
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                n = 6 if keep_ids else 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[:n], kinds)], names[:n])

    return run


def pieces(docs: DataFrame, size: int, path: str, keep_ids: bool = False) -> DataFrame:
    """Token pieces of at most ``size``: the text's ids, then id 0, cut only where they are longer."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _pieces(path, size, keep_ids), PIECES + (", ids binary" if keep_ids else ""))


def fill_runs(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rank intervals of the packing: (size, first rank, first sequence, per sequence, offset) a row.

    Documents of a size with ranks from ``first rank`` on fill, ``per sequence`` each, the sequences
    from ``first sequence`` on, beginning at ``offset``.
    """
    open_: dict[int, deque] = defaultdict(deque)
    widths: list[int] = []
    rows: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def gap_of(width: int, first: int, n: int) -> None:
        if width and n:
            if not open_[width]:
                bisect.insort(widths, width)
            open_[width].append((first, n))

    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            at = bisect.bisect_left(widths, size)
            if at == len(widths):
                opened = -(-left // (capacity // size))
                gap_of(capacity, sequences, opened)
                sequences += opened
                continue
            gap = widths[at]
            first, n = open_[gap].popleft()
            if not open_[gap]:
                widths.pop(at)
            per = gap // size
            full = min(n, left // per)
            if full:
                rows.append((size, rank, first, per, capacity - gap))
                gap_of(gap - per * size, first, full)
                rank, left = rank + full * per, left - full * per
            if full < n and left:
                rows.append((size, rank, first + full, per, capacity - gap))
                gap_of(gap - left * size, first + full, 1)
                full, left = full + 1, 0
            gap_of(gap, first + full, n - full)
    return np.array(rows, np.int64).reshape(-1, 5)


def _assign(runs: np.ndarray):
    key = (runs[:, 0] << 44) + runs[:, 1]
    order = np.argsort(key, kind="stable")
    key, runs = key[order], runs[order]

    def run(batches):
        for batch in batches:
            size, rank = (batch.column(n).to_numpy() for n in ("length", "rank"))
            own = runs[np.searchsorted(key, (size << 44) + rank, side="right") - 1]
            step = rank - own[:, 1]
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names]
                + [pa.array(own[:, 2] + step // own[:, 3], pa.int64()),
                   pa.array(own[:, 4] + step % own[:, 3] * size, pa.int64())], [*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, size: int = 2048, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Pack all documents into as few sequences of at most ``size`` tokens as best fit needs.

    A row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, with the ids
    themselves where ``keep_ids`` is set. Pieces of a document longer than a sequence are full but for the last.

    A null or empty text is the end token alone. Repeated rows are packed as documents of their own, and a
    null doc_id stays null. Equal sizes are placed in order of (doc_id, piece, checksum). Other columns
    of ``docs`` are not read. An empty table gives no rows.
    """
    cut = written(pieces(docs, size, path or tokenizer_path(), keep_ids), "pieces")
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most ``size`` rows
    # a run of n equal pieces is ranked in some sqrt(n) / 8 groups of 8 sqrt(n) pieces
    groups = [int(-(-counts.get(s, 0) ** 0.5 // 8)) or 1 for s in range(size + 1)]
    dealt = cut.withColumn("part", F.pmod(
        F.xxhash64("doc_id", "piece", "ids_crc32"),
        F.element_at(F.lit(groups), (F.col("length") + 1).cast("int"))).cast("int"))
    sums = dealt.groupBy("length", "part").count()
    by_size = Window.partitionBy("length").orderBy("part")
    before = sums.select("length", "part", (F.sum("count").over(by_size) - F.col("count")).alias("before"))
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (dealt.join(before, ["length", "part"])
              .withColumn("rank", F.col("before") + F.row_number().over(inside) - 1)
              .select(*cut.columns, "rank"))
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.mapInArrow(_assign(fill_runs(counts, size)), f"{out}, sequence_id long, offset long")

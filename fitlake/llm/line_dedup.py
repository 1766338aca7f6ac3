"""Line deduplication through a sharded minimal perfect hash over the distinct line hashes.

One scan turns every document into the 64-bit hashes of its distinct line keys. Their document
counts are cut into shards by hash; each shard becomes one row of the index: the bit levels of a
minimal perfect hash, a 16-bit fingerprint and a saturating count per key. Blocks of documents then
probe the shards with packed hashes, get back the frequent ones, and drop their lines. Only 8-byte
hashes travel for the index and the probes; texts are dealt once, to their block.

Every distinct line is indexed, so a probe always meets its own key and the answer is exact but for
equal 64-bit hashes of different lines (about n*n / 2**65 for n distinct lines).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitlake.llm import common as K
from fitlake.session import written

BLANK = b" \t\n\x0b\f\r"
ADDED = ("n_lines", "n_dropped", "kept")
#: Keys of a shard of the index, about.
SHARD_KEYS = 200_000
INDEX = "shard int, n_keys long, level_bits array<long>, bits binary, fingerprints binary, counts binary"


def lines_of(text: bytes | None) -> tuple[list[bytes], list[bytes]]:
    """Lines of a text and their keys: blanks stripped at both ends, A-Z lower-cased."""
    lines = (text or b"").split(b"\n")
    return lines, [line.strip(BLANK).lower() for line in lines]


def _hash(key: bytes) -> int:
    return xxhash.xxh3_64_intdigest(key)


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (least <= 1 or len(key.decode("utf-8", "replace")) >= least)


# minimal perfect hash of a shard --------------------------------------------------------------

def perfect_hash(keys: np.ndarray) -> list[np.ndarray]:
    """Bit levels of a minimal perfect hash: a key takes the first level where it is alone."""
    levels: list[np.ndarray] = []
    rest = np.asarray(keys, dtype=np.uint64)
    while len(rest):
        size = max(64, 2 * len(rest))
        at = K.mixed(rest, len(levels) + 1) % np.uint64(size)
        alone = np.bincount(at.astype(np.int64), minlength=size) == 1
        levels.append(alone)
        rest = rest[~alone[at]]
        if len(levels) > 200:
            raise ValueError("the keys of a perfect hash must be distinct")
    return levels


def place(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Place of each key, from 0 to n - 1; -1 for a key that no level holds."""
    out = np.full(len(keys), -1, dtype=np.int64)
    open_ = np.arange(len(keys))
    before = 0
    for number, bits in enumerate(levels):
        at = (K.mixed(keys[open_], number + 1) % np.uint64(len(bits))).astype(np.int64)
        hit = bits[at]
        rank = np.cumsum(bits) - 1
        out[open_[hit]] = before + rank[at[hit]]
        before += int(rank[-1]) + 1
        open_ = open_[~hit]
    return out


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (K.mixed(keys, 0) >> np.uint64(48)).astype("<u2")


def _shard_row(top: int):
    kind = np.min_scalar_type(top)

    def build(key, group):
        keys = K.unsigned(group["h"].to_numpy())
        counts = np.minimum(group["n"].to_numpy(), top)
        levels = perfect_hash(keys)
        at = place(levels, keys)
        prints, stored = np.zeros(len(keys), "<u2"), np.zeros(len(keys), kind)
        prints[at], stored[at] = _fingerprint(keys), counts
        packed = b"".join(np.packbits(b, bitorder="little").tobytes() for b in levels)
        return pa.table({
            "shard": pa.array([key[0].as_py()], pa.int32()), "n_keys": pa.array([len(keys)], pa.int64()),
            "level_bits": pa.array([[len(b) for b in levels]], pa.list_(pa.int64())),
            "bits": pa.array([packed], pa.binary()), "fingerprints": pa.array([prints.tobytes()], pa.binary()),
            "counts": pa.array([stored.tobytes()], pa.binary())})

    return build


def _opened(row: dict, kind: np.dtype) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    levels, at = [], 0
    raw = np.frombuffer(row["bits"], np.uint8)
    for size in row["level_bits"]:
        n = -(-size // 8)
        levels.append(np.unpackbits(raw[at:at + n], bitorder="little", count=size).astype(bool))
        at += n
    return levels, np.frombuffer(row["fingerprints"], "<u2"), np.frombuffer(row["counts"], kind)


def build_index(counts: DataFrame, shards: int, top: int) -> DataFrame:
    """Index rows, one per shard, from distinct hashes ``h`` with their counts ``n``."""
    return (counts.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
            .groupBy("shard").applyInArrow(_shard_row(top), INDEX))


def probe(requests: DataFrame, index: DataFrame, shards: int, least: int) -> DataFrame:
    """Requests (block, h) whose count in the index is ``least`` or more."""
    kind = np.min_scalar_type(least)

    def ask(key, asked, rows):
        h = asked["h"].to_numpy()
        keep = np.zeros(len(h), bool)
        for row in rows.to_pylist():
            levels, prints, counts = _opened(row, kind)
            keys = K.unsigned(h)
            at = place(levels, keys)
            found = at >= 0
            found[found] = prints[at[found]] == _fingerprint(keys[found])
            keep[found] |= counts[at[found]] >= least
        return pa.table({"block": asked["block"].filter(pa.array(keep)), "h": pa.array(h[keep], pa.int64())})

    asked = requests.select("block", "h", F.pmod("h", F.lit(shards)).cast("int").alias("shard"))
    return (asked.groupBy("shard").cogroup(index.groupBy("shard"))
            .applyInArrow(ask, "block int, h long"))


# documents ------------------------------------------------------------------------------------

def _scan(min_chars: int):
    def run(batches):
        for batch in batches:
            found, sizes = [], []
            for text in K.as_bytes(batch.column("text")):
                own = {_hash(key) for key in set(lines_of(text)[1]) if _long_enough(key, min_chars)}
                found.extend(own)
                sizes.append(len(own))
            h = np.array(found, np.uint64)
            block = np.repeat(batch.column("block").to_numpy(), np.array(sizes, np.int64))
            order = np.lexsort((block, h))
            h, block = h[order], block[order]
            first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (block[1:] != block[:-1])]) if len(h) else \
                np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(block[first], pa.int32()), pa.array(K.signed(h[first]), pa.int64()),
                 pa.array(np.diff(np.r_[first, len(h)]), pa.int64())], ["block", "h", "n"])

    return run


def _drop(names: list[str], min_chars: int):
    def apply(key, docs, frequent):
        bad = set(K.unsigned(frequent["h"].to_numpy()).tolist())
        n_lines, n_dropped, kept = [], [], []
        for text in K.as_bytes(docs["text"]):
            lines, keys = lines_of(text)
            stay = [line for line, key in zip(lines, keys)
                    if not (bad and _long_enough(key, min_chars) and _hash(key) in bad)]
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(stay))
            kept.append(b"\n".join(stay).decode("utf-8", "replace"))
        new = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())]
        return pa.Table.from_arrays([docs[n].combine_chunks() for n in names] + new, names=names + list(ADDED))

    return apply


def dedup_lines(docs: DataFrame, min_chars: int = 1, min_docs: int = 10,
                carry: list[str] | None = None) -> DataFrame:
    """Drop every line whose key is found in ``min_docs`` or more documents, in all of them.

    ``docs`` needs ``doc_id`` and ``text``; each row is a document. Returns the columns ``carry``
    (all by default; those named like an added one are replaced) with ``n_lines``, ``n_dropped`` and
    ``kept``, the other lines joined by a line feed.

    A null or empty text is one empty line. Keys shorter than ``min_chars`` code points, so empty
    lines, always stay. Repeated rows count as documents of their own; a null doc_id is allowed. An
    empty table gives an empty result.
    """
    names = [c for c in (carry or docs.columns) if c.lower() not in ADDED]
    blocks = K.groups_for(K.text_bytes(docs), K.BLOCK_BYTES)
    lines = written(
        docs.select("text", K.block_of(blocks).alias("block"))
        .mapInArrow(_scan(min_chars), "block int, h long, n long")
        .groupBy("block", "h").agg(F.sum("n").alias("n")), "lines")
    shards = K.groups_for(lines.count(), SHARD_KEYS)
    index = written(build_index(lines.groupBy("h").agg(F.sum("n").alias("n")), shards, min_docs), "line-index")
    frequent = probe(lines, index, shards, min_docs)
    need = list(dict.fromkeys([*names, "text"]))
    dealt = docs.select(*need, K.block_of(blocks).alias(K.BLOCK)) if "doc_id" in need else \
        docs.select(*need, "doc_id", K.block_of(blocks).alias(K.BLOCK))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)
    out = f"{schema}, n_lines long, n_dropped long, kept string" if names else \
        "n_lines long, n_dropped long, kept string"
    return (dealt.groupBy(K.BLOCK).cogroup(frequent.groupBy("block"))
            .applyInArrow(_drop(names, min_chars), out))

"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a block of documents should hold; a group in one task is about that large.
BLOCK_BYTES = 8 << 20
#: Groups at least, so that small tables are spread evenly too.
LEAST_GROUPS = 64
BLOCK = "__block"


_CACHE: dict = {}


def cache(name, make):
    """A worker's cache; it holds that of one operator at a time, as workers outlive a stage."""
    if name not in _CACHE:
        if _CACHE:
            _CACHE.clear()
            give_back()
        _CACHE[name] = make()
    return _CACHE[name]


def give_back() -> None:
    """Return what a worker has freed to the system, which else stays with the process."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def groups_for(total: int, each: int) -> int:
    """How many groups of about ``each`` units hold ``total`` units."""
    return max(LEAST_GROUPS, -(-int(total or 0) // each))


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def block_of(blocks: int) -> Column:
    """Block of a document; whole texts take part, so equal or null ids do not gather in one block."""
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding them."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A well-mixed 64-bit hash of 64-bit values (multiply and xor-shift rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    for shift in (30, 27):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=np.uint64).view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=np.int64).view(np.uint64)


def aside(docs: DataFrame, added: Iterable[str]) -> DataFrame:
    """``docs`` with the columns named like an added one renamed, so that an operator carries them."""
    gone = {n.lower() for n in added}
    return docs.select(*(F.col(f"`{c}`").alias(f"__own_{c}") if c.lower() in gone else F.col(f"`{c}`")
                         for c in docs.columns))


def restored(out: DataFrame, docs: DataFrame, new: dict[str, Column] | None = None) -> DataFrame:
    """The columns of ``docs`` from what an operator made of ``aside(docs, ...)``; ``new`` replaces some."""
    there = set(out.columns)
    return out.select(*(
        new[c].alias(c) if new and c in new
        else F.col(f"`__own_{c}`").alias(c) if f"__own_{c}" in there else F.col(f"`{c}`") for c in docs.columns))

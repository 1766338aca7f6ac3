"""Vector code compression by member-resident Lloyd rounds.

Vectors become integers and are cut into parts. The parts live with the owner of their (position, entry, salt): a salt bounds
what one owner holds, so an entry that holds most parts is spread over many owners. In a round each owner sums its
resident members, the sums give the new entries, and the owners assign their members anew; only members whose nearest
entry changed travel to the owner of that entry in the next shuffle, the others stay where they are.
All numbers are integers, so the order of sums does not matter and lost owners are made again with the same result.
The last assignment is a pass over the vectors with the final entries.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitlake.session import checkpoint_dir, written

#: Members of one owner (position, entry, salt) at most, about; members of a partition of owners.
OWNER_ROWS, PARTITION_ROWS = 2048, 32_768
#: Members of a batch and entry that get the same salt.
RUN_ROWS = 256
#: Rounds after which the members are checkpointed.
CUT_EVERY = 3
#: Label sums of up to so many rows are broadcast, more are joined by shuffle.
SMALL_ROWS = 50_000
_PACKED = "owner array<long>, members binary"
MOST = 2 ** 63 - 1

Codebooks = list[list[list[int]]]  # by position and entry
Key = tuple[int, int, int]         # position, entry, salt
Members = Iterator[tuple[Key, np.ndarray]]


class Codes(NamedTuple):
    rows: DataFrame  # vec_id, label, code, error
    codebooks: Codebooks


def usable(vector: Column) -> Column:
    """Not null or empty, and without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & (F.size(vector) > 0), F.lit(False))


def integers(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of equally wide vectors; Python integers where 64 bits might not hold a squared distance."""
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width) * scale)
    if len(x) and np.abs(x).max() >= 2 ** 30 / width ** 0.5:
        return np.array([[int(v) for v in row] for row in x.tolist()], dtype=object).reshape(-1, width)
    return x.astype(np.int64)


def cuts(width: int, positions: int) -> list[slice]:
    """Equal consecutive parts; the first ones are one longer where the width does not divide."""
    size, more = divmod(width, positions)
    at = [0]
    for p in range(positions):
        at.append(at[-1] + size + (p < more))
    return [slice(a, b) for a, b in zip(at, at[1:])]


def distances(parts: np.ndarray, book: list[list[int]]) -> np.ndarray:
    """Squared distance of each part to each entry."""
    wide = parts.dtype == object or any(abs(v) >= 2 ** 30 / max(1, len(e)) ** 0.5 for e in book for v in e)
    kind = object if wide else np.int64
    parts = parts.astype(kind)
    out = np.zeros((len(parts), len(book)), kind)
    for number, entry in enumerate(book):  # one entry at a time bounds the memory
        gap = parts - np.array(entry, kind)
        out[:, number] = (gap * gap).sum(axis=1) if gap.shape[1] else 0
    return out


def nearest(parts: np.ndarray, book: list[list[int]]) -> np.ndarray:
    """Nearest entry of each part, equal distances to the lower index."""
    return distances(parts, book).argmin(axis=1).astype(np.int64)


def _by_entry(entries: np.ndarray, parts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Members by their entry."""
    order = np.argsort(entries, kind="stable")
    edges = np.flatnonzero(np.diff(entries[order])) + 1
    for rows in np.split(order, edges) if len(order) else []:
        yield int(entries[rows[0]]), parts[rows]


def _packed(parts: np.ndarray) -> np.ndarray:
    """The same integers in 32 bits where these hold them."""
    small = parts.dtype != object and (not parts.size or np.abs(parts).max() < 2 ** 31)
    return parts.astype(np.int32) if small else parts


def _first_members(width: int, scale: int, books: Codebooks, salts: int):
    """Owners and members of a partition of vectors, assigned to the first entries; runs of members share a salt."""
    def run(batches):
        part = TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            x = integers(batch.column("v"), width, scale)
            owners, members = [], []
            for p, cut in enumerate(cuts(width, len(books))):
                for entry, own in _by_entry(nearest(x[:, cut], books[p]), x[:, cut]):
                    for at in range(0, len(own), RUN_ROWS):
                        salt = xxhash.xxh64_intdigest(f"{part} {number} {p} {entry} {at}") % salts
                        owners.append([p, entry, salt])
                        members.append(pickle.dumps(_packed(own[at:at + RUN_ROWS])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(owners, pa.list_(pa.int64())), pa.array(members, pa.binary())], ["owner", "members"])

    return run


def _sums(members: Members):
    """Sums and count of the members of each (position, entry) of a partition of owners, as Python integers."""
    out: dict[tuple[int, int], list[int]] = {}
    for (position, entry, _), own in members:
        sums = [int(v) for v in own.sum(axis=0, dtype=object if own.dtype == object else np.int64)]
        now = [len(own), *sums]
        out[position, entry] = [a + b for a, b in zip(out.get((position, entry), [0] * len(now)), now)]
    yield out


def _added(a: dict, b: dict) -> dict:
    for key, own in b.items():
        a[key] = [x + y for x, y in zip(a[key], own)] if key in a else own
    return a


def updated(books: Codebooks, sums: dict) -> Codebooks:
    """floor(sum / count) by component; unused entries stay."""
    return [[[s // sums[p, e][0] for s in sums[p, e][1:]] if (p, e) in sums else entry
             for e, entry in enumerate(book)] for p, book in enumerate(books)]


def _moves(books: Codebooks, staying: bool):
    """Members that stay with their owner, or those that go to the owners of another entry."""
    def run(members: Members) -> Members:
        kept: dict[Key, list[np.ndarray]] = {}
        for (position, entry, salt), own in members:
            now = nearest(own, books[position])
            if staying:
                kept.setdefault((position, entry, salt), []).append(own[now == entry])
            else:
                gone = now != entry
                for to, part in _by_entry(now[gone], own[gone]):
                    yield (position, to, salt), part
        for key, own in kept.items():  # what came in pieces is one array from now on
            if any(map(len, own)):
                yield key, np.concatenate(own)

    return run


def lloyd(members: RDD, books: Codebooks, rounds: int, deal: Callable[[Key], int]) -> Codebooks:
    """Entries after so many rounds of update and assignment; ``members`` are dealt to their owners by ``deal``."""
    parts = members.getNumPartitions()
    members = members.persist(StorageLevel.DISK_ONLY)  # made again by lineage where an executor is lost
    for number in range(1, rounds + 1):
        books = updated(books, members.mapPartitions(_sums).treeReduce(_added))
        if number < rounds:
            stay = members.mapPartitions(_moves(books, True), preservesPartitioning=True)
            gone = members.mapPartitions(_moves(books, False)).partitionBy(parts, deal)
            # of one partitioner: owners are joined in place, and only the movers are shuffled
            after = stay.union(gone).persist(StorageLevel.DISK_ONLY)
            if number % CUT_EVERY == 0:
                after.checkpoint()
            after.count()
            members.unpersist()
            members = after
    members.unpersist()
    return books


def _coded(width: int, scale: int, books: Codebooks):
    """(vec_id, label, code, error) of the vectors by the final entries."""
    def run(batches):
        for batch in batches:
            x = integers(batch.column("v"), width, scale)
            entry, error = [], [0] * len(x)
            for cut, book in zip(cuts(width, len(books)), books):
                far = distances(x[:, cut], book)
                entry.append(far.argmin(axis=1))
                error = [a + int(b) for a, b in zip(error, far.min(axis=1))]
            codes = ["".join(f"{e:02x}" for e in row) for row in zip(*entry)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()),
                 pa.array([min(e, MOST) for e in error], pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def compress(vectors: DataFrame, positions: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096,
             vector: str = "embedding") -> Codes:
    """Codes of the vectors (vec_id, label and the column named ``vector``) and the final entries of each position.

    Takes no part: a null or empty vector, one with null or non-finite components, and one whose width is not that of the
    smallest vec_id (null ids come last; of equal ids the smaller vector). A codebook starts with the parts of the ``entries``
    smallest rows, fewer if there are fewer; at most 256. Repeated rows are coded each. An error beyond 64 bits
    is the largest 64-bit number. An empty table gives no rows and no entries. Other columns are not looked at.
    """
    if not 0 < entries <= 256 or positions < 1 or rounds < 0:
        raise ValueError("1 to 256 entries, 1 position and 0 rounds at least")
    spark = vectors.sparkSession
    own = vectors.select("vec_id", "label", F.col(vector).alias("v")).where(usable(F.col("v")))
    first = own.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).collect()
    if not first:
        return Codes(own.selectExpr("vec_id", "label", "'' AS code", "0L AS error").limit(0), [[] for _ in range(positions)])
    width = len(first[0].v)
    own = own.where(F.size("v") == width)
    start = integers(pa.array([r.v for r in own.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()],
                              pa.list_(pa.float64())), width, scale)
    books = [[[int(v) for v in row] for row in start[:, cut]] for cut in cuts(width, positions)]
    rows = written(own, "vectors")
    if rounds:
        total = rows.count()
        salts = max(1, -(-total // OWNER_ROWS))
        parts = max(spark.sparkContext.defaultParallelism, -(-total * positions // PARTITION_ROWS))
        wide = len(books[0])

        def deal(owner: Key) -> int:  # owners are numbered through, so those of one entry lie in different partitions
            return (owner[0] * wide + owner[1]) * salts + owner[2]

        checkpoint_dir(spark)
        packed = rows.select("v").mapInArrow(_first_members(width, scale, books, salts), _PACKED)
        members = packed.rdd.map(lambda r: (tuple(r.owner), pickle.loads(r.members))).partitionBy(parts, deal)
        books = lloyd(members, books, rounds, deal)
    kinds = dict(rows.dtypes)
    return Codes(rows.mapInArrow(_coded(width, scale, books),
                                 f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"), books)


def digest(codes: Codes) -> DataFrame:
    """The codes with ``label_error``, the error summed over equal labels (nulls together), and the digest of all entries."""
    rows = written(codes.rows, "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST)).cast("long")
    sums = rows.groupBy(F.col("label").alias("__label")).agg(total.alias("label_error"))
    if sums.count() <= SMALL_ROWS:
        sums = F.broadcast(sums)
    text = ",".join(str(v) for book in codes.codebooks for entry in book for v in entry)
    return rows.join(sums, F.col("label").eqNullSafe(F.col("__label"))).select(
        "vec_id", "code", "error", "label_error",
        F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))

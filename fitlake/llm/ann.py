"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are parted into bands of like norm. Those of a band are scaled into the unit ball by its largest norm and given
one more coordinate that completes them to unit length, so that the largest inner product is the nearest direction; as
no norm is under two thirds of the largest, that coordinate does not hide the others. A query searches all bands; small ones
are compared whole. Each table rotates them by three
rounds of random signs and a fast Hadamard transform and assigns them to the nearest signed axis. A query
probes the axes it is nearest to in every table; the vectors found are ranked by the exact inner product in
double precision. A bucket is cut into parts of bounded size, so equal vectors in any number do not
meet in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitlake.session import written

#: Tables, and probed axes as a share of all axes: recall 0.98 and more on random unit vectors of 64 dimensions,
#: the hardest case (tests/llm/test_ann.py measures it).
TABLES, PROBED = 8, 1 / 8
#: Largest norm of a band over the smallest; tests ask recall 0.95 at 64 dimensions with unlike norms.
NORM_STEP = 1.5
#: Vectors of one bucket that are ranked in one task, and of a band that is compared whole.
PART_ROWS = 4096
_OUT = "query_id long, found binary"


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row, in place; the width is a power of two."""
    n, width = x.shape
    step = 1
    while step < width:
        y = x.reshape(n, width // (2 * step), 2, step)
        a, b = y[:, :, 0].copy(), y[:, :, 1].copy()
        y[:, :, 0], y[:, :, 1] = a + b, a - b
        step *= 2
    return x


def rotated(x: np.ndarray, number: int) -> np.ndarray:
    """Pseudo-rotation of a table: three rounds of signs and transforms."""
    signs = np.random.default_rng(1000 + number).choice([-1.0, 1.0], (3, x.shape[1]))
    for s in signs:
        x = hadamard(x * s) / np.sqrt(x.shape[1])
    return x


def completed(x: np.ndarray, largest: float | np.ndarray, query: bool) -> np.ndarray:
    """Unit vectors of the padded width: queries by direction, others completed to the largest norm (one or each)."""
    largest = np.asarray(largest, np.float64).reshape(-1, 1)
    width = 1 << int(x.shape[1]).bit_length()  # holds one more coordinate
    out = np.zeros((len(x), width))
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    out[:, :x.shape[1]] = x / (norm if query else largest)
    if not query:
        out[:, x.shape[1]] = np.sqrt(np.maximum(0.0, 1 - (norm / largest)[:, 0] ** 2))
    return out


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def usable(vector: Column) -> Column:
    """Not null or zero, and without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def norm_of(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def band_of(vector: Column) -> Column:
    """Number of the band of a vector's norm; norms beyond the range of numbers are in the outermost.

    Unit norms lie in the middle of a band, so that rounding does not part them.
    """
    power = F.coalesce(F.log(norm_of(vector)) / float(np.log(NORM_STEP)) + 0.5, F.lit(-1e4))
    return F.floor(F.least(F.greatest(power, F.lit(-1e4)), F.lit(1e4))).cast("int")


def _hashed(width: int, largest: dict[int, float], tables: int, spread: int):
    """Vectors with their axes; ``largest`` has the hashed bands, rows of others go to ``spread`` places of table -1."""
    def run(batches):
        for batch in batches:
            band = batch.column("band").to_numpy()
            hashed = np.isin(band, list(largest))
            rest = batch.filter(pa.array(~hashed))
            for axis in range(spread if rest.num_rows else 0):
                yield pa.RecordBatch.from_arrays(
                    [rest.column("band"), pa.array(np.full(rest.num_rows, -1), pa.int32()),
                     pa.array(np.full(rest.num_rows, axis), pa.int32()), rest.column("id"), rest.column("v")],
                    ["band", "number", "axis", "id", "v"])
            batch = batch.filter(pa.array(hashed))
            scale = np.array([largest[b] for b in band[hashed].tolist()])
            x = completed(_vectors(batch.column("v"), width), scale, False)
            for number in range(tables):
                y = rotated(x, number)
                at = np.abs(y).argmax(axis=1)
                axis = np.where(y[np.arange(len(y)), at] > 0, at, at + y.shape[1]) if len(y) else at
                yield pa.RecordBatch.from_arrays(
                    [batch.column("band"), pa.array(np.full(len(y), number), pa.int32()), pa.array(axis, pa.int32()),
                     batch.column("id"), batch.column("v")], ["band", "number", "axis", "id", "v"])

    return run


def _probes(width: int, tables: int, share: float, spread: int):
    """Queries with the axes they probe in every band, and their place of table -1."""
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(batch.num_rows, -1), pa.int32()),
                 pa.array(batch.column("id").to_numpy() % spread, pa.int32()), batch.column("id"), batch.column("v")],
                ["number", "axis", "id", "v"])
            x = completed(_vectors(batch.column("v"), width), 1.0, True)
            for number in range(tables):
                y = rotated(x, number)
                near = np.concatenate([y, -y], axis=1)
                n = max(1, int(round(near.shape[1] * share)))
                axis = np.argsort(-near, axis=1, kind="stable")[:, :n]
                row = np.repeat(np.arange(len(y)), n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(row), number), pa.int32()), pa.array(axis.reshape(-1), pa.int32()),
                     batch.column("id").take(pa.array(row)), batch.column("v").take(pa.array(row))],
                    ["number", "axis", "id", "v"])

    return run


_FOUND = np.dtype([("id", "<i8"), ("score", "<f8")])


def nearest(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, largest first, ties to the smaller id."""
    some = np.arange(len(scores))
    if len(scores) > k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def _ranked(width: int, k: int):
    def run(key, queries, vectors):
        own, ids = queries["id"].to_numpy(), vectors["id"].to_numpy()
        q = _vectors(queries["v"].combine_chunks(), width)
        x = _vectors(vectors["v"].combine_chunks(), width)
        out = []
        for at in range(0, len(q), 512):
            # a sum of products in one order for every pair, so that equal vectors get equal scores
            score = np.einsum("ij,kj->ik", q[at:at + 512], x)
            for row, me in zip(score, own[at:at + 512]):
                row[ids == me] = -np.inf
                best = nearest(ids, row, k)
                best = best[row[best] > -np.inf]
                found = np.empty(len(best), _FOUND)
                found["id"], found["score"] = ids[best], row[best]
                out.append(found.tobytes())
        return pa.table({"query_id": pa.array(own, pa.int64()), "found": pa.array(out, pa.binary())})

    return run


def _merged(k: int):
    def run(key, rows):
        found = np.frombuffer(b"".join(rows["found"].to_pylist()), _FOUND)
        ids, first = np.unique(found["id"], return_index=True)
        scores = found["score"][first]
        best = nearest(ids, scores, k)
        return pa.table({
            "query_id": pa.array(np.full(len(best), key[0].as_py()), pa.int64()),
            "rank": pa.array(np.arange(1, len(best) + 1), pa.int32()),
            "vec_id": pa.array(ids[best], pa.int64()), "score": pa.array(scores[best], pa.float64())})

    return run


def search(vectors: DataFrame, queries: Column, k: int = 20, tables: int = TABLES, probed: float = PROBED,
           id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The k nearest found of every row where ``queries`` holds, among all other rows, by inner product.

    ``queries`` is a condition on the id as column ``id``. Returns ``query_id, rank, vec_id, score``, nearest
    first, ties to the smaller id. Null or zero vectors, those with null or non-finite components or
    a null id, and those of another than the most frequent dimension take no part. Of rows with one id the
    one of the smallest vector takes part. A query for which the tables give fewer than k of the vectors there are is
    compared with all of them. Other columns are not read; an empty table gives no rows.
    """
    rows = (vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v"))
            .where(F.col("id").isNotNull() & usable(F.col("v"))))
    sizes = rows.groupBy(F.size("v").alias("width")).agg(
        F.count("*").alias("n"), F.countDistinct("id").alias("ids"))
    top = sizes.orderBy(F.desc("n"), "width").limit(1).collect()
    out = "query_id long, rank int, vec_id long, score double"
    if not top:
        return vectors.sparkSession.createDataFrame([], out)
    width, total, ids = top[0]
    rows = rows.where(F.size("v") == width)
    if ids < total:
        rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    kind = rows.schema["v"].dataType.simpleString()
    banded = rows.withColumn("band", band_of(F.col("v")))
    # a row per power of NORM_STEP, some thousands at most
    bands = banded.groupBy("band").agg(F.count("*").alias("n"), F.max(norm_of(F.col("v"))).alias("norm")).collect()
    largest = {r.band: r.norm for r in bands if r.n > PART_ROWS and 0 < r.norm < float("inf")}
    spread = max(1, int(round(1 / probed)))  # a place of table -1 meets as many queries as an axis does
    hashed = f"number int, axis int, id long, v {kind}"
    data = banded.mapInArrow(_hashed(width, largest, tables, spread), f"band int, {hashed}")
    asked = rows.where(queries).mapInArrow(_probes(width, tables, probed, spread), hashed)
    # buckets with more than a part's rows are few: at most tables * rows / PART_ROWS
    sizes = (data.groupBy("band", "number", "axis").count()
             .select("band", "number", "axis", F.ceil(F.col("count") / PART_ROWS).cast("int").alias("parts")))
    sizes = written(sizes, "buckets")  # a row per band, table and axis
    small = F.broadcast(sizes)  # bands * tables * 2 * width rows at most
    few = asked.join(small, ["number", "axis"]).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    many = data.join(small, ["band", "number", "axis"]).withColumn(
        "part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    place = ["band", "number", "axis", "part"]
    found = few.select(*place, "id", "v").groupBy(*place).cogroup(
        many.select(*place, "id", "v").groupBy(*place)).applyInArrow(_ranked(width, k), _OUT)
    result = written(found.groupBy("query_id").applyInArrow(_merged(k), out), "nearest")
    enough = min(k, ids - 1)
    short = (rows.where(queries).join(
        result.groupBy("query_id").count().where(F.col("count") >= enough).select(F.col("query_id").alias("id")),
        "id", "left_anti"))
    if enough < 1 or not short.limit(1).count():
        return result
    parts = max(16, -(-ids // PART_ROWS))
    each = short.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    # columns of their own: both sides come from the same rows
    whole = each.toDF(*each.columns).groupBy("part").cogroup(
        rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).groupBy("part")
    ).applyInArrow(_ranked(width, k), _OUT)
    rest = whole.groupBy("query_id").applyInArrow(_merged(k), out)
    return result.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").select(
        "query_id", "rank", "vec_id", "score").union(rest)

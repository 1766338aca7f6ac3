"""Ordered computations that stay parallel inside one very long run.

A plain ``Window.partitionBy(run).orderBy(step)`` sends every row of a run to one task. Here every
run is cut into chunks of about ``spark.fitlake.chunkRows`` rows, whatever its values look like: a
hashed sample of the rows, sorted in the full order, gives the edges (``edges``). The window runs per
chunk, and a small table with one row per chunk carries the state from one chunk to the next.
A run shorter than a chunk has no edge and pays one shuffle, as a plain window does.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from fitlake.session import written

CHUNK_ROWS_CONF = "spark.fitlake.chunkRows"
CHUNK_ROWS_DEFAULT = "1000000"
CHUNK = "_chunk"
#: Sampled rows per chunk: the size of a chunk then spreads by an eighth, and twice the size is eight deviations away.
SAMPLED = 64
#: Edges that may be broadcast; more of them are joined by shuffle.
BROADCAST_EDGES = 200_000

_MERGE: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "sum": (F.sum, lambda a, b: a + b),
    "count": (F.count, lambda a, b: a + b),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
    "bit_or": (F.bit_or, lambda a, b: a.bitwiseOR(b)),
}
_ACROSS = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min, "bit_or": F.bit_or}


def chunk_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(CHUNK_ROWS_CONF, CHUNK_ROWS_DEFAULT))


def _at(order: Sequence[Column | str]) -> Column:
    """Place of a row in the full order; structs compare field by field, nulls first and NaN last."""
    return F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)])


def edges(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """(keys, _edges): the first place of each chunk but the first, for keys of more rows than a chunk.

    The sample takes a row by the hash of its keys and its place, so it is the same whenever it is taken and merges over
    partitions. Every 64th sampled row of a key, in the full order, is an edge. Outliers, NaN and equal leading values
    weigh no more than their rows; only rows equal in all order columns stay together.
    """
    size = chunk_rows(df)
    rate = min(1.0, SAMPLED / size)
    each = max(1, round(size * rate))
    place = _at(order)
    bits = F.xxhash64(*keys, place).bitwiseAND(F.lit((1 << 40) - 1))
    sample = df.where(bits < int(rate * (1 << 40))) if rate < 1 else df
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_e"))
    return (sample.select(*keys, place.alias("_e")).withColumn("_i", rank - 1)
            .where((F.col("_i") > 0) & (F.col("_i") % each == 0))
            .groupBy(*keys).agg(F.array_sort(F.collect_set("_e")).alias("_edges")))


def _chunk_of(place: Column, found: Column) -> Column:
    """How many of the sorted edges are at or before the place: a binary search."""
    size = F.size(found)
    steps = F.filter(F.lit([1 << b for b in range(30, -1, -1)]), lambda p: p <= size)
    after = F.aggregate(steps, F.lit(0), lambda lo, p: F.when(
        (lo + p <= size) & (F.try_element_at(found, lo + p) <= place), lo + p).otherwise(lo))
    return F.when(found.isNull(), 0).otherwise(after).cast("long")


def with_chunk(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> tuple[DataFrame, bool]:
    """Add ``_chunk`` (0, 1, ... along the order within the keys); whether any key has more than one.

    Where no key has more rows than a chunk (one count per key tells) there is nothing to cut. Otherwise the edges are
    settled as a small table first, so that every later use of the rows sees the same chunks.
    """
    longest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if longest <= chunk_rows(df):
        return df.withColumn(CHUNK, F.lit(0).cast("long")), False
    found = written(edges(df, keys, order), "edges")
    total = found.agg(F.sum(F.size("_edges"))).first()[0] or 0
    side = F.broadcast(found) if total <= BROADCAST_EDGES else found
    names = {k: f"_edge_{k}" for k in keys}
    side = side.select(*[F.col(k).alias(n) for k, n in names.items()], "_edges")
    same = F.lit(True)
    for k, n in names.items():  # null keys are a run too
        same = same & F.col(k).eqNullSafe(F.col(n))
    return (df.join(side, same, "left").withColumn(CHUNK, _chunk_of(_at(order), F.col("_edges")))
            .drop("_edges", *names.values())), True


def _carried(df: DataFrame, keys: Sequence[str], table: DataFrame) -> DataFrame:
    """Rows with the columns of a table of chunks; null keys meet too."""
    both = [*keys, CHUNK]
    side = table.select(*[F.col(k).alias(f"_to_{k}") for k in both],
                        *[c for c in table.columns if c not in both])
    same = F.lit(True)
    for k in both:
        same = same & F.col(k).eqNullSafe(F.col(f"_to_{k}"))
    return df.join(side, same, "left").drop(*[f"_to_{k}" for k in both])


def number(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "k", start: int = 0,
) -> DataFrame:
    """Dense position of each row within its key, along the order."""
    chunked, split = with_chunk(df, keys, order)
    local = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    out = chunked.withColumn(name, F.row_number().over(local).cast("long"))
    if split:
        earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        offsets = chunked.groupBy(*keys, CHUNK).agg(F.count("*").alias("_n")).select(
            *keys, CHUNK, F.sum("_n").over(earlier).alias("_before")).where("_before > 0")
        out = _carried(out, keys, offsets).withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0)))
        out = out.drop("_before")
    return out.withColumn(name, F.col(name) + F.lit(start - 1)).drop(CHUNK)


def frames(
    df: DataFrame, keys: Sequence[str], idx: str,
    columns: Mapping[str, Callable[[WindowSpec], Column]], before: int = 0, after: int = 0,
) -> DataFrame:
    """Window columns whose frames reach at most ``before``/``after`` rows from the current one.

    ``idx`` is the dense position. Rows next to a chunk border are copied into the neighbouring
    chunk, so each chunk computes its own rows without looking elsewhere.
    """
    size = max(chunk_rows(df), before, after, 1)
    here = F.floor(F.col(idx) / size)
    within = F.pmod(F.col(idx), F.lit(size))
    copies = F.array_compact(F.array(
        here,
        F.when(within >= size - before, here + 1),
        F.when((within < after) & (here > 0), here - 1),
    ))
    w = Window.partitionBy(*keys, CHUNK).orderBy(idx)
    return (
        df.withColumn(CHUNK, F.explode(copies))
        .withColumns({name: make(w) for name, make in columns.items()})
        .where(F.col(CHUNK) == F.floor(F.col(idx) / size))
        .drop(CHUNK)
    )


def running(
    df: DataFrame, keys: Sequence[str], idx: str, columns: Mapping[str, tuple[Column, str]],
) -> DataFrame:
    """Running aggregates ``name -> (expression, sum|count|max|min|bit_or)`` up to the row.

    ``idx`` is the dense position from 0, so only full chunks hand something on. Where no run is longer than a chunk
    (one aggregate over ``idx`` tells), nothing has to be handed on and the rows are planned once.
    """
    size = chunk_rows(df)
    longest = df.agg(F.max(idx)).first()[0]
    split = longest is not None and longest >= size
    chunked = df.withColumns({f"_in_{name}": expr for name, (expr, _) in columns.items()})
    if split:
        chunked = chunked.withColumn(CHUNK, F.floor(F.col(idx) / size))
    local = (Window.partitionBy(*keys, *[CHUNK] * split).orderBy(idx)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = chunked.withColumns(
        {name: _MERGE[how][0](F.col(f"_in_{name}")).over(local)
         for name, (_, how) in columns.items()})
    if not split:
        return out.drop(*[f"_in_{n}" for n in columns])
    upto = (Window.partitionBy(*keys).orderBy(CHUNK)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    full = (
        chunked.groupBy(*keys, CHUNK)
        .agg(F.count("*").alias("_n"),
             *[_MERGE[how][0](F.col(f"_in_{name}")).alias(f"_c_{name}")
               for name, (_, how) in columns.items()])
        .where(F.col("_n") == size)
    )
    carried = full.select(
        *keys, (F.col(CHUNK) + 1).alias(CHUNK),
        *[_ACROSS[how](F.col(f"_c_{name}")).over(upto).alias(f"_p_{name}")
          for name, (_, how) in columns.items()])
    out = _carried(out, keys, carried).withColumns({
        name: F.when(F.col(f"_p_{name}").isNull(), F.col(name))
        .when(F.col(name).isNull(), F.col(f"_p_{name}"))
        .otherwise(_MERGE[how][1](F.col(f"_p_{name}"), F.col(name)))
        for name, (_, how) in columns.items()})
    return out.drop(CHUNK, *[f"_in_{n}" for n in columns], *[f"_p_{n}" for n in columns])


def neighbours(
    df: DataFrame, keys: Sequence[str], pos: str, mark: Column, prev: str, nxt: str, seen: str,
) -> DataFrame:
    """Nearest non-null ``mark`` at or before (``prev``) and at or after (``nxt``) each ``pos``.

    ``mark`` is null or a struct that starts with ``pos``, so carrying it is a running max/min. A mark at ``pos`` itself is
    both. ``seen`` counts the marks at or before the row. Marks stand before other rows of their ``pos``, which lets a chunk
    begin between rows of one ``pos``.
    """
    marked = df.withColumn("_mark", mark)
    chunked, split = with_chunk(marked, keys, [pos, F.isnull("_mark"), F.xxhash64(*df.columns)])
    local = Window.partitionBy(*keys, CHUNK).orderBy(pos)
    back = local.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = local.rangeBetween(Window.currentRow, Window.unboundedFollowing)
    out = chunked.withColumns({prev: F.max("_mark").over(back), nxt: F.min("_mark").over(ahead),
                               seen: F.count("_mark").over(back)})
    if split:
        chunks = Window.partitionBy(*keys).orderBy(CHUNK)
        earlier, later = (chunks.rowsBetween(Window.unboundedPreceding, -1),
                          chunks.rowsBetween(1, Window.unboundedFollowing))
        ends = (
            chunked.groupBy(*keys, CHUNK)
            .agg(F.max("_mark").alias("_hi"), F.min("_mark").alias("_lo"), F.count("_mark").alias("_n"))
            .select(*keys, CHUNK, F.max("_hi").over(earlier).alias("_pp"),
                    F.min("_lo").over(later).alias("_pn"), F.sum("_n").over(earlier).alias("_ps"))
        )
        out = _carried(out, keys, ends).withColumns({
            prev: F.coalesce(F.col(prev), F.col("_pp")), nxt: F.coalesce(F.col(nxt), F.col("_pn")),
            seen: F.col(seen) + F.coalesce(F.col("_ps"), F.lit(0))}).drop("_pp", "_pn", "_ps")
    at = df.select(mark.alias("m")).schema["m"].dataType[0].name
    here = F.col(prev)[at] == F.col(pos)
    return out.withColumn(nxt, F.when(here, F.col(prev)).otherwise(F.col(nxt))).drop("_mark", CHUNK)


def rank_values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values per key: copies ``n``, rows ``upto`` this value, and ``rows`` of the key.

    Copies collapse on the map side first, so one value holding a third of the rows is one row.
    """
    return rank_counted(count_values(df, keys, value), keys, value)


def count_values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys, value).agg(F.count("*").alias("n"))


def rank_counted(counted: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    chunked, split = with_chunk(counted, keys, [value])
    chunk = Window.partitionBy(*keys, CHUNK)
    local = chunk.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = chunked.withColumns({"upto": F.sum("n").over(local), "rows": F.sum("n").over(chunk)})
    if split:
        whole = Window.partitionBy(*keys)
        earlier = whole.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        offsets = chunked.groupBy(*keys, CHUNK).agg(F.sum("n").alias("_c")).select(
            *keys, CHUNK, F.sum("_c").over(earlier).alias("_before"), F.sum("_c").over(whole).alias("_total"))
        out = _carried(out, keys, offsets).withColumns({
            "upto": F.col("upto") + F.coalesce(F.col("_before"), F.lit(0)), "rows": F.col("_total")})
        out = out.drop("_before", "_total")
    return out.drop(CHUNK)


def order_statistics(
    df: DataFrame, keys: Sequence[str], value: str, ranks: Mapping[str, Callable[[Column], Column]],
) -> DataFrame:
    """One row per key with the values at 0-based sorted positions, and its row count ``rows``.

    ``ranks`` maps an output name to a function of that count giving the position.
    """
    if not keys:
        return order_statistics(df.withColumn("_all", F.lit(0)), ["_all"], value, ranks).drop("_all")
    hits = [c.alias(name) for name, c in _at_ranks(value, ranks).items()]
    return rank_values(df, keys, value).groupBy(*keys).agg(*hits, F.max("rows").alias("rows"))


def _at_ranks(value: str, ranks: Mapping[str, Callable[[Column], Column]]) -> dict[str, Column]:
    low = F.col("upto") - F.col("n")
    return {name: F.max(F.when((make(F.col("rows")) >= low) & (make(F.col("rows")) < F.col("upto")),
                               F.col(value))) for name, make in ranks.items()}


def quantile_ranks(quantiles: Mapping[str, float]) -> dict[str, Callable[[Column], Column]]:
    ranks: dict[str, Callable[[Column], Column]] = {}
    for name, q in quantiles.items():
        ranks[f"_l_{name}"] = lambda n, q=q: F.floor((n - 1) * F.lit(q))
        ranks[f"_u_{name}"] = lambda n, q=q: F.ceil((n - 1) * F.lit(q))
    return ranks


def interpolate_ranks(quantiles: Mapping[str, float]) -> list[Column]:
    out = []
    for name, q in quantiles.items():
        at = (F.col("rows") - 1) * F.lit(q)
        lo, hi = F.col(f"_l_{name}"), F.col(f"_u_{name}")
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return out


def linear_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: Mapping[str, float],
) -> DataFrame:
    """Exact quantiles per key, linearly interpolated between neighbouring order statistics."""
    stats = order_statistics(df, keys, value, quantile_ranks(quantiles))
    return stats.select(*keys, "rows", *interpolate_ranks(quantiles))


def counted_summary(
    counted: DataFrame, keys: Sequence[str], value: str, quantiles: Mapping[str, float],
) -> DataFrame:
    """Range, size and exact quantiles per key of a table of distinct values with counts ``n``."""
    ranked = rank_counted(counted, keys, value)
    hits = [c.alias(name) for name, c in _at_ranks(value, quantile_ranks(quantiles)).items()]
    stats = ranked.groupBy(*keys).agg(
        F.min(value).alias("lowest"), F.max(value).alias("highest"), F.max("rows").alias("rows"),
        *hits)
    return stats.select(*keys, "lowest", "highest", "rows", *interpolate_ranks(quantiles))

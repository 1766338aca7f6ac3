"""Mixing sources to target weights, in DataFrame functions only.

The words of a source, its documents in the order of a hash, are packed into blocks of a fixed length (the last one
may be short). The mix has as many slots as the targets need blocks, dealt to output shards of equal length. Every
slot draws its source by the targets, which makes the counts of a shard multinomial. The draws of a
source are numbered through all shards and run through a pseudorandom permutation of its blocks, pass after
pass; draws beyond a source's last slot go to the sources that have slots left, so each source gives exactly its
target. Slots and pieces of documents meet in an equi join on (source, block).

All numbers come from hashes of the rows and of slot numbers, so reruns agree whatever the partitions. No group grows with
the table: offsets are summed by parts of ``PART`` rows, and copies of one row are one row with a count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitlake.session import written

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block, and slots of an output shard.
BLOCK, SHARD_SLOTS = 512, 1024
#: Rows that a window takes at a time, about; also the cells that an interval lookup is spread over.
PART = 4096
#: Documents of all sources in a part; that of a hot source is then small beside a task, and tasks are even.
DOC_PART = 128
#: Rounds of the permutation. Each swaps about half of all pairs of a random reflection.
ROUNDS = 24
#: Tables of up to so many rows (one per source or cell) are broadcast, larger ones joined by shuffle.
SMALL_ROWS = 50_000
_LOW = (1 << 33) - 1


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL_ROWS else df


def repeated(df: DataFrame, n: str, name: str) -> DataFrame:
    """Each row ``n`` times (none for 0), numbered from 0 as column ``name``; in two steps, so that arrays stay short."""
    zero = F.lit(0).cast("long")
    runs = F.sequence(zero, F.floor((F.col(n) - 1) / PART).cast("long"))
    last = F.least(F.col(n) - F.col("__outer") * PART, F.lit(PART)) - 1
    return (df.where(F.col(n) > 0).withColumn("__outer", F.explode(runs))
            .withColumn("__inner", F.explode(F.sequence(zero, last.cast("long"))))
            .withColumn(name, F.col("__outer") * PART + F.col("__inner")).drop("__outer", "__inner"))


def before(df: DataFrame, keys: Sequence[str], at: str, value: str, most: int) -> DataFrame:
    """(keys, at, __before): the sum of ``value`` over the smaller ``at`` (0 to ``most``) of the keys.

    ``df`` has one row per (keys, at). Runs of ``PART`` numbers are summed first, and their sums in the same way.
    """
    w = Window.partitionBy(*keys, "__run").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.select(*keys, at, value, F.floor(F.col(at) / PART).alias("__run"))
    inner = rows.withColumn("__in", F.coalesce(F.sum(value).over(w), F.lit(0)))
    if most < PART:
        return inner.select(*keys, at, F.col("__in").alias("__before"))
    runs = rows.groupBy(*keys, "__run").agg(F.sum(value).alias("__sum"))
    outer = before(runs.withColumnRenamed("__run", "__up"), keys, "__up", "__sum", most // PART)
    return inner.join(outer.select(*keys, F.col("__up").alias("__run"), F.col("__before").alias("__far")),
                      [*keys, "__run"]).select(*keys, at, (F.col("__far") + F.col("__in")).alias("__before"))


def located(points: DataFrame, at: str, spans: DataFrame, total: int, rows: int) -> DataFrame:
    """``points`` with the columns of the span [__from, __from + __length) that holds ``at``.

    The spans, ``rows`` in number, cover 0 to ``total`` - 1; they are spread over equal cells, so this is an equi join.
    """
    width = max(1, -(-total // PART))
    cell = F.floor(F.col(at) / width)
    ends = spans.where("__length > 0").withColumn("__cell", F.explode(F.sequence(
        F.floor(F.col("__from") / width), F.floor((F.col("__from") + F.col("__length") - 1) / width))))
    inside = (F.col(at) >= F.col("__from")) & (F.col(at) < F.col("__from") + F.col("__length"))
    return (points.withColumn("__cell", cell).join(_small(ends, rows + PART), "__cell").where(inside)
            .drop("__cell", "__from", "__length"))


def numbered(df: DataFrame, order: Column, name: str) -> DataFrame:
    """The rows numbered from 0 in the order of a distributed sort, as a written table."""
    rows = written(df.orderBy(order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33)
    counts = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    # one row per partition of the sort
    start = counts.select("__part", F.coalesce(F.sum("__n").over(
        Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    return rows.withColumn("__part", part).join(F.broadcast(start), "__part").withColumn(
        name, F.col("__start") + F.col("__at").bitwiseAND(F.lit(_LOW))).drop("__part", "__start", "__at")


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, hash, copies), equal rows being one; size counts the words of the whole text."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return (docs.select("doc_id", "source", size.alias("size"), F.xxhash64("doc_id", "text").alias("hash"))
            .groupBy("doc_id", "source", "size", "hash").agg(F.count("*").alias("copies")))


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5,
            most: float = 2.0) -> DataFrame:
    """Sources by code point, null last: ``number``, ``source``, ``source_size``, ``weight`` and ``target``.

    The weights repeat along the sources and share ``share`` times all sizes. A target stops at ``most`` times its
    source's size; what is above is shared again by weight among the rest, until none is above. Each round sums over the
    table of sources, and ends for good as every round stops one source more.
    """
    if share > most:
        raise ValueError("the share of all sizes cannot exceed the most of each source")
    sums = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.pmod(F.col("number"), F.lit(len(weights))) + 1).cast("int"))
    table = written(numbered(sums, F.col("source").asc_nulls_last(), "number").withColumn("weight", weight), "sources")
    cap = F.col("source_size") * float(most)
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while total:
        stopped = cap <= F.col("weight") * level
        left, open_ = table.agg(F.lit(share * total) - F.sum(F.when(stopped, cap).otherwise(0.0)),
                                F.sum(F.when(~stopped, F.col("weight")))).first()
        if not open_ or left / open_ <= level:
            break
        level = left / open_
    return table.withColumn("target", F.least(cap, F.col("weight") * level))


def permuted(index: Column, n: Column, seed: Column, rounds: int = ROUNDS) -> Column:
    """Image of ``index`` under a pseudorandom permutation of 0 to ``n`` - 1 (swap or not).

    A round reflects the index at a hashed point and takes the reflection if a hashed bit of the pair says so; as the bit
    belongs to the pair, every round is a permutation, for any ``n``.
    """
    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(seed, r), n) - x, n)
        bit = F.xxhash64(seed, r, F.greatest(x, other)).bitwiseAND(F.lit(1))
        return F.when(bit == 1, other).otherwise(x)

    return F.aggregate(F.lit(list(range(rounds))), index.cast("long"), step)


def slots(sources: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """The mix: (shard, position, number, source, pass, block, words), ``words`` of the block being taken.

    A source gives ``floor(target)`` words: pass after pass over its blocks, each in an order of its own, the short last
    block at the end of each pass. Which shards they go to is drawn for every slot.
    """
    size, goal = F.col("source_size"), F.floor("target").cast("long")
    per_pass = F.ceil(size / block).cast("long")
    passes = F.floor(goal / F.nullif(size, F.lit(0))).cast("long")
    own = F.coalesce(passes * per_pass + F.ceil((goal - passes * size) / block).cast("long"), F.lit(0))
    table = sources.withColumns({"__goal": goal, "__blocks": per_pass, "__own": own})
    rows = table.count()
    table = table.join(_small(before(table, [], "number", "__own", rows), rows), "number")
    table = written(table.withColumnRenamed("__before", "__from").withColumn("__length", F.col("__own")), "mix")
    total = table.agg(F.sum("__own")).first()[0] or 0
    ids = table.sparkSession.range(total).select(
        F.floor(F.col("id") / shard_slots).alias("shard"), F.pmod("id", F.lit(shard_slots)).alias("position"),
        F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(total, 1))).alias("__draw"))
    drawn = located(ids, "__draw", table.select("number", "__from", "__length"), total, rows).drop("__draw")
    counts = written(drawn.groupBy("number", "shard").agg(F.count("*").alias("__n")), "draws")
    starts = before(counts, ["number"], "shard", "__n", total // shard_slots)
    inside = Window.partitionBy("number", "shard").orderBy("position")
    drawn = (drawn.withColumn("__rank", F.row_number().over(inside) - 1).join(starts, ["number", "shard"])
             .withColumn("__index", F.col("__before") + F.col("__rank")).drop("__rank", "__before"))
    # draws beyond the last slot of a source fill the sources with slots left, both in the order of sources
    got = counts.groupBy("number").agg(F.sum("__n").alias("__got"))
    state = table.select("number", "__own").join(got, "number", "left").fillna(0, ["__got"]).withColumns({
        "__over": F.greatest(F.col("__got") - F.col("__own"), F.lit(0)),
        "__length": F.greatest(F.col("__own") - F.col("__got"), F.lit(0))})
    state = written(state, "state")
    over = state.join(before(state, [], "number", "__over", rows), "number").select(
        "number", "__own", F.col("__before").alias("__far"))
    free = state.join(before(state, [], "number", "__length", rows), "number").select(
        F.col("number").alias("__to"), "__got", F.col("__before").alias("__from"), "__length")
    spare = state.agg(F.sum("__over")).first()[0] or 0
    drawn = drawn.join(_small(over, rows), "number")
    kept = drawn.where(F.col("__index") < F.col("__own")).drop("__own", "__far")
    moved = drawn.where(F.col("__index") >= F.col("__own")).withColumn(
        "__point", F.col("__far") + F.col("__index") - F.col("__own")).drop("__own", "__far", "__index", "number")
    start = F.col("__from")
    moved = located(moved, "__point", free.withColumn("__start", start), spare, rows).select(
        "shard", "position", F.col("__to").alias("number"),
        (F.col("__got") + F.col("__point") - F.col("__start")).alias("__index"))
    every = kept.select("shard", "position", "number", "__index").unionByName(moved)
    every = every.join(_small(table.select("number", "source", "source_size", "__goal", "__blocks"), rows), "number")
    turn = F.floor(F.col("__index") / F.col("__blocks")).cast("long")
    place = F.pmod("__index", "__blocks")
    full = F.floor(F.col("source_size") / block).cast("long")
    number = F.when(place < full, permuted(place, full, F.xxhash64(F.lit(seed), F.col("source"), turn))).otherwise(place)
    end = F.least(place * block + block, F.col("source_size"))
    words = F.least(end, F.col("__goal") - turn * F.col("source_size")) - place * block
    return every.select("shard", "position", "number", "source", turn.alias("pass"), number.alias("block"),
                        words.cast("long").alias("words"))


def placed(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """A row per document with the columns of its source and ``start``, its first word's place in the source."""
    n, rows = sizes.count(), sources.count()
    parts = max(1, -(-n // DOC_PART))
    own = sources.withColumnRenamed("source", "__source")
    at = sizes.withColumn("__part", F.pmod("hash", F.lit(parts))).join(
        _small(own, rows), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    at = at.withColumn("__words", F.col("size") * F.col("copies"))
    sums = at.groupBy("number", "__part").agg(F.sum("__words").alias("__sum"))
    starts = before(sums, ["number"], "__part", "__sum", parts)
    inside = (Window.partitionBy("number", "__part").orderBy("hash", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    at = at.withColumn("__in", F.coalesce(F.sum("__words").over(inside), F.lit(0))).join(starts, ["number", "__part"])
    return repeated(at, "copies", "__copy").withColumn(
        "start", F.col("__before") + F.col("__in") + F.col("__copy") * F.col("size")).drop(
        "__part", "__words", "__in", "__before", "__copy", "copies", "hash")


def contents(documents: DataFrame, mix: DataFrame, block: int = BLOCK) -> DataFrame:
    """What every slot holds: (shard, position, doc_id, number, start, first_word, words) of ``placed`` documents."""
    last = F.floor((F.col("start") + F.col("size") - 1) / block)
    pieces = documents.withColumn("__blocks", F.when(F.col("size") > 0, last - F.floor(F.col("start") / block) + 1)
                                  .otherwise(0))
    pieces = repeated(pieces, "__blocks", "__step").select(
        "doc_id", "number", "start", "size", (F.floor(F.col("start") / block) + F.col("__step")).alias("block"))
    low = F.greatest(F.col("start"), F.col("block") * block)
    high = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("__taken"))
    return (pieces.join(mix.select("shard", "position", "number", "block", F.col("words").alias("__taken")),
                        ["number", "block"])
            .where(high > low)
            .select("shard", "position", "doc_id", "number", "start", "size", (low - F.col("start")).alias("first_word"),
                    (high - low).alias("words")))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
        block: int = BLOCK, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Documents with what the mix takes of them, and the contents of the mix.

    The first table has, per row of ``docs`` (doc_id, text, source): doc_id, ``size`` (words), ``source_size``,
    ``target`` of its source and ``taken`` (words, repeats counted; at most ``most`` rounded up times the size).
    A null text has no words and nothing taken; a null source is a source of its own, the last one. Null and repeated ids
    and equal rows are documents of their own. An empty table gives no rows. Other columns are not looked at.
    """
    sizes = written(measured(docs), "sizes")
    sources = targets(sizes, weights, share, most)
    documents = placed(sizes, sources)
    held = contents(documents, slots(sources, block, seed=seed), block)
    # words of a source have places of their own, so (source, start) names a document that has any
    taken = held.groupBy("number", "start").agg(F.sum("words").alias("taken"))
    full = documents.where("size > 0").join(taken, ["number", "start"], "left")
    none = documents.where("size = 0").withColumn("taken", F.lit(None).cast("long"))
    out = full.unionByName(none.select(*full.columns))
    return out.select("doc_id", "size", "source_size", "target",
                      F.coalesce("taken", F.lit(0)).cast("long").alias("taken")), held

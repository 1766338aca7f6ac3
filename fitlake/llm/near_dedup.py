"""MinHash near-duplicates through a multi-index Hamming join.

A text's word shingles give a signature of ``CHUNKS * CHUNK`` minima, each cut to 16 bits. Texts that agree
in 0.8 of their shingles differ in about a fifth of the symbols. The signature is split into chunks; by
pigeonhole, two signatures that differ in at most ``2 * CHUNKS - 1`` symbols have a chunk with at
most one difference, so every chunk is indexed once for each place that may differ, without
that place. All pairs under that distance share an index key; pairs of similarity 0.8 do so with
probability 1 - 2e-5, more similar ones more often.

Equal shingle sets are one class, and only classes are indexed. Small buckets give their pairs; a
large bucket gives one pair per member, with its leader. Pairs are confirmed on the full sets.
Where the links leave several components inside large buckets, the members outside the largest
one are compared with all members, in blocks of bounded size, so no link is lost and
nothing grows with the square of a group of copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitlake.llm import common as K
from fitlake.session import written

CHUNKS, CHUNK = 8, 5
SYMBOLS = CHUNKS * CHUNK
#: Differing symbols beyond which a pair is not looked at: 6 deviations above the mean at similarity 0.8.
FAR = 24
#: Links that a task cuts to spanning stars at a time.
FOREST_LINKS = 200_000
#: Members up to which a bucket gives all its pairs.
SMALL = 16
#: Pairs of one leader that are confirmed together, and members and others in a block.
LEADER_ROWS, BLOCK_ROWS = 64, 512
CACHE_WORDS = 400_000
#: Stands for a missing id, so that it is the smallest of nothing.
NO_ID = (1 << 63) - 1
_MULTIPLY = np.random.default_rng(20).integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng(21).integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)


class _Words(dict):
    """Hashes of words; a worker keeps those it met last."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value




def shingles(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``words`` words; fewer words are one run, no words none."""
    cut = (text or b"").lower().split()
    if not cut:
        return np.zeros(0, np.uint64)
    known = K.cache("word hashes", _Words)
    if len(known) > CACHE_WORDS:
        known.clear()
    h = np.fromiter(map(known.__getitem__, cut), np.uint64, len(cut))
    size = min(words, len(h))
    x = K.mixed(h[:len(h) - size + 1], size)
    for k in range(1, size):
        x = K.mixed(x + h[k:len(h) - size + 1 + k], size)
    return np.unique(x)


def signature(s: np.ndarray) -> np.ndarray:
    low = np.full(SYMBOLS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(s), 2048):
        low = np.minimum(low, (s[at:at + 2048, None] * _MULTIPLY + _ADD).min(axis=0))
    return (K.mixed(low, 3) >> np.uint64(48)).astype("<u2")


def class_of(s: np.ndarray) -> int:
    """64-bit hash of a shingle set."""
    return xxhash.xxh3_64_intdigest(s.tobytes())


# a set travels as the low 40 bits of its hashes: 5 bytes each
def _packed(s: np.ndarray) -> bytes:
    low = np.unique(s & np.uint64((1 << 40) - 1)).astype("<u8")
    return np.ascontiguousarray(low.view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return wide.reshape(-1).view("<u8")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def _linked(common: int, na: int, nb: int, percent: int) -> bool:
    return 100 * common >= percent * (na + nb - common)


def _sign(words: int):
    def run(batches):
        for batch in batches:
            n, kind, signs = [], [], []
            for text in K.as_bytes(batch.column("text")):
                s = shingles(text, words)
                n.append(len(s))
                kind.append(class_of(s) if len(s) else 0)
                signs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("hash"), pa.array(n, pa.int64()),
                 pa.array(K.signed(np.array(kind, np.uint64)), pa.int64(), mask=np.array(n, np.int64) == 0),
                 pa.array(signs, pa.binary())], ["id", "hash", "n", "class", "sign"])

    return run


def _keys(batches):
    for batch in batches:
        signs = np.frombuffer(b"".join(batch.column("sign").to_pylist()), "<u2").reshape(-1, CHUNKS, CHUNK)
        keys = np.empty((len(signs), CHUNKS, CHUNK), np.uint64)
        for chunk in range(CHUNKS):
            for gone in range(CHUNK):
                four = np.delete(signs[:, chunk], gone, axis=1).astype(np.uint64)
                packed = four @ np.array([1, 1 << 16, 1 << 32, 1 << 48], np.uint64)
                keys[:, chunk, gone] = K.mixed(packed, 100 + chunk * CHUNK + gone)
        yield pa.RecordBatch.from_arrays(
            [pa.array(K.signed(keys.reshape(-1)), pa.int64()),
             pa.array(np.repeat(batch.column("class").to_numpy(), SYMBOLS), pa.int64())], ["key", "class"])


def _near(percent: int):
    def run(batches):
        for batch in batches:
            signs = [np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, SYMBOLS)
                     for c in ("sign_a", "sign_b")]
            n = [batch.column(c).to_numpy() for c in ("n_a", "n_b")]
            keep = ((signs[0] != signs[1]).sum(axis=1) <= FAR) & \
                (100 * np.minimum(*n) >= percent * np.maximum(*n))
            yield batch.select(["a", "b", "n_a", "n_b", "members"]).filter(pa.array(keep))

    return run


def candidates(classes: DataFrame, buckets: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of classes to confirm, from buckets with ``members`` members and a leader."""
    pair = (buckets.where(F.col("members") <= SMALL).groupBy("key")
            .agg(F.sort_array(F.collect_list("class")).alias("own"), F.max("members").alias("members"))
            .select("members", F.explode(F.flatten(F.transform("own", lambda x, i: F.transform(
                F.slice("own", i + 2, F.size("own")),
                lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("pair"))
            .select("pair.a", "pair.b", "members"))
    star = (buckets.where((F.col("members") > SMALL) & (F.col("class") != F.col("leader")))
            .select(F.col("class").alias("a"), F.col("leader").alias("b"), "members"))
    found = pair.union(star).groupBy("a", "b").agg(F.max("members").alias("members"))
    side = lambda c: classes.select(
        F.col("class").alias(c), F.col("n").alias(f"n_{c}"), F.col("sign").alias(f"sign_{c}"))
    return found.join(side("a"), "a").join(side("b"), "b").mapInArrow(
        _near(percent), "a long, b long, n_a long, n_b long, members long")


def _sets(words: int):
    def run(batches):
        for batch in batches:
            sets = []
            for text, kind in zip(K.as_bytes(batch.column("text")), batch.column("class").to_pylist()):
                s = shingles(text, words)
                same = len(s) > 0 and int(K.signed(np.array([class_of(s)], np.uint64))[0]) == kind
                sets.append(_packed(s) if same else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("class"), batch.column("n"), pa.array(sets, pa.binary())],
                ["class", "n", "own"]).filter(pa.array([x is not None for x in sets]))

    return run


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            keep = [_linked(_common(_unpacked(x), _unpacked(y)), na, nb, percent) for x, y, na, nb in zip(
                *(batch.column(c).to_pylist() for c in ("own_a", "own_b", "n_a", "n_b")))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity; a leader's set is dealt to each part of its pairs."""
    parts = F.ceil(F.col("members") / LEADER_ROWS).cast("int")
    leaders = (pairs.groupBy("b").agg(F.max(parts).alias("parts"))
               .select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")))
    own_b = sets.select(F.col("class").alias("b"), F.col("own").alias("own_b")).join(leaders, "b")
    own_a = sets.select(F.col("class").alias("a"), F.col("own").alias("own_a"))
    return (pairs.withColumn("part", F.pmod(F.xxhash64("a"), parts).cast("int"))
            .join(own_a, "a").join(own_b, ["b", "part"])
            .mapInArrow(_confirm(percent), "a long, b long"))


def _forest(batches):
    """Spanning stars (member, root) of the links of every ``FOREST_LINKS`` rows."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def stars() -> pa.RecordBatch:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        for a, b in held:
            for x, y in zip(a.tolist(), b.tolist()):
                x, y = find(x), find(y)
                if x != y:
                    root[max(x, y)] = min(x, y)
        held.clear()
        pairs = [(x, r) for x in list(root) if (r := find(x)) != x]
        a, b = zip(*pairs) if pairs else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    n = 0
    for batch in batches:
        held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
        n += batch.num_rows
        if n >= FOREST_LINKS:
            yield stars()
            n = 0
    if held:
        yield stars()


def components(links: DataFrame, order: DataFrame, name: str) -> DataFrame:
    """(class, least, root) of every linked class: the smallest id of its component and that class.

    ``order`` has (class, least), the id by which classes are compared. The links of a task are first cut
    to spanning stars. Labels then spread along them and jump to the label of their root, so the rounds grow
    with the logarithm of a chain's length. Each round is written, so a lost executor costs one round.
    """
    stars = links.select("a", "b").where("a <> b").mapInArrow(_forest, "a long, b long")
    both = written(stars.union(stars.select("b", "a")).distinct(), f"{name}-links")
    labels = written(both.select(F.col("a").alias("class")).distinct().join(order.select("class", "least"), "class")
                     .select("class", "least", F.col("class").alias("root"), F.lit(True).alias("moved")),
                     f"{name}-labels")
    label: Column = F.struct("least", "root")
    while not labels.where("moved").isEmpty():
        near = (both.join(labels.select(F.col("class").alias("b"), label.alias("label")), "b")
                .groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "class"))
        spread = labels.join(near, "class").select(
            "class", label.alias("old"), F.least(label, F.col("near")).alias("new"))
        roots = spread.select(F.col("class").alias("at"), F.col("new").alias("far"))
        labels = written(
            spread.join(roots, F.col("new.root") == F.col("at"))
            .select("class", "old", F.least("new", "far").alias("new"))
            .select("class", "new.least", "new.root", (F.col("new") != F.col("old")).alias("moved")),
            f"{name}-labels")
    return labels.select("class", "least", "root")


def _blocks(percent: int):
    def run(key, few, many):
        x = few.to_pylist()
        sets = [_unpacked(r["own"]) for r in x]
        value = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(value, kind="stable")
        value, owner = value[order], owner[order]
        n = np.array([r["n"] for r in x], np.int64)
        comp = np.array([r["comp"] for r in x], np.int64)
        a, b, seen = [], [], set()
        for y in many.to_pylist():
            own = _unpacked(y["own"])
            begin, end = np.searchsorted(value, own, "left"), np.searchsorted(value, own, "right")
            size = end - begin
            at = np.repeat(begin - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            shared = np.bincount(owner[at], minlength=len(sets))
            for i in np.flatnonzero((100 * shared >= percent * (n + y["n"] - shared)) & (comp != y["comp"])):
                if (i, y["comp"]) not in seen:
                    seen.add((i, y["comp"]))
                    a.append(x[i]["class"])
                    b.append(y["class"])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def rest_of_buckets(buckets: DataFrame, labels: DataFrame, sets: DataFrame, order: DataFrame,
                    percent: int) -> DataFrame | None:
    """Links inside large buckets that the leaders did not show; None where all are in one component.

    Large buckets that hold several components, joined where they share members, are searched whole: the members
    outside the largest component against all members.
    """
    large = buckets.where(F.col("members") > SMALL)
    known = large.join(labels.select("class", "root"), "class", "left").select(
        "key", "class", "leader", F.coalesce("root", "class").alias("comp"))
    # a table of its own, so that the members of a hot key need not be dealt by key again
    split = written(known.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
                    .where("lo <> hi").select("key"), "split-keys")
    open_ = written(known.join(split, "key"), "open-buckets")
    if not open_.limit(1).count():
        return None
    joined = components(open_.select(F.col("class").alias("a"), F.col("leader").alias("b")).where("a <> b"),
                        order, "open")
    members = written(open_.select("class", "comp").distinct()
                      .join(joined.select("class", F.col("root").alias("place")), "class"), "open-members")
    sizes = members.groupBy("place", "comp").count()
    top = sizes.groupBy("place").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"),
                                     F.sum("count").alias("total"), F.max("count").alias("most"))
    top = written(top.select("place", "main", F.ceil((F.col("total") - F.col("most")) / BLOCK_ROWS).alias("few_parts"),
                             F.ceil(F.col("total") / BLOCK_ROWS).alias("many_parts")), "open-places")
    rows = members.join(top, "place").join(sets.select("class", "n", "own"), "class")
    spot = lambda parts: F.pmod(F.xxhash64("class"), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), (F.col(parts) - 1).cast("int")))
    cut = ["class", "n", "comp", "own"]
    few = (rows.where("comp <> main").withColumn("x", spot("few_parts"))
           .withColumn("y", every("many_parts")).select("place", "x", "y", *cut))
    many = (rows.withColumn("y", spot("many_parts"))
            .withColumn("x", every("few_parts")).select("place", "x", "y", *cut))
    many = many.toDF(*many.columns)  # columns of their own: both sides come from the same rows
    return few.groupBy("place", "x", "y").cogroup(many.groupBy("place", "x", "y")).applyInArrow(
        _blocks(percent), "a long, b long")


def _ordered(column: str) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def _reached(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """A row per document: ``id, hash, n, class``, the ``component`` (smallest id) and its ``root`` class."""
    if not 80 <= percent <= 100:
        raise ValueError("percent must be from 80 to 100")
    # id and hash together name a text, so null or repeated ids do not gather in one place
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"), "text")
    signed = written(rows.mapInArrow(_sign(words), "id long, hash long, n long, class long, sign binary"),
                     "signatures")
    classes = written(signed.where("class IS NOT NULL").groupBy("class").agg(
        F.min(F.struct(_ordered("id").alias("id"), "hash")).alias("own"), F.first("n").alias("n"), F.first("sign").alias("sign"))
        .select("class", F.col("own.id").alias("least"), F.col("own.hash").alias("hash"), "n", "sign"), "classes")
    order = classes.select("class", "least")
    keyed = classes.select("class", "sign").mapInArrow(_keys, "key long, class long")
    shared = written(keyed.groupBy("key").agg(F.count("*").alias("members"), F.min("class").alias("leader"))
                     .where("members > 1"), "shared-keys")
    buckets = written(keyed.join(shared, "key"), "buckets")
    pairs = written(candidates(classes, buckets, percent), "pairs")
    wanted = (pairs.select(F.col("a").alias("class")).union(pairs.select("b"))
              .union(buckets.where(F.col("members") > SMALL).select("class")).distinct()
              .join(classes.select("class", "n", F.col("least").alias("id"), "hash"), "class"))
    texts = rows.withColumn("id", _ordered("id"))
    sets = written(texts.join(wanted.hint("shuffle_hash"), ["id", "hash"]).mapInArrow(
        _sets(words), "class long, n long, own binary").dropDuplicates(["class"]), "sets")
    links = written(confirmed(pairs, sets, percent), "links")
    labels = components(links, order, "components")
    more = rest_of_buckets(buckets, labels, sets, order, percent)
    if more is not None:
        more = written(more, "more-links")
        if more.limit(1).count():
            labels = components(links.union(more), order, "components")
    reach = written(
        order.join(labels.select("class", F.col("least").alias("far"), "root"), "class", "left")
        .select("class", F.coalesce("far", "least").alias("component"), F.coalesce("root", "class").alias("root")),
        "reach")
    return signed.join(reach, "class", "left").select(
        "id", "hash", "n", "class", F.coalesce("component", _ordered("id")).alias("component"), "root")


def groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """A row per document: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked where ``100 * intersection >= percent * union`` of their sets of distinct word
    shingles; a component's id is its smallest doc_id. A text of fewer words is one shingle; a null, empty
    or blank one has none and is linked with nothing. Repeated rows are documents of their own
    and meet in one component. A null doc_id is never the smallest unless its component has no
    other, and is then the component's id; ``kept`` is true where doc_id and component_id are equal, two nulls
    included. The index is laid out for similarities of 0.8 or more.
    """
    return _reached(docs, words, percent).select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.col("component") != NO_ID, F.col("component")).otherwise(F.col("id")).alias("component_id"),
        (_ordered("id") == F.col("component")).alias("kept"))


def representatives(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the smallest doc_id.

    Rows are told apart by their texts, so null or repeated ids neither drop nor keep a row. A group without ids keeps
    one row too. Documents without words are linked with nothing and all stay. Of several texts of a group with
    the smallest id one stays, and of repeated rows one.
    """
    kept = written(_reached(docs, words, percent).where("class IS NOT NULL")
                   .groupBy("root", _ordered("id").alias("id"), "hash").count()
                   .groupBy("root").agg(F.min(F.struct("id", "hash", "count")).alias("own"))
                   .select(F.col("own.id").alias("__id"), F.col("own.hash").alias("__hash"),
                           F.col("own.count").alias("__rows")), "kept-texts")
    worded = F.coalesce(F.col("text").rlike(r"[^ \t\n\x0B\f\r]"), F.lit(False))
    own = docs.where(worded).withColumns({"__id": _ordered("doc_id"), "__hash": F.xxhash64("text")})
    found = own.join(kept.hint("shuffle_hash"), ["__id", "__hash"])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = found.where("__rows = 1").select(*columns).union(docs.where(~worded))
    if kept.where("__rows > 1").isEmpty():
        return once
    return once.union(found.where("__rows > 1").dropDuplicates(["__id", "__hash"]).select(*columns))

"""Ranked lexical search with bag deduplication.

Documents are restricted to the words of the items: what counts is the vector of term counts and the length class m.
Documents with the same vector and m score alike for every item, so they form a class; classes are found by hash
and verified by the vectors themselves. Blocks of classes are scored against all items of a part, each class once. A class
stands for its k smallest doc_ids, which is all that a list of k can show of it, and is expanded by ascending doc_id.

The items travel to the tasks in parts of a bounded number of terms. A task keeps the k best classes per item, so what is
shuffled after scoring does not grow with the documents of a task.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fitlake.session import written

#: Terms of the items of one part, about; a part is held by the driver and by every worker.
PART_TERMS = 100_000
#: Longer terms are replaced by a 128-bit hash, which bounds a part in bytes.
LONG_TERM = 64
#: Postings scored at a time in a worker.
BLOCK_POSTINGS = 1 << 20
# all separators to blanks, A-Z to a-z; bytes from 0x80 on belong to non-ASCII characters, which are parts of terms
_FOLD = bytes(c if c > 0x7F or chr(c).isalnum() else 0x20 for c in range(256)).lower()
_BAGS = "doc_id long, n long, bag binary"


def terms(text: bytes | str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased; null has none."""
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(_FOLD).split()


def _key(term: bytes) -> bytes:
    return term if len(term) <= LONG_TERM else b"\0" + xxhash.xxh3_128_digest(term)


def item_parts(items: DataFrame, part_terms: int | None = None) -> tuple[DataFrame, int]:
    """Distinct (item_id, terms) with their number of copies and their part; the number of parts.

    The length of the texts bounds their number of terms, so parts are about as small as asked, whatever the table.
    """
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // (4 * (part_terms or PART_TERMS))))
    rows = (items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).groupBy("item_id", "text")
            .agg(F.count("*").alias("copies")))
    return rows.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).cast("int")), parts


def _bags(vocabulary: dict[bytes, int]):
    """(doc_id, n, bag): number of terms of each whole text, and its known terms with counts, packed and sorted by term."""
    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            sizes, bags = [], []
            for at in range(batch.num_rows):  # one text at a time: a batch may hold very long ones
                words = terms(texts[at].as_py())
                held = Counter(words)
                known = sorted((vocabulary[k], c) for w, c in held.items() if (k := _key(w)) in vocabulary)
                sizes.append(len(words))
                bags.append(np.array(known, "<i8").reshape(-1, 2).T.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(bags, pa.binary())], ["doc_id", "n", "bag"])

    return run


def _held_by(size: int):
    """(term, n): in how many bags of a partition each term is."""
    def run(batches):
        seen = np.zeros(size, np.int64)
        for batch in batches:
            for bag in batch.column("bag"):
                pairs = np.frombuffer(bag.as_py(), "<i8")
                seen[pairs[:len(pairs) // 2]] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at])], ["term", "n"])

    return run


def contributions(weight: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """w * ((1000000000 * tf) div (1000 * tf + 8 * m)) in 64-bit integers."""
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def class_scores(postings: np.ndarray, classes: np.ndarray, size: int) -> np.ndarray:
    """Sums of integer contributions by class, exact: the low and the high half apart."""
    low = np.bincount(classes, postings & 0x3FFFFF, size)
    high = np.bincount(classes, postings >> 22, size)
    return (high.astype(np.int64) << 22) + low.astype(np.int64)


def _best(score: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0, equal ones by ascending first member."""
    live = np.flatnonzero(score > 0)
    if len(live) > k:
        least = np.partition(score[live], -k)[-k]
        live = live[score[live] >= least]
    return live[np.lexsort((first[live], -score[live]))][:k]


_LAST = np.iinfo(np.int64).max  # order of a null doc_id


def _scored(items: list[list[int]], weights: np.ndarray, k: int):
    """(item, score, members) of the k best classes per item of a partition of classes (m, bag, members)."""
    def block(rows, best):
        sizes = [len(bag) // 16 for _, bag, _ in rows]
        if not sum(sizes):
            return
        term = np.concatenate([np.frombuffer(bag, "<i8")[:n] for (_, bag, _), n in zip(rows, sizes)])
        tf = np.concatenate([np.frombuffer(bag, "<i8")[n:] for (_, bag, _), n in zip(rows, sizes)])
        owner = np.repeat(np.arange(len(rows)), sizes)
        value = contributions(weights[term], tf, np.array([m for m, _, _ in rows], np.int64)[owner])
        first = np.array([_LAST if ids[0] is None else ids[0] for _, _, ids in rows], np.int64)
        order = np.argsort(term, kind="stable")
        term, value, owner = term[order], value[order], owner[order]
        start = np.searchsorted(term, np.arange(len(weights) + 1))
        for number, own in enumerate(items):
            spans = [np.arange(start[t], start[t + 1]) for t in own if start[t] < start[t + 1]]
            if not spans:
                continue
            at = np.concatenate(spans)
            score = class_scores(value[at], owner[at], len(rows))
            top = _best(score, first, k)
            found = best.get(number, []) + [(int(score[c]), rows[c][2]) for c in top]
            best[number] = sorted(found, key=lambda x: (-x[0], _LAST if x[1][0] is None else x[1][0]))[:k]

    def run(batches):
        best: dict[int, list] = {}
        rows, held = [], 0
        for batch in batches:
            for at in range(batch.num_rows):
                rows.append((batch.column("m")[at].as_py(), batch.column("bag")[at].as_py(),
                             batch.column("members")[at].as_py()))
                held += len(rows[-1][1]) // 16
                if held >= BLOCK_POSTINGS:
                    block(rows, best)
                    rows, held = [], 0
        block(rows, best)
        flat = [(i, s, ids) for i, found in best.items() for s, ids in found]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in flat], pa.int64()), pa.array([x[1] for x in flat], pa.int64()),
             pa.array([x[2] for x in flat], pa.list_(pa.int64()))], ["item", "score", "members"])

    return run


def classes_of(bags: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(hash, m, bag, members): classes of equal bags and m, with their k smallest doc_ids in order, nulls last.

    Rows meet by hash, and only rows whose m and bag are equal byte by byte form a class. A large class loses all but k
    members per task before it is shuffled.
    """
    m = F.expr(f"CAST(10 + (CAST(n AS DECIMAL(20)) * {90 * n_docs} div {n_terms}) AS BIGINT)")
    rows = bags.where(F.octet_length("bag") > 0).select("doc_id", m.alias("m"), "bag").withColumn(
        "hash", F.xxhash64("m", "bag"))
    key = ["hash", "m", "bag"]
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("doc_id").asc_nulls_last()))
    few = rows.withColumn("rank", rank).where(F.col("rank") <= k)
    # null doc_ids stay in the list as they are wrapped
    members = F.array_sort(F.collect_list(F.struct("rank", "doc_id")))
    return few.groupBy(*key).agg(members.alias("members")).withColumn(
        "members", F.transform("members", lambda x: x["doc_id"]))


def _part(docs: DataFrame, own: list, k: int) -> DataFrame:
    """Results of the items of one part: (item_id, copy, rank, doc_id, score)."""
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    numbers = [[vocabulary.setdefault(_key(t), len(vocabulary)) for t in dict.fromkeys(terms(r.text))] for r in own]
    bags = written(docs.mapInArrow(_bags(vocabulary), _BAGS), "bags")
    n_docs, n_terms = bags.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
    table = [(i, r.item_id, r.copies) for i, r in enumerate(own)]
    named = spark.createDataFrame(table, f"item int, item_id {own[0].kind}, copies long")
    if not n_docs or not vocabulary:
        return named.limit(0).selectExpr("item_id", "0L AS copy", "0 AS rank", "0L AS doc_id", "0L AS score")
    held = np.zeros(len(vocabulary), np.int64)
    counts = bags.select("bag").mapInArrow(_held_by(len(vocabulary)), "term long, n long")
    weights = counts.groupBy("term").agg(F.sum("n").alias("df")).select("term", F.floor(
        1000 * F.ln(F.lit(float(2 * n_docs + 2)) / (2.0 * F.col("df") + 1))).alias("w"))
    for r in weights.collect():  # one row per term of the part
        held[r.term] = r.w
    best = classes_of(bags, n_docs, n_terms, k).select("m", "bag", "members").mapInArrow(
        _scored(numbers, held, k), "item long, score long, members array<long>")
    # of the classes of all tasks, the k best per item hold all of its list
    first = F.col("members")[0].asc_nulls_last()
    top = best.withColumn("__at", F.row_number().over(
        Window.partitionBy("item").orderBy(F.col("score").desc(), first))).where(F.col("__at") <= k)
    rows = top.select("item", "score", "__at", F.posexplode("members").alias("__no", "doc_id"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(
        F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "__at", "__no"))
    ranked = rows.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.join(F.broadcast(named), "item").select(
        "item_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"), "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, part_terms: int | None = None) -> DataFrame:
    """The k best documents (doc_id, text) of each item (item_id, text): item_id, rank, doc_id, score.

    Scores are sums over the item's distinct terms of w * ((1000000000 * tf) div (1000 * tf + 8 * m)); equal scores go
    by ascending doc_id, null ids last. A null or empty text has no terms: such a document is in no list, such an item has no
    rows. Repeated rows of ``docs`` are documents of their own; repeated items have a list each. Empty tables give no rows.
    Other columns are not looked at.
    """
    kind = dict(items.dtypes)["item_id"]
    rows, parts = item_parts(items, part_terms)
    rows = rows.withColumn("kind", F.lit(kind))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for part in range(parts):  # a part's items, and what comes of them, are written before the next one
        own = rows.where(F.col("part") == part).orderBy("item_id", "text").collect()
        if own:
            out = written(_part(docs, own, k), "lists")
            found = out if found is None else found.unionByName(out)
    if found is None:
        found = rows.selectExpr("item_id", "0 AS rank", "0L AS doc_id", "0L AS score").limit(0)
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", F.col("score").cast("long").alias("score"))

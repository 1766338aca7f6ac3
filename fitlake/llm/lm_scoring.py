"""Language-model scoring of documents.

Counts of all words of all training documents give the base score and the probabilities of words inside the
kinds of rare words. A gated recurrent network over the frequent words and the kinds starts from these counts and is
trained in rounds: a round takes the next share of all training documents, every partition goes on from the common
weights with its own, and the weights are averaged by tokens. Each training document is learnt from once. Each block of documents asks for the counts of its distinct words, and scores whole texts
with the state carried across windows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitlake.llm import common as K
from fitlake.llm import gru
from fitlake.llm.quality import remainder
from fitlake.session import written

BLOCK_BYTES = 16 << 20
#: Learning rate of each round; the documents are dealt to the rounds by hash.
RATES = (0.02, 0.008, 0.004)
#: Tokens that a lane of training runs through without a new start; longer documents train in stretches.
STRETCH = 2048
#: Tokens of a partition that are trained on together.
TRAIN_TOKENS = 4_000_000
PARTS = 64
ADDED = ("n_tokens", "n_known", "base_score", "score")


def tokens_of(texts: pa.Array | pa.ChunkedArray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of texts, all tokens by number, and how many each text has.

    The tokens of a text are its words and its end, which is the empty word.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(pa.chunked_array(texts).fill_null("")))
    coded = pc.list_flatten(split).dictionary_encode().unify_dictionaries()
    lengths = pc.list_value_length(split).to_numpy().astype(np.int64)
    number = np.concatenate([np.zeros(0, np.int32), *(c.indices.to_numpy() for c in coded.chunks)])
    words = coded.chunk(0).dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist() if coded.num_chunks else []
    if b"" in words:  # beside white space at an edge of a text, which is no word
        end = words.index(b"")
        there = number != end
        lengths = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[there], minlength=len(lengths))
        number = number[there]
    else:
        end = len(words)
        words.append(b"")
    return words, np.insert(number, np.cumsum(lengths), end), lengths + 1


def _by_text(values: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    return np.split(values, np.cumsum(lengths)[:-1]) if len(lengths) else []


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _count(docs: pa.Table) -> pa.Table:
    """The distinct words of a block, with how often its training documents hold each."""
    words, ids, lengths = tokens_of(docs["text"])
    learn = np.repeat(docs["learn"].to_numpy(), lengths)
    return pa.table({"block": pa.repeat(docs["block"][0], len(words)), "h": pa.array(K.signed(_hashes(words)), pa.int64()),
                     "kind": pa.array(gru.kinds_of(words), pa.int32()),
                     "n": pa.array(np.bincount(ids[learn], minlength=len(words)), pa.int64())})


class Model:
    """Frequent words by hash, the totals of each kind of other words, and the network's weights."""

    def __init__(self, hashes: list[int], counts: list[int], kinds: dict[int, tuple[int, int]], total: int,
                 distinct: int):
        self.shape = gru.Shape(len(hashes))
        h = K.unsigned(np.array(hashes, np.int64))
        order = np.argsort(h)
        self.sorted, self.token = h[order], order.astype(np.int32)
        self.counts = np.array(counts, np.int64)
        self.mass = np.zeros((gru.KINDS, 2))
        for kind, row in kinds.items():
            self.mass[kind] = row
        self.total, self.distinct = total, distinct
        self.weights = gru.initial(self.shape, counts=np.r_[self.counts, self.mass[:, 0]])

    def tokens(self, h: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Number of each word: its own for frequent words, else that of its kind."""
        if not len(self.sorted):
            return (kinds + self.shape.words).astype(np.int32)
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        return np.where(self.sorted[at] == h, self.token[at], kinds + self.shape.words).astype(np.int32)


def _documents(model: Model, texts: pa.Array) -> list[np.ndarray]:
    words, ids, lengths = tokens_of(texts)
    return _by_text(model.tokens(_hashes(words), gru.kinds_of(words))[ids], lengths)


def _trained(model: Model, rate: float):
    def run(batches):
        weights, seen = model.weights, 0
        held: list[np.ndarray] = []
        size = 0

        def learn() -> None:
            nonlocal weights, seen, held, size
            if held:
                weights, n = gru.train(model.shape, weights, held, rate)
                seen, held, size = seen + n, [], 0

        for batch in batches:
            for d in _documents(model, batch.column("text")):
                held += [d[at:at + STRETCH] for at in range(0, len(d), STRETCH)]
                size += len(d)
            if size >= TRAIN_TOKENS:
                learn()
        learn()
        if seen:
            cut = np.array_split(weights.astype("<f8") * seen, PARTS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(PARTS), pa.int32()), pa.array([c.tobytes() for c in cut], pa.binary()),
                 pa.array([seen] * PARTS, pa.int64())], ["part", "sum", "seen"])

    return run


def _added(key, rows):
    total = sum(np.frombuffer(r, "<f8") for r in rows["sum"].to_pylist())
    seen = sum(rows["seen"].to_pylist())
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()),
                     "mean": pa.array([(total / seen).tobytes()], pa.binary())})


def _averaged(rows: DataFrame, weights: np.ndarray) -> np.ndarray:
    """Mean of the partitions' weights by tokens; the weights as they are where nothing was trained."""
    got = sorted(rows.groupBy("part").applyInArrow(_added, "part int, mean binary").collect())
    return np.concatenate([np.frombuffer(r["mean"], "<f8") for r in got]).astype(np.float32) if got else weights


def fit(docs: DataFrame, counts: DataFrame, learn: Column) -> Model:
    """The model from the counts of all training words (h, kind, n) and from all training documents."""
    known = counts.where("n > 0")
    totals = known.agg(F.sum("n").alias("total"), F.count("*").alias("distinct")).first()
    # words of a kind stand together, so that a class holds like words
    top = known.orderBy(F.desc("n"), "h").limit(gru.VOCABULARY).collect()
    top.sort(key=lambda r: (r["kind"], -r["n"], r["h"]))
    kinds = {r["kind"]: [r["n"], r["words"]] for r in
             known.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()}
    for r in top:
        kinds[r["kind"]][0] -= r["n"]
        kinds[r["kind"]][1] -= 1
    model = Model([r["h"] for r in top], [r["n"] for r in top], kinds, totals["total"] or 0, totals["distinct"])
    share = F.pmod(F.xxhash64(F.lit("round"), "doc_id", "text"), F.lit(len(RATES)))
    for i, rate in enumerate(RATES):
        own = docs.where(learn & (share == i)).select("text")
        model.weights = _averaged(own.mapInArrow(_trained(model, rate), "part int, sum binary, seen long"), model.weights)
    return model


def _scored(model: Model, names: list[str]):
    def run(key, docs, counts):
        order = np.argsort(K.unsigned(counts["h"].to_numpy()))
        known, c = K.unsigned(counts["h"].to_numpy())[order], counts["c"].to_numpy()[order]
        words, ids, lengths = tokens_of(docs["text"])
        h, kinds = _hashes(words), gru.kinds_of(words)
        count = np.zeros(len(h), np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            count = np.where(known[at] == h, c[at], 0)
        token = model.tokens(h, kinds)
        base = np.log10((count + 0.5) / (model.total + 0.5 * (model.distinct + 1)))
        rare = token >= model.shape.words
        inside = np.where(rare, np.log10((count + 0.5) / (model.mass[kinds, 0] + 0.5 * (model.mass[kinds, 1] + 1))), 0)
        network = gru.score(model.shape, model.weights, _by_text(token[ids], lengths))
        row = np.repeat(np.arange(len(lengths)), lengths)
        rest = np.bincount(row, inside[ids], len(lengths))
        new = [pa.array(lengths, pa.int64()),
               pa.array(np.bincount(row[count[ids] > 0], minlength=len(lengths)), pa.int64()),
               pa.array(list(map(math.fsum, _by_text(base[ids], lengths))), pa.float64()),
               pa.array(np.array(network) / math.log(10) + rest, pa.float64())]
        return pa.Table.from_arrays([docs[n].combine_chunks() for n in names] + new, names=[*names, *ADDED])

    return run


def score(docs: DataFrame, by: int = 5, held: int = 1, carry: list[str] | None = None) -> tuple[DataFrame, int]:
    """Scores of every document, and the number of training tokens.

    The model learns from documents whose id remainder by ``by`` is not ``held``. Returns the columns ``carry`` of
    ``docs`` (all by default; those named like an added one are replaced) with ``n_tokens`` (words and
    one end), ``n_known`` (those of training words), ``base_score`` (smoothed unigrams) and ``score`` (the
    network's), both log10 probabilities of the whole text.

    A null or empty text is its end alone; a null id is a training row. Repeated rows are counted and
    scored as often as they are there. Without training rows the network keeps its initial weights and the counts
    are zero; an empty table gives no rows.
    """
    names = [c for c in (carry or docs.columns) if c.lower() not in ADDED]
    learn = remainder(by) != held
    blocks = K.groups_for(K.text_bytes(docs), BLOCK_BYTES)
    asked = written(
        docs.select("text", K.block_of(blocks).alias("block"), learn.alias("learn"))
        .groupBy("block").applyInArrow(_count, "block int, h long, kind int, n long"), "words")
    counts = written(asked.groupBy("h", "kind").agg(F.sum("n").alias("n")), "word-counts")
    model = fit(docs, counts, learn)
    answers = asked.select("block", "h").join(counts.select("h", F.col("n").alias("c")), "h").select("block", "h", "c")
    need = list(dict.fromkeys([*names, "text"]))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*names).schema)
    out = (docs.select(*need, K.block_of(blocks).alias(K.BLOCK)).groupBy(K.BLOCK)
           .cogroup(answers.groupBy("block")).applyInArrow(
               _scored(model, names), f"{schema}n_tokens long, n_known long, base_score double, score double"))
    return out, int(model.total)

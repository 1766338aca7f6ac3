"""Quality classifier: a linear support vector machine over n-gram indicators scaled by naive Bayes.

Indicators are hashed n-grams of two alphabets: three bytes of the text, and four or five steps of its
shape (runs of capitals, small letters, digits, blanks and single marks), the latter also at
the shares of the text they reach; repeated words are an indicator of their own. Each indicator is scaled
by the log ratio of its frequencies in the two classes, and a hinge-loss model is fitted on them by
dual coordinate descent. A logistic curve over held-out margins of the fit turns margins to scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitlake.llm import common as K

#: Hashed places: byte n-grams, then shape n-grams at each share, then repeated words.
BYTE_BITS, SHAPE_BITS = 17, 13
SHARES = (0.0, 0.01, 0.05, 0.2)
REPEATS = (0.02, 0.1, 0.3, 0.6)
BYTES, SHAPES = 1 << BYTE_BITS, 1 << SHAPE_BITS
PLACES = BYTES + len(SHARES) * SHAPES + len(REPEATS)
#: Labelled rows that the model is fitted on, at most; the rows with the smallest hash are taken.
FIT_ROWS = 6000
_KIND = np.arange(256, dtype=np.uint8)
_KIND[ord("a"):ord("z") + 1] = 1
_KIND[0x80:] = 1
_KIND[ord("A"):ord("Z") + 1] = 2
_KIND[ord("0"):ord("9") + 1] = 3


def _first(x: np.ndarray, stamp: np.ndarray) -> np.ndarray:
    """Distinct values of ``x``, in time linear in its length."""
    n = np.arange(len(x), dtype=np.int32)
    stamp[x] = n
    return x[stamp[x] == n]


def _repeated(raw: np.ndarray) -> float:
    """Share of words that equal the word before."""
    blank = (raw == 32) | (raw == 10)
    begin = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    if len(begin) < 4:
        return 0.0
    length = np.diff(np.r_[begin, len(raw)])
    spot = np.arange(len(raw)) - np.repeat(begin, length) if begin[0] == 0 else \
        np.r_[np.zeros(begin[0], np.int64), np.arange(begin[0], len(raw)) - np.repeat(begin, length)]
    value = np.where(blank, 0, raw.astype(np.uint64) * (spot.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                                                       + np.uint64(0xD6E8FEB86659FD93)))
    word = np.add.reduceat(value, begin)
    return float(np.mean(word[1:] == word[:-1]))


def indicators(text: bytes | None, stamp: np.ndarray) -> np.ndarray:
    """Places of the indicators that hold for a text, each once."""
    raw = np.frombuffer(text or b"", np.uint8)
    found = []
    if len(raw) >= 3:
        x = raw.astype(np.uint32)
        code = ((x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BYTE_BITS)
        found.append(_first(code.astype(np.int64), stamp))
    if len(raw):
        kind = _KIND[raw]
        run = kind[np.r_[True, kind[1:] != kind[:-1]]].astype(np.uint64)
        counts = np.zeros(SHAPES, np.int64)
        for size in (4, 5):
            if len(run) >= size:
                code = np.zeros(len(run) - size + 1, np.uint64)
                for k in range(size):
                    code = code * np.uint64(257) + run[k:len(run) - size + 1 + k]
                counts += np.bincount((K.mixed(code, size) >> np.uint64(64 - SHAPE_BITS)).astype(np.int64),
                                      minlength=SHAPES)
        share = counts / max(1, counts.sum() / 2)
        for level, least in enumerate(SHARES):
            found.append(np.flatnonzero((counts > 0) & (share >= least)) + BYTES + level * SHAPES)
        again = _repeated(raw)
        found.append(np.array([PLACES - len(REPEATS) + i for i, r in enumerate(REPEATS) if again >= r], np.int64))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


@dataclass
class Model:
    """Weight of each place, and the logistic curve from margins to scores."""
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, places: np.ndarray) -> float:
        margin = float(self.weights[places].sum()) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -35, 35))))


def dual_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: float,
                 rounds: int) -> tuple[np.ndarray, float]:
    """Weights and bias of a hinge-loss model over scaled indicators; a bias place holds one in every row."""
    w, bias = np.zeros(len(scale)), 0.0
    alpha = np.zeros(len(rows))
    values = [scale[r] for r in rows]
    norm = np.array([float(v @ v) + 1 for v in values])
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            slack = y[i] * (float(w[rows[i]] @ values[i]) + bias) - 1
            new = min(max(alpha[i] - slack / norm[i], 0.0), cost)
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(step) * norm[i])
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def _ratio(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    side = []
    for sign in (1, -1):
        own = [r for r, s in zip(rows, y) if s == sign]
        count = np.bincount(np.concatenate(own), minlength=PLACES) if own else np.zeros(PLACES)
        side.append((count + 1.0) / (len(own) + 2.0))
    return np.log(side[0] / side[1])


def _curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve, by Newton steps on smoothed targets."""
    up, down = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        g = np.array([((p - target) * margin).sum() + 1e-6 * a, (p - target).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * margin * margin).sum() + 1e-6, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, rounds: int = 30) -> Model:
    """Fit on indicator rows with labels 0 and 1.

    Without both classes the model scores the smoothed share of label 1 (one half without rows).
    """
    y = np.where(np.asarray(labels) > 0, 1.0, -1.0)
    if not len(rows) or abs(y.sum()) == len(y):
        share = (np.sum(y > 0) + 1) / (len(y) + 2)
        return Model(np.zeros(PLACES), 0.0, 1.0, float(np.log(share / (1 - share))))

    def trained(some: np.ndarray) -> tuple[np.ndarray, float]:
        own = [rows[i] for i in some]
        ratio = _ratio(own, y[some])
        # rows of unit length on average, so that the cost means the same for short and long texts
        ratio /= np.sqrt(np.mean([float(ratio[r] @ ratio[r]) for r in own])) or 1.0
        w, bias = dual_descent(own, ratio, y[some], cost, rounds)
        return w * ratio, bias

    fold = np.arange(len(rows)) % 3
    margin = np.zeros(len(rows))
    for k in range(3):
        w, bias = trained(np.flatnonzero(fold != k))
        for i in np.flatnonzero(fold == k):
            margin[i] = w[rows[i]].sum() + bias
    w, bias = trained(np.arange(len(rows)))
    return Model(w, bias, *_curve(margin, y))


# Spark ----------------------------------------------------------------------------------------

def remainder(by: int) -> Column:
    """crc32 of the doc_id as text, modulo ``by``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(by))


def _rows(batches):
    stamp = np.zeros(BYTES, np.int32)
    for batch in batches:
        places = [indicators(t, stamp).astype("<i4").tobytes() for t in K.as_bytes(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("key"),
                                          pa.array(places, pa.binary())], ["label", "key", "places"])


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = FIT_ROWS,
          by: int = 3, held: int = 1) -> Model:
    """Model of ``label`` from labelled documents whose id remainder is not the held-out one.

    At most ``fit_rows`` rows are taken, those with the smallest hash of the id; null labels are left
    out, and of several labels of one document the mean, rounded up at a half, holds. Only ids are
    dealt to choose the rows; their texts are picked out where they lie.
    """
    known = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("label")))
    rows = docs.where(remainder(by) != held)
    chosen = (rows.select("doc_id").join(known, "doc_id").groupBy("doc_id").agg(F.first("label").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows))
    chosen = (rows.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # fit_rows ids at most
              .select("label", "text", F.xxhash64("doc_id", "text").alias("key"))
              .orderBy("key").limit(fit_rows))
    got = chosen.select("label", "text", "key").mapInArrow(_rows, "label int, key long, places binary").collect()
    got.sort(key=lambda r: r["key"])
    return fit([np.frombuffer(r["places"], "<i4").astype(np.int64) for r in got],
               np.array([r["label"] for r in got], np.int64))


def _scored(model: Model, names: list[str], least: float | None):
    def run(batches):
        stamp = np.zeros(BYTES, np.int32)
        for batch in batches:
            score = [model.score(indicators(t, stamp)) for t in K.as_bytes(batch.column("text"))]
            if least is not None:
                yield batch.select(names).filter(pa.array([s >= least for s in score], pa.bool_()))
            else:
                yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(score, pa.float64())],
                                                 [*names, "score"])

    return run


def score(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` of ``docs`` (all by default) with ``score``, which replaces one of that name.

    A null or empty text has no indicators and gets the score of the bias alone. Rows are scored one by
    one, so repeated rows get equal scores; an empty table gives no rows.
    """
    names = [c for c in (carry or docs.columns) if c.lower() != "score"]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*names).schema)
    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(_scored(model, names, None), f"{schema}score double")


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with all columns as they are."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_scored(model, docs.columns, least), schema)

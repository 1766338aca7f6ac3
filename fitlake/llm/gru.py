"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

HIDDEN = 16
#: Frequent words with outputs of their own, and words per class of them.
VOCABULARY, CLASS = 1024, 64
#: Kinds of all other words: a script hint, the mark at the end and the length; one more for digits.
KINDS = 4 * 3 * 2 + 1
#: Columns of a softmax over the classes that are worked on together.
COLUMNS = 1024
_SCRIPTS = ({0xC3A9, 0xC3A8, 0xC3AA, 0xC3A7}, {0xC3B1, 0xC3B3, 0xC3AD}, {0xC3B6, 0xC3A4, 0xC3BC, 0xC39F})


def kinds_of(words: list[bytes]) -> np.ndarray:
    """Kind of each word by its make-up: a fixed partition of all words."""
    if not words:
        return np.zeros(0, np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    # each word is led by one letter of its own, so that none is empty
    text = np.frombuffer(b"a" + b"a".join(words), np.uint8)
    first = np.r_[0, np.cumsum(lengths[:-1] + 1)]
    digits = np.logical_or.reduceat((text >= 0x30) & (text <= 0x39), first)
    script = np.zeros(len(words), np.int64)
    high = np.flatnonzero(text[:-1] >= 0xC0)
    if len(high):
        pair = text[high].astype(np.int64) << 8 | text[high + 1]
        word = np.searchsorted(first, high, side="right") - 1
        for s in range(len(_SCRIPTS), 0, -1):
            script[word[np.isin(pair, list(_SCRIPTS[s - 1]))]] = s
    last = np.where(lengths > 0, text[first + lengths], 0x61)
    mark = np.where(((last >= 0x61) & (last <= 0x7A)) | (last >= 0x80), 0, np.where((last == 0x2E) | (last == 0x2C), 1, 2))
    return np.where(digits, KINDS - 1, (script * 3 + mark) * 2 + (lengths > 6))


@dataclass
class Shape:
    """Sizes of a model over ``words`` frequent words."""
    words: int

    @property
    def groups(self) -> int:
        return -(-self.words // CLASS)

    @property
    def classes(self) -> int:
        return self.groups + KINDS

    @property
    def start(self) -> int:
        return self.words + KINDS

    def arrays(self) -> dict[str, tuple[int, ...]]:
        h = HIDDEN
        return {"x": (self.start + 1, 3 * h), "u": (h, 3 * h), "bn": (h,), "wc": (h, self.classes),
                "bc": (self.classes,), "ww": (self.groups, h, CLASS), "bw": (self.groups, CLASS)}


def unpack(shape: Shape, flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, size in shape.arrays().items():
        n = int(np.prod(size))
        out[name] = flat[at:at + n].reshape(size)
        at += n
    return out


def initial(shape: Shape, seed: int = 11, counts: np.ndarray | None = None) -> np.ndarray:
    """First weights; with ``counts`` of the words and kinds the outputs start from their shares."""
    rng = np.random.default_rng(seed)
    sizes = shape.arrays()
    flat = np.zeros(sum(int(np.prod(s)) for s in sizes.values()), np.float32)
    p = unpack(shape, flat)
    for name in ("x", "u", "wc", "ww"):
        p[name][...] = rng.normal(0, 0.25 if name == "u" else 0.1, sizes[name])
    if counts is not None:
        own = np.zeros(shape.groups * CLASS)
        own[:shape.words] = counts[:shape.words] + 0.5
        own = own.reshape(shape.groups, CLASS)
        each = np.r_[own.sum(axis=1), counts[shape.words:] + 0.5]
        p["bc"][...] = np.log(each / each.sum())
        p["bw"][...] = np.log(np.maximum(own, 1e-9) / own.sum(axis=1, keepdims=True))
    if shape.words % CLASS:  # places of the last class that no word has
        p["bw"][-1, shape.words % CLASS:] = -1e4
    return flat


def lanes(lengths: np.ndarray, width: int) -> list[list[int]]:
    """Documents dealt to ``width`` lanes of about equal length, the longest lanes first."""
    import heapq

    heap = [(0, i) for i in range(min(width, max(1, len(lengths))))]
    out: list[list[int]] = [[] for _ in heap]
    total = np.zeros(len(out), np.int64)
    for d in np.argsort(-lengths, kind="stable"):
        load, i = heapq.heappop(heap)
        out[i].append(int(d))
        total[i] = load + lengths[d]
        heapq.heappush(heap, (int(total[i]), i))
    return [out[i] for i in np.argsort(-total, kind="stable")]


@dataclass
class Streams:
    """Tokens of documents in lanes, time first and ragged: those of time t stand from ``edge[t]`` to ``edge[t + 1]``.

    The longest lanes come first, so the lanes in use at a time are the first ones, and nothing is padded: memory is
    linear in the tokens, whatever the longest document.
    """
    source: np.ndarray
    token: np.ndarray
    place: np.ndarray
    begin: np.ndarray
    edge: np.ndarray
    width: int

    @property
    def steps(self) -> int:
        return len(self.edge) - 1

    def heads(self) -> tuple[np.ndarray, list[int]]:
        """Lanes that begin a document, by time, and where each time's stand among them."""
        at = np.flatnonzero(self.begin)
        return at - self.edge[np.searchsorted(self.edge, at, side="right") - 1], np.searchsorted(at, self.edge).tolist()

    @staticmethod
    def of(documents: list[np.ndarray], start: int, width: int) -> Streams:
        lengths = np.array([len(d) for d in documents], np.int64)
        dealt = [lane for lane in lanes(lengths, width) if lane]
        first = np.r_[0, np.cumsum(lengths)]
        size = np.array([int(lengths[lane].sum()) for lane in dealt], np.int64)
        steps = int(size.max()) if len(size) else 0
        edge = np.r_[0, np.cumsum(len(size) - np.searchsorted(size[::-1], np.arange(steps), side="right"))]
        total = int(size.sum())
        token, source = np.zeros(total, np.int32), np.full(total, start, np.int32)
        place, begin = np.zeros(total, np.int64), np.zeros(total, bool)
        for i, lane in enumerate(dealt):
            if not size[i]:
                continue
            row = np.concatenate([documents[d] for d in lane])
            own = edge[:len(row)] + i
            heads = own[np.cumsum(np.r_[0, lengths[lane[:-1]]])[lengths[lane] > 0]]
            token[own], source[own[1:]] = row, row[:-1]
            place[own] = np.concatenate([np.arange(first[d], first[d + 1]) for d in lane])
            source[heads], begin[heads] = start, True
        return Streams(source, token, place, begin, edge, len(dealt))


def _led(*size: int) -> np.ndarray:
    """Room for states, a row per unit and a column per lane, with a last row of ones that takes the biases."""
    out = np.empty((*size[:-1], HIDDEN + 1, size[-1]), np.float32)
    out[..., HIDDEN, :] = 1
    return out


def _biased(weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    return np.concatenate([weights, bias[..., None, :]], axis=-2)


def _forward(p: dict) -> tuple[np.ndarray, np.ndarray]:
    """Weights of states and of inputs as a step takes them; those of the gates are negated."""
    bias = np.zeros(3 * HIDDEN, np.float32)
    bias[2 * HIDDEN:] = p["bn"]
    u, x = _biased(p["u"], bias), p["x"].copy()
    for w in (u, x):
        np.negative(w[:, :2 * HIDDEN], out=w[:, :2 * HIDDEN])
    return u.T.copy(), x


def _step(u: np.ndarray, before: np.ndarray, a: np.ndarray, gates: np.ndarray, n: np.ndarray, after: np.ndarray) -> None:
    """One step of all lanes: states and gates have a row per unit and a column per lane.

    ``gates`` takes the two gates and the inner part, ``n`` the proposed state, ``after`` the new one.
    """
    k = HIDDEN
    np.matmul(u, before, out=gates)
    zr = gates[:2 * k]
    zr += a[:2 * k]
    np.exp(zr, out=zr)
    zr += 1
    np.reciprocal(zr, out=zr)
    np.multiply(zr[k:], gates[2 * k:], out=n)
    n += a[2 * k:]
    np.tanh(n, out=n)
    np.subtract(before[:k], n, out=after)
    after *= zr[:k]
    after += n


def _small(weights: np.ndarray) -> bool:
    """Whether no entry of a softmax can overflow: states lie between -1 and 1, the last row holds the biases."""
    bias = weights[..., -1, :]
    used = np.where(bias > -9e3, np.abs(bias), 0)  # places that no word has vanish
    return float((np.abs(weights[..., :-1, :]).sum(axis=-2) + used).max(initial=0)) < 80


def _softmax(x: np.ndarray, at: tuple, small: bool) -> tuple[np.ndarray, np.ndarray]:
    """Log-probability of the entry at ``at`` of each column; ``x`` becomes exponentials, summed in ``total``."""
    if not small:
        x -= x.max(axis=0)
    out = x[at]
    np.exp(x, out=x)
    total = x.sum(axis=0)
    return out - np.log(total), total


def _heads(p: dict) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the classes and of the words in them, with their biases."""
    return _biased(p["wc"], p["bc"]), _biased(p["ww"], p["bw"])


def _outputs(shape: Shape, of: tuple[np.ndarray, np.ndarray], h: np.ndarray, token: np.ndarray, grad: dict | None,
             weight: float):
    """Natural log-probability of each token (of its kind, for other words), and the gradient of h, whose last row is ones.

    Columns are sorted by class, so that a class is a slice.
    """
    k, (classes, words) = HIDDEN, of
    small = _small(classes), _small(words)
    group = np.where(token < shape.words, token // CLASS, token - shape.words + shape.groups).astype(np.int16)
    order = np.argsort(group, kind="stable")  # a radix sort
    edge = np.searchsorted(group[order], np.arange(shape.classes + 1)).tolist()
    own = [(g, a, b) for g, (a, b) in enumerate(zip(edge, edge[1:])) if a < b]
    h, token = np.take(h, order, axis=1), token[order]
    which = group[order].astype(np.intp)
    out = np.empty(len(token), np.float32)
    dh = None if grad is None else np.empty((k, len(token)), np.float32)
    for a in range(0, len(token), COLUMNS):  # as many as stay in a core's cache
        part = slice(a, a + COLUMNS)
        x = classes.T @ h[:, part]
        at = which[part], np.arange(x.shape[1])
        out[part], total = _softmax(x, at, small[0])
        if grad is not None:
            x[at] -= total
            scale = np.float32(weight) / total
            slope = (h[:, part] * scale) @ x.T
            grad["wc"] += slope[:k]
            grad["bc"] += slope[k]
            np.multiply(classes[:k] @ x, scale, out=dh[:, part])
    for g, a, b in own:
        if g >= shape.groups:
            break
        x = words[g].T @ h[:, a:b]
        at = token[a:b] % CLASS, np.arange(b - a)
        more, total = _softmax(x, at, small[1])
        out[a:b] += more
        if grad is not None:
            x[at] -= total
            scale = np.float32(weight) / total
            slope = (h[:, a:b] * scale) @ x.T
            grad["ww"][g] += slope[:k]
            grad["bw"][g] += slope[k]
            more = words[g, :k] @ x
            more *= scale
            dh[:, a:b] += more
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return out[back], None if dh is None else np.take(dh, back, axis=1)


def score(shape: Shape, flat: np.ndarray, documents: list[np.ndarray], width: int = 512,
          window: int = 8192) -> list[float]:
    """Natural log-probability of each document, its state carried from its first token to its last.

    Probabilities are taken for about ``window`` tokens at a time, so that a few long lanes do not make many small windows.
    """
    k, p = HIDDEN, unpack(shape, flat)
    u, x = _forward(p)
    of = _heads(p)
    s = Streams.of(documents, shape.start, width)
    value = np.zeros(len(s.token))
    heads, begun = s.heads()
    edge = s.edge.tolist()
    h = _led(s.width)
    h[:k] = 0
    gates, inner = np.empty((3 * k, s.width), np.float32), np.empty((k, s.width), np.float32)
    at = 0
    while at < s.steps:
        to = max(at + 1, int(np.searchsorted(s.edge, edge[at] + window, side="right")) - 1)
        from_, all_ = edge[at], slice(edge[at], edge[to])
        inputs = np.take(x, s.source[all_], axis=0)
        states = []
        for t in range(at, to):
            a, n = edge[t] - from_, edge[t + 1] - edge[t]
            if n < h.shape[1]:
                h = h[:, :n]
            if n < gates.shape[1]:
                gates, inner = np.empty((3 * k, n), np.float32), np.empty((k, n), np.float32)
            if begun[t] < begun[t + 1]:
                h = h.copy()
                h[:k, heads[begun[t]:begun[t + 1]]] = 0
            states.append(_led(n))
            _step(u, h, inputs[a:a + n].T, gates, inner, states[-1][:k])
            h = states[-1]
        value[s.place[all_]] = _outputs(shape, of, np.concatenate(states, axis=1), s.token[all_], None, 0.0)[0]
        at = to
    ends = np.cumsum([len(d) for d in documents])
    return [float(value[e - len(d):e].sum()) for e, d in zip(ends, documents)]


def train(shape: Shape, flat: np.ndarray, documents: list[np.ndarray], rate: float, width: int = 128,
          window: int = 32, rounds: int = 1) -> tuple[np.ndarray, int]:
    """New weights after ``rounds`` passes by truncated backpropagation, and the tokens of a pass.

    The state runs on from window to window of a document; gradients stop at a window's edge. A window has a column for
    each of its steps and lanes; those of lanes that end within it take no part in the loss, so their slopes are zero.
    """
    k = HIDDEN
    flat = flat.astype(np.float32).copy()
    p = unpack(shape, flat)
    s = Streams.of(documents, shape.start, width)
    heads, begun = s.heads()
    edge = s.edge.tolist()
    slope = np.zeros_like(flat)
    grad = unpack(shape, slope)
    mean, square, steps = np.zeros_like(flat), np.zeros_like(flat), 0
    for _ in range(rounds):
        h = np.zeros((k, s.width), np.float32)
        for at in range(0, s.steps, window):
            slope[...] = 0
            to = min(at + window, s.steps)
            all_, long, wide = slice(edge[at], edge[to]), to - at, edge[at + 1] - edge[at]
            size = edge[to] - edge[at]
            full = size == long * wide
            source = s.source[all_]
            if not full:
                count = np.diff(s.edge[at:to + 1])
                used = np.arange(size) + np.repeat(np.arange(long) * wide - (s.edge[at:to] - edge[at]), count)
                source = np.full(long * wide, shape.start, np.int32)
                source[used] = s.source[all_]
            u, x = _forward(p)
            inputs = np.take(x, source, axis=0).reshape(long, wide, 3 * k)
            before, after = _led(long, wide), _led(long, wide)
            gates, n = np.empty((long, 3 * k, wide), np.float32), np.empty((long, k, wide), np.float32)
            h = h[:, :wide]
            for i in range(long):
                before[i, :k] = h
                own = slice(begun[at + i], begun[at + i + 1])
                if own.start < own.stop:
                    before[i, :k, heads[own]] = 0
                h = after[i, :k]
                _step(u, before[i], inputs[i].T, gates[i], n[i], h)
            states = after.transpose(1, 0, 2).reshape(k + 1, -1)
            _, out = _outputs(shape, _heads(p), states if full else np.take(states, used, axis=1), s.token[all_], grad, 1 / size)
            if not full:
                out, there = np.zeros((k, long * wide), np.float32), out
                out[:, used] = there
            dh = np.ascontiguousarray(out.reshape(k, long, wide).transpose(1, 0, 2))
            # slopes by those of the new state: state before (as it is kept), inner part, gates, proposed state
            z, r, inner = (gates[:, i * k:(i + 1) * k] for i in range(3))
            slopes = np.empty((long, 5, k, wide), np.float32)
            slopes[:, 0] = z
            kept = 1 - z
            np.multiply(kept, 1 - n * n, out=slopes[:, 4])
            np.multiply(slopes[:, 4], r, out=slopes[:, 1])
            np.multiply((before[:, :k] - n) * z, kept, out=slopes[:, 2])
            np.multiply(slopes[:, 1] * inner, 1 - r, out=slopes[:, 3])
            to_before = np.concatenate([np.eye(k, dtype=np.float32), p["u"][:, 2 * k:], p["u"][:, :2 * k]], axis=1)
            rows = slopes.reshape(long, 5 * k, wide)
            for i in reversed(range(long)):
                slopes[i] *= dh[i]
                if i:
                    back = to_before @ rows[i, :4 * k]
                    own = slice(begun[at + i], begun[at + i + 1])
                    if own.start < own.stop:
                        back[:, heads[own]] = 0
                    dh[i - 1] += back
            states = np.matmul(before, rows[:, k:4 * k].transpose(0, 2, 1)).sum(axis=0)
            grad["u"][:, 2 * k:] += states[:k, :k]
            grad["u"][:, :2 * k] += states[:k, k:]
            grad["bn"] += states[k, :k]
            order = np.argsort(source.astype(np.int16), kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(source[order]) > 0])
            own = np.take(rows[:, 2 * k:].transpose(0, 2, 1).reshape(-1, 3 * k), order, axis=0)
            # added in pairs of units, as complex numbers, which halves the calls of the inner loop
            grad["x"][source[order[first]]] += np.add.reduceat(own.view(np.complex64), first).view(np.float32)
            norm = float(np.sqrt(slope @ slope))
            if norm > 1:
                slope /= norm
            steps += 1
            mean += 0.1 * (slope - mean)
            square += 0.001 * (slope * slope - square)
            root = float(np.sqrt(1 - 0.999 ** steps))
            flat -= rate * root / (1 - 0.9 ** steps) * mean / (np.sqrt(square) + 1e-8 * root)
    return flat, sum(len(d) for d in documents)

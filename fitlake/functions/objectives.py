"""Pointwise log-likelihoods: functions of Columns, combined by arithmetic."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitlake.functions.scalars import sigmoid, total

Number = float | Column


def _lit(x: Number) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def white_noise(xi: Sequence[Column], mu: Sequence[Number], log_sigma: Sequence[Number],
                dt: float) -> Column:
    return total([-_lit(s) + 0.5 * math.log(dt)
                  - (x - _lit(m)) * (x - _lit(m)) * dt / (2 * F.exp(2 * _lit(s)))
                  for x, m, s in zip(xi, mu, log_sigma)])


def gaussian_observation(seen: Sequence[Column], true: Sequence[Column],
                         var: Sequence[Number]) -> Column:
    return total([-0.5 * F.ln(_lit(v)) - (a - b) * (a - b) / (2 * _lit(v))
                  for a, b, v in zip(seen, true, var)])


def mix(weights: Sequence[Sequence[Number]], x: Sequence[Column]) -> list[Column]:
    return [total([_lit(w) * v for w, v in zip(row, x)]) for row in weights]


def mixing_se(weights, latent: Sequence[Column], seen: Sequence[Column]) -> Column:
    return -total([(p - s) * (p - s) for p, s in zip(mix(weights, latent), seen)])


def mixing_l1(weights, latent: Sequence[Column], seen: Sequence[Column]) -> Column:
    return -total([F.abs(p - s) for p, s in zip(mix(weights, latent), seen)])


def ou_terms(
    x: Sequence[Column], other: Sequence[Column], mu: Sequence[Number], sigma: Sequence[Number],
    tau: Sequence[Number], dt: float, drift: int = 1, finite_noise: bool = False,
    corrected: bool = False,
) -> tuple[Column, Column]:
    """Normaliser and quadratic term of the Ornstein–Uhlenbeck transition.

    ``other`` is the previous bin (``drift`` 1, forward) or the next one (-1, backward). With
    finite noise the normaliser scales with the time constant and the quadratic term does not,
    unless ``corrected``.
    """
    norm, quad = [], []
    for v, o, m, s, t in zip(x, other, mu, sigma, tau):
        s, t = _lit(s), _lit(t)
        norm.append(F.ln(s * F.sqrt(2 * dt / t if finite_noise else F.lit(2 * dt))))
        jump = v - o + drift * (o - _lit(m)) * dt / t
        scale = s * s / t if corrected and finite_noise else s * s
        quad.append(jump * jump / (4 * scale * dt))
    return total(norm), total(quad)


def ou(*args, **kwargs) -> Column:
    norm, quad = ou_terms(*args, **kwargs)
    return -norm - quad


def wc_step(u: Sequence[Column], drive: Sequence[Column], alpha: Sequence[Number],
            beta: Sequence[Number], h: Sequence[Number], w: Sequence[Sequence[Number]],
            dt: float) -> list[Column]:
    """One-step prediction of the rate model from the recorded previous bin."""
    rates = [sigmoid(v, _lit(b), _lit(t)) for v, b, t in zip(u, beta, h)]
    return [v + _lit(a) * dt * (-v + inp + i)
            for v, a, inp, i in zip(u, alpha, mix(w, rates), drive)]


def squared_error(predicted: Sequence[Column], seen: Sequence[Column], s: float = 1.0) -> Column:
    return -total([(p - u) / s * ((p - u) / s) for p, u in zip(predicted, seen)])


def lorentz(predicted: Sequence[Column], seen: Sequence[Column], s: float = 1.0) -> Column:
    return -total([F.ln(1 + (p - u) / s * ((p - u) / s)) for p, u in zip(predicted, seen)])


@dataclass(frozen=True)
class Objective:
    """A named objective ``f(**columns) -> Column``; arithmetic joins expressions and tags."""

    make: Callable[..., Column]
    tags: frozenset[str] = field(default_factory=frozenset)

    def __call__(self, **kwargs) -> Column:
        return self.make(**kwargs)

    def with_options(self, **kwargs) -> Objective:
        return Objective(functools.partial(self.make, **kwargs), self.tags)

    def _join(self, other, op) -> Objective:
        if isinstance(other, Objective):
            return Objective(lambda **kw: op(self.make(**kw), other.make(**kw)),
                             self.tags | other.tags)
        return Objective(lambda **kw: op(self.make(**kw), other), self.tags)

    def __add__(self, other):
        # the identity lets sum() start from 0
        return self if isinstance(other, int) and other == 0 else self._join(
            other, lambda a, b: a + b)

    __radd__ = __add__

    def __sub__(self, other):
        return self._join(other, lambda a, b: a - b)

    def __mul__(self, other):
        return self._join(other, lambda a, b: a * b)

    __rmul__ = __mul__

    def __truediv__(self, other):
        return self._join(other, lambda a, b: a / b)

    def __pow__(self, other):
        return self._join(other, lambda a, b: F.pow(a, b if isinstance(b, Column) else F.lit(b)))

    def __neg__(self):
        return Objective(lambda **kw: -self.make(**kw), self.tags)

    def __pos__(self):
        return self

    def __abs__(self):
        return Objective(lambda **kw: F.abs(self.make(**kw)), self.tags)


def mix_arrays(df: DataFrame, column: str, weights: Sequence[Sequence[float]],
               keys: Sequence[str]) -> DataFrame:
    """Product of a fixed matrix with an array column, one output row per matrix row."""
    products = [F.aggregate(
        F.zip_with(F.col(column).cast("array<double>"), F.array(*[F.lit(float(x)) for x in row]),
                   lambda x, w: x * w), F.lit(0.0), lambda acc, v: acc + v) for row in weights]
    return df.select(*keys, F.posexplode(F.array(*products)).alias("j", "value"))

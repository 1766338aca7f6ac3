"""Row-wise numeric expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(u: Column, beta: float | Column, h: float | Column) -> Column:
    return 1 / (1 + F.exp(-F.lit(beta) * (u - F.lit(h))))


def leak(u: Column) -> Column:
    return -u


def isclose(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def normal_pdf(x: Column, mu: float | Column, sigma: float | Column) -> Column:
    z = (x - F.lit(mu)) / F.lit(sigma)
    return F.exp(-0.5 * z * z) / (F.lit(sigma) * math.sqrt(2 * math.pi))


def normal_logpdf(x: Column, mu: float | Column, sigma: float | Column) -> Column:
    z = (x - F.lit(mu)) / F.lit(sigma)
    return -0.5 * z * z - F.ln(F.lit(sigma) * math.sqrt(2 * math.pi))


def lognormal_pdf(x: Column, mu: float | Column, sigma: float | Column) -> Column:
    return F.when(x > 0, normal_pdf(F.ln(x), mu, sigma) / x).otherwise(0.0)


def cdf(z: float) -> float:
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


def truncated_normal_pdf(x: Column, mu: float, sigma: float, lo: float, hi: float) -> Column:
    mass = cdf((hi - mu) / sigma) - cdf((lo - mu) / sigma)
    return F.when(x.between(lo, hi), normal_pdf(x, mu, sigma) / mass).otherwise(0.0)


def is_batched(Tb: Column, Tr: Column, T: Column) -> Column:
    """Updates are batched when batch and relaxation fit in the segment."""
    return Tb + Tr < T


def logit_interval(x: Column, lo: float, hi: float) -> Column:
    return F.ln((x - lo) / (hi - x))


def from_logit_interval(y: Column, lo: float, hi: float) -> Column:
    return lo + (hi - lo) / (1 + F.exp(-y))


def stick_breaking(p: Sequence[Column]) -> list[Column]:
    """Simplex of n weights to n-1 unconstrained values."""
    n = len(p)
    out, rest = [], F.lit(1.0)
    for i in range(n - 1):
        share = p[i] / rest
        out.append(F.ln(share / (1 - share)) - math.log(1 / (n - 1 - i)))
        rest = rest - p[i]
    return out


def from_stick_breaking(y: Sequence[Column]) -> list[Column]:
    n = len(y) + 1
    out, rest = [], F.lit(1.0)
    for i, value in enumerate(y):
        share = 1 / (1 + F.exp(-(value + math.log(1 / (n - 1 - i)))))
        out.append(rest * share)
        rest = rest * (1 - share)
    return [*out, rest]


def t_test_p(t: Column, dof: int) -> Column:
    """Two-sided p-value of Student's t for an integer number of degrees of freedom.

    The finite trigonometric series of the distribution function, so it stays an expression.
    """
    theta = F.atan(F.abs(t) / math.sqrt(dof))
    c2 = F.cos(theta) * F.cos(theta)
    if dof % 2 == 0:
        term, total = F.lit(1.0), F.lit(1.0)
        for i in range(1, dof // 2):
            term = term * c2 * ((2 * i - 1) / (2 * i))
            total = total + term
        return 1 - F.sin(theta) * total
    if dof == 1:
        return 1 - 2 * theta / math.pi
    term, total = F.cos(theta), F.cos(theta)
    for i in range(1, (dof - 1) // 2):
        term = term * c2 * (2 * i / (2 * i + 1))
        total = total + term
    return 1 - 2 / math.pi * (theta + F.sin(theta) * total)


def total(terms: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)

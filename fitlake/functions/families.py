"""Distributions by name: log density, distribution function and quantile as Column expressions.

A family is chosen per row by the name in ``dist``; its parameters are the columns ``a`` and ``b``, and ``lo`` and
``hi`` for the bounds of a truncated normal (null: none).

| dist | parameters |
|---|---|
| normal | mean a, spread b |
| lognormal | mean a and spread b of the logarithm |
| truncnorm | normal a, b between lo and hi |
| uniform | from a to b |
| exponential | scale a |
| poisson | rate a; counts |
| constant | the value a |

Everything stays an expression: the normal quantile and distribution function are rational approximations (16 digits),
counts use the incomplete gamma function.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Published rational approximations, highest power last. Complementary error function in three ranges.
ERF_SMALL = ((3.20937758913846947e3, 3.77485237685302021e2, 1.13864154151050156e2, 3.16112374387056560,
              1.85777706184603153e-1),
             (2.84423683343917062e3, 1.28261652607737228e3, 2.44024637934444173e2, 2.36012909523441209e1, 1.0))
ERFC_MIDDLE = ((1.23033935479799725e3, 2.05107837782607147e3, 1.71204761263407058e3, 8.81952221241769090e2,
                2.98635138197400131e2, 6.61191906371416295e1, 8.88314979438837594, 5.64188496988670089e-1,
                2.15311535474403846e-8),
               (1.23033935480374942e3, 3.43936767414372164e3, 4.36261909014324716e3, 3.29079923573345963e3,
                1.62138957456669019e3, 5.37181101862009858e2, 1.17693950891312499e2, 1.57449261107098347e1, 1.0))
ERFC_LARGE = ((6.58749161529837803e-4, 1.60837851487422766e-2, 1.25781726111229246e-1, 3.60344899949804439e-1,
               3.05326634961232344e-1, 1.63153871373020978e-2),
              (2.33520497626869185e-3, 6.05183413124413191e-2, 5.27905102951428412e-1, 1.87295284992346047,
               2.56852019228982242, 1.0))
# Normal quantile for the middle, the tails, and the far tails.
QUANTILE_MIDDLE = ((3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125,
                    45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
                   (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867,
                    39307.895800092710610, 28729.085735721942674, 5226.4952788528545610))
QUANTILE_TAIL = ((1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504,
                  1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4),
                 (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590,
                  0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9))
QUANTILE_FAR = ((6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230,
                 0.0265321895265761230930, 0.00124266094738807843860, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
                (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525,
                 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
                 2.04426310338993978564e-15))
INF = float("inf")


def let(make: Callable[..., Column], *values: Column) -> Column:
    """``make`` of values that are computed once, however often it uses them; keeps nested expressions small."""
    bound = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return F.get(F.transform(F.array(bound), lambda s: make(*[s[f"v{i}"] for i in range(len(values))])), 0)


def _poly(x: Column, powers: Sequence[float]) -> Column:
    out = F.lit(powers[-1])
    for c in reversed(powers[:-1]):
        out = out * x + c
    return out


def _ratio(x: Column, table) -> Column:
    return _poly(x, table[0]) / _poly(x, table[1])


def _erfc(x: Column, y: Column, square: Column, inverse: Column) -> Column:
    inner = 1 - x * _ratio(square, ERF_SMALL)
    tail = (1 / math.sqrt(math.pi) - inverse * _ratio(inverse, ERFC_LARGE)) / y
    outer = F.exp(-square) * F.when(y <= 4, _ratio(y, ERFC_MIDDLE)).otherwise(tail)
    return F.when(y <= 0.46875, inner).otherwise(F.when(x < 0, 2 - outer).otherwise(outer))


def erfc(x: Column) -> Column:
    """Complementary error function."""
    return let(lambda v: let(_erfc, v, F.abs(v), v * v, 1 / F.nullif(v * v, F.lit(0.0))), x)


def normal_cdf(z: Column) -> Column:
    return 0.5 * erfc(-z / math.sqrt(2))


def _normal_quantile(p: Column, q: Column, r: Column) -> Column:
    tail = F.when(r <= 5, let(lambda v: _ratio(v, QUANTILE_TAIL), r - 1.6)).otherwise(
        let(lambda v: _ratio(v, QUANTILE_FAR), r - 5.0))
    middle = q * let(lambda v: _ratio(v, QUANTILE_MIDDLE), 0.180625 - q * q)
    value = F.when(F.abs(q) <= 0.425, middle).otherwise(F.signum(q) * tail)
    return F.when(p == 0, -INF).when(p == 1, INF).when((p > 0) & (p < 1), value)


def normal_quantile(p: Column | float) -> Column:
    """Inverse of ``normal_cdf``; infinite at 0 and 1, null outside. A number gives a literal."""
    if isinstance(p, float):
        return F.lit(NormalDist().inv_cdf(p))
    return let(lambda v: let(_normal_quantile, v, v - 0.5, F.sqrt(-F.ln(F.when(
        (v > 0) & (v < 1), F.least(v, 1 - v))))), p)


def _lgamma(x: Column, y: Column, i: Column) -> Column:
    series = (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + i * (
        1 / 12 - i * i * (1 / 360 - i * i * (1 / 1260 - i * i * (1 / 1680 - i * i / 1188))))
    shift = F.lit(1.0)
    for j in range(8):
        shift = shift * (x + j)
    return series - F.ln(shift)


def lgamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0: Stirling's series, beyond a shift by eight."""
    return let(lambda v: let(_lgamma, v, v + 8, 1 / (v + 8)), x)


def gamma_q(s: Column, x: Column) -> Column:
    """Upper incomplete gamma function over the whole one, for s > 0 and x >= 0.

    The power series below s + 1, the continued fraction above. The number of terms follows the square root of ``s``.
    """
    return let(lambda a, b: let(_gamma_q, a, b, F.exp(a * F.ln(F.nullif(b, F.lit(0.0))) - b - lgamma(a))), s, x)


def _gamma_q(s: Column, x: Column, front: Column) -> Column:
    terms = F.sequence(F.lit(1), (F.lit(60) + 12 * F.ceil(F.sqrt(F.greatest(s, x)))).cast("int"))

    def term(acc: Column, n: Column) -> Column:
        t = acc["t"] * x / (s + n)
        return F.struct(t.alias("t"), (acc["sum"] + t).alias("sum"))

    start = F.struct((1 / s).cast("double").alias("t"), (1 / s).cast("double").alias("sum"))
    below = 1 - front * F.aggregate(terms, start, term)["sum"]

    def level(acc: Column, n: Column) -> Column:  # modified Lentz
        an, b = -n * (n - s), acc["b"] + 2
        d = 1 / F.coalesce(F.nullif(an * acc["d"] + b, F.lit(0.0)), F.lit(1e-300))
        c = F.coalesce(F.nullif(b + an / acc["c"], F.lit(0.0)), F.lit(1e-300))
        return let(lambda b, c, d, h: F.struct(b.alias("b"), c.alias("c"), d.alias("d"), (h * d * c).alias("h")),
                   b, c, d, acc["h"])

    b0 = x + 1 - s
    first = 1 / F.nullif(b0, F.lit(0.0))
    begin = F.struct(b0.cast("double").alias("b"), F.lit(1e300).alias("c"), first.cast("double").alias("d"),
                     first.cast("double").alias("h"))
    above = front * F.aggregate(terms, begin, level)["h"]
    return F.when(x <= 0, 1.0).when(x < s + 1, below).otherwise(above)


def _log(x: Column) -> Column:
    """Logarithm, minus infinity at 0."""
    return F.coalesce(F.ln(F.nullif(x, F.lit(0.0))), F.lit(-INF))


def _normal_log(x: Column, mu: Column, sigma: Column) -> Column:
    z = (x - mu) / sigma
    return -0.5 * z * z - F.ln(sigma * math.sqrt(2 * math.pi))


@dataclass(frozen=True)
class Family:
    """Functions of (value or probability, a, b, lo, hi), and the ends of the support."""

    log_density: Callable[..., Column]
    cdf: Callable[..., Column]
    quantile: Callable[..., Column]
    ends: Callable[..., tuple[Column, Column]]
    plain: bool = False  # its quantile takes numbers too


def _inside(x: Column, low: Column, high: Column, value: Column) -> Column:
    return F.when((x >= low) & (x <= high), value).otherwise(F.when(x.isNotNull(), F.lit(-INF)))


def _bounds(lo: Column, hi: Column) -> tuple[Column, Column]:
    return F.coalesce(lo.cast("double"), F.lit(-INF)), F.coalesce(hi.cast("double"), F.lit(INF))


def _standard(make: Callable[..., Column], x: Column, a: Column, b: Column, lo: Column, hi: Column) -> Column:
    """``make(x, alpha, beta, turned)`` with standardised bounds, on the lower side where the interval is above the mean."""
    def turn(x: Column, alpha: Column, beta: Column) -> Column:
        turned = alpha > 0
        return let(make, x, F.when(turned, -beta).otherwise(alpha), F.when(turned, -alpha).otherwise(beta), turned)

    low, high = _bounds(lo, hi)
    return let(turn, x, (low - a) / b, (high - a) / b)


def _truncated_log(x: Column, a: Column, b: Column, lo: Column, hi: Column) -> Column:
    def mass(x: Column, alpha: Column, beta: Column, turned: Column) -> Column:
        # beyond 30 spreads the mass of the tail is that of an exponential of its slope
        far = -0.5 * beta * beta - F.ln(-beta * math.sqrt(2 * math.pi)) + _log(1 - F.exp(beta * (beta - alpha)))
        return x - F.when(beta < -30, far).otherwise(_log(normal_cdf(beta) - normal_cdf(alpha)))

    return _inside(x, *_bounds(lo, hi), _standard(mass, _normal_log(x, a, b), a, b, lo, hi))


def _truncated_cdf(x: Column, a: Column, b: Column, lo: Column, hi: Column) -> Column:
    def share(z: Column, alpha: Column, beta: Column, turned: Column) -> Column:
        z = F.when(turned, -z).otherwise(z)
        part = let(lambda base, top, at: (at - base) / F.nullif(top - base, F.lit(0.0)),
                   normal_cdf(alpha), normal_cdf(beta), normal_cdf(z))
        rest = F.exp(beta * (beta - alpha))
        far = (F.exp(beta * (beta - z)) - rest) / F.nullif(1 - rest, F.lit(0.0))
        value = F.when(beta < -30, far).otherwise(part)
        return F.when(turned, 1 - value).otherwise(value)

    low, high = _bounds(lo, hi)
    return F.when(x <= low, 0.0).when(x >= high, 1.0).otherwise(_standard(share, (x - a) / b, a, b, lo, hi))


def _truncated_quantile(p: Column, a: Column, b: Column, lo: Column, hi: Column) -> Column:
    def place(p: Column, alpha: Column, beta: Column, turned: Column) -> Column:
        u = F.when(turned, 1 - p).otherwise(p)
        near = let(lambda u, base, top: normal_quantile(base + u * (top - base)), u, normal_cdf(alpha), normal_cdf(beta))
        far = beta - F.ln(u + (1 - u) * F.exp(beta * (beta - alpha))) / beta
        return F.when(turned, -1.0).otherwise(1.0) * F.when(beta < -30, far).otherwise(near)

    low, high = _bounds(lo, hi)
    value = F.least(F.greatest(a + b * _standard(place, p, a, b, lo, hi), low), high)
    return F.when((p >= 0) & (p <= 1), value)


def _poisson_log(k: Column, rate: Column) -> Column:
    value = k * F.ln(rate) - rate - lgamma(k + 1)
    return F.when((k >= 0) & (k == F.floor(k)), value).otherwise(F.when(k.isNotNull(), F.lit(-INF)))


def _poisson_cdf(k: Column, rate: Column) -> Column:
    return F.when(k < 0, 0.0).otherwise(gamma_q(F.floor(F.greatest(k, F.lit(0.0))) + 1.0, rate))


def _poisson_quantile(p: Column, rate: Column) -> Column:
    """Smallest count whose distribution function reaches p: a start from the normal quantile, then single counts."""
    z = normal_quantile(F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15)))
    start = let(lambda z: F.greatest(F.floor(rate + z * F.sqrt(rate) + (z * z - 1) / 6) - 6, F.lit(-1)).cast("double"), z)
    count = let(_counted, p, rate, start)
    return F.when(p == 1, INF).when((p >= 0) & (p < 1), count)


def _counted(p: Column, rate: Column, start: Column) -> Column:
    def step(acc: Column, n: Column) -> Column:
        def next_of(cdf: Column) -> Column:
            found = acc["k"].isNull() & (cdf >= p * (1 - 1e-13))
            return F.struct(cdf.alias("cdf"), F.when(found, start + n).otherwise(acc["k"]).alias("k"))

        return let(next_of, acc["cdf"] + F.exp(_poisson_log(start + n, rate)))

    begin = F.struct(_poisson_cdf(start, rate).cast("double").alias("cdf"), F.lit(None).cast("double").alias("k"))
    return F.aggregate(F.lit(list(range(1, 25))), begin, step)["k"]



FAMILIES: dict[str, Family] = {
    "normal": Family(
        lambda x, a, b, lo, hi: _normal_log(x, a, b),
        lambda x, a, b, lo, hi: normal_cdf((x - a) / b),
        lambda p, a, b, lo, hi: a + b * normal_quantile(p),
        lambda a, b, lo, hi: (F.lit(-INF), F.lit(INF)), True),
    "lognormal": Family(
        lambda x, a, b, lo, hi: F.when(x > 0, _normal_log(F.ln(F.when(x > 0, x)), a, b) - F.ln(F.when(x > 0, x)))
        .otherwise(F.when(x.isNotNull(), F.lit(-INF))),
        lambda x, a, b, lo, hi: F.when(x > 0, normal_cdf((F.ln(F.when(x > 0, x)) - a) / b)).otherwise(0.0),
        lambda p, a, b, lo, hi: F.exp(a + b * normal_quantile(p)),
        lambda a, b, lo, hi: (F.lit(0.0), F.lit(INF)), True),
    "truncnorm": Family(
        _truncated_log, _truncated_cdf, _truncated_quantile, lambda a, b, lo, hi: _bounds(lo, hi)),
    "uniform": Family(
        lambda x, a, b, lo, hi: _inside(x, a, b, -F.ln(b - a)),
        lambda x, a, b, lo, hi: F.least(F.greatest((x - a) / (b - a), F.lit(0.0)), F.lit(1.0)),
        lambda p, a, b, lo, hi: a + (b - a) * p,
        lambda a, b, lo, hi: (a, b)),
    "exponential": Family(
        lambda x, a, b, lo, hi: _inside(x, F.lit(0.0), F.lit(INF), -F.ln(a) - x / a),
        lambda x, a, b, lo, hi: F.when(x > 0, 1 - F.exp(-x / a)).otherwise(0.0),
        lambda p, a, b, lo, hi: F.when(p == 1, INF).when((p >= 0) & (p < 1), -a * F.ln(F.when(p < 1, 1 - p))),
        lambda a, b, lo, hi: (F.lit(0.0), F.lit(INF))),
    "poisson": Family(
        lambda x, a, b, lo, hi: _poisson_log(x, a),
        lambda x, a, b, lo, hi: _poisson_cdf(x, a),
        lambda p, a, b, lo, hi: _poisson_quantile(p, a),
        lambda a, b, lo, hi: (F.lit(0.0), F.lit(INF))),
    "constant": Family(
        lambda x, a, b, lo, hi: F.when(x == a, 0.0).otherwise(F.when(x.isNotNull(), F.lit(-INF))),
        lambda x, a, b, lo, hi: F.when(x >= a, 1.0).otherwise(0.0),
        lambda p, a, b, lo, hi: a,
        lambda a, b, lo, hi: (a, a)),
}


def used(df: DataFrame, column: str = "dist") -> list[str]:
    """The families that a table names; an expression over these alone is much smaller."""
    named = {r[0] for r in df.select(column).distinct().limit(len(FAMILIES) + 1).collect()}
    return [n for n in FAMILIES if n in named] or ["normal"]


def _by_name(make: Callable[[Family], Column], dist: Column, names: Sequence[str]) -> Column:
    """One expression that follows the row's family; any other name is an error when it is read."""
    out = None
    for name in names:
        value = make(FAMILIES[name]).cast("double")
        out = F.when(dist == name, value) if out is None else out.when(dist == name, value)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown distribution "), F.coalesce(dist, F.lit("null"))))
                         .cast("double"))


def _args(a, b, lo, hi) -> tuple[Column, ...]:
    return tuple((F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)).cast("double")
                 for x in (a, b, lo, hi))


def log_density(x: Column, dist: Column, a="a", b="b", lo="lo", hi="hi", names: Sequence[str] = tuple(FAMILIES)) -> Column:
    """Log density (of counts, log probability) of the row's distribution; minus infinity outside its support."""
    return _by_name(lambda f: f.log_density(x, *_args(a, b, lo, hi)), dist, names)


def cdf(x: Column, dist: Column, a="a", b="b", lo="lo", hi="hi", names: Sequence[str] = tuple(FAMILIES)) -> Column:
    return _by_name(lambda f: f.cdf(x, *_args(a, b, lo, hi)), dist, names)


def quantile(p: Column | float, dist: Column, a="a", b="b", lo="lo", hi="hi", names: Sequence[str] = tuple(FAMILIES)) -> Column:
    """Value at a probability; null outside of 0 to 1. A uniform probability gives a draw."""
    given = F.lit(p) if isinstance(p, float) else p
    return _by_name(lambda f: f.quantile(p if f.plain else given, *_args(a, b, lo, hi)), dist, names)


def support(dist: Column, a="a", b="b", lo="lo", hi="hi", names: Sequence[str] = tuple(FAMILIES)) -> tuple[Column, Column]:
    """Ends of the support, infinite where there is none."""
    args = _args(a, b, lo, hi)
    return tuple(_by_name(lambda f, i=i: f.ends(*args)[i], dist, names) for i in (0, 1))

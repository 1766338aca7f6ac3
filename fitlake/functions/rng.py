"""Counter-based random numbers: the same key gives the same draw on any partitioning.

A draw hashes (entropy, key..., counter), so it needs no generator state and can be repeated by
any engine with MD5. Keys of different length or content give independent streams: separators inside
a field are escaped, and a null field is a value of its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTROPY = 20_201_115  # project-wide default


def _field(text: Column) -> Column:
    """A field that no separator or missing value can pass for another."""
    marked = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(":"), F.lit("\\:"))
    return F.coalesce(marked, F.lit("\\N"))


def uniform(*key: Column | int | str, entropy: int = ENTROPY) -> Column:
    """Uniform draw in [0, 1) from the first 52 bits of the digest."""
    parts = [k if isinstance(k, Column) else F.lit(k) for k in key]
    text = F.concat_ws(":", F.lit(str(entropy)), *[_field(p.cast("string")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(2**52)


def normal(*key: Column | int | str, entropy: int = ENTROPY) -> Column:
    u1 = uniform(*key, F.lit("a"), entropy=entropy)
    u2 = uniform(*key, F.lit("b"), entropy=entropy)
    return F.sqrt(-2 * F.ln(1 - u1)) * F.cos(2 * math.pi * u2)


def lognormal(mu: Column | float, sigma: Column | float, *key: Column | int | str) -> Column:
    return F.exp(F.lit(mu) + F.lit(sigma) * normal(*key))


def exponential(*key: Column | int | str) -> Column:
    return -F.ln(1 - uniform(*key))


def seed(*key: Column | int | str, entropy: int = ENTROPY) -> Column:
    """Integer seed for a generator inside a grouped function."""
    return F.floor(uniform(*key, entropy=entropy) * float(2**31)).cast("long")

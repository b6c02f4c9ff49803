"""Seeded draws from hashes of row keys.

rand() follows the partitioning and changes when a lost task runs again; these depend on
the keys only.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A draw turns a tag into a uniform (0, 1) column for the current row.
Draw = Callable[[str], Column]


def uniform(seed: int, *keys: Column | str) -> Column:
    """Uniform on (0, 1) from the upper 53 bits of a 64-bit hash."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**53))


def keyed(seed: int, *keys: Column | str) -> Draw:
    return lambda tag: uniform(seed, F.lit(tag), *keys)


def gaussian(draw: Draw, tag: str) -> Column:
    """Standard normal from two uniforms."""
    radius = F.sqrt(F.lit(-2.0) * F.log(draw(f"{tag}/radius")))
    return radius * F.cos(F.lit(2.0 * math.pi) * draw(f"{tag}/angle"))


def between(draw: Draw, tag: str, low: float, high: float) -> Column:
    return F.lit(low) + draw(tag) * F.lit(high - low)


def integer(draw: Draw, tag: str, low: int, high: int) -> Column:
    """Integer in [low, high], both ends possible."""
    return (F.lit(low) + F.floor(draw(tag) * F.lit(high - low + 1))).cast("long")

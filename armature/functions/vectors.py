"""Vector maths on array columns.

With a known width every function unrolls to plain expressions, which stay inside
generated code; higher-order functions are used only where the width varies by row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from armature.schema import ARM_DIM, JOINT_DIM


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lanes(vec: Column | str, dim: int, start: int = 0) -> list[Column]:
    """Elements start .. start+dim-1 (0-based); null where the array is shorter."""
    return [F.get(col(vec), F.lit(i)) for i in range(start, start + dim)]


def each(vec: Column | str, dim: int, fn: Callable[[Column, int], Column]) -> Column:
    return F.array(*[fn(x, i) for i, x in enumerate(lanes(vec, dim))])


def each2(a: Column | str, b: Column | str, dim: int, fn: Callable[[Column, Column], Column]) -> Column:
    return F.array(*[fn(x, y) for x, y in zip(lanes(a, dim), lanes(b, dim), strict=True)])


def total(cols: Sequence[Column]) -> Column:
    return reduce(add, cols)


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def cast_double(vec: Column | str) -> Column:
    return col(vec).cast("array<double>")


def to_degrees(vec: Column | str, dim: int = JOINT_DIM) -> Column:
    return each(vec, dim, lambda x, _: F.degrees(x))


def to_radians(vec: Column | str, dim: int = JOINT_DIM) -> Column:
    return each(vec, dim, lambda x, _: F.radians(x))


def rescale(x: Column, a: float, b: float, c: float, d: float) -> Column:
    """Linear map of [a, b] onto [c, d], without clamping."""
    return (x - F.lit(a)) / F.lit(b - a) * F.lit(d - c) + F.lit(c)


def clip(x: Column, low: Column, high: Column) -> Column:
    """Null stays null: least and greatest alone would skip it."""
    return F.when(x.isNotNull(), F.greatest(low, F.least(high, x)))


def range_fraction(x: Column, is_gripper: bool = False) -> Column:
    part = x / F.lit(100.0) if is_gripper else (x + F.lit(100.0)) / F.lit(200.0)
    return clip(part, F.lit(0.0), F.lit(1.0))


def norm(cols: Sequence[Column]) -> Column:
    return F.sqrt(total([c * c for c in cols]))


def distance(a: Column | str, b: Column | str, dim: int = 3) -> Column:
    return norm([x - y for x, y in zip(lanes(a, dim), lanes(b, dim), strict=True)])


def xy_distance(a: Column | str, b: Column | str) -> Column:
    return distance(a, b, 2)


def speed(velocity: Column | str) -> Column:
    return norm(lanes(velocity, 3))


def largest(cols: Sequence[Column]) -> Column:
    return cols[0] if len(cols) == 1 else F.greatest(*cols)


def max_abs(vec: Column | str, dim: int) -> Column:
    return largest([F.abs(x) for x in lanes(vec, dim)])


def max_abs_difference(a: Column | str, b: Column | str, dim: int) -> Column:
    return largest([F.abs(x - y) for x, y in zip(lanes(a, dim), lanes(b, dim), strict=True)])


def all_close(a: Column | str, b: Column | str, dim: int, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    checks = [
        F.abs(x - y) <= F.lit(atol) + F.lit(rtol) * F.abs(y)
        for x, y in zip(lanes(a, dim), lanes(b, dim), strict=True)
    ]
    return F.coalesce(reduce(lambda p, q: p & q, checks), F.lit(False))


def lerp(a: Column | str, b: Column | str, t: Column, dim: int) -> Column:
    return each2(a, b, dim, lambda x, y: x + (y - x) * t)


def slice_of(vec: Column | str, start: int, end: int) -> Column:
    """Half-open, 0-based slice."""
    return F.slice(col(vec), start + 1, end - start)


def concat_checked(parts: Sequence[Column | str], dim: int = JOINT_DIM) -> Column:
    """Concatenate in order; a result of another width is an error."""
    whole = F.concat(*[col(p) for p in parts])
    wrong = F.raise_error(F.concat(F.lit(f"expected {dim} elements, got "), F.size(whole).cast("string")))
    return F.when(F.size(whole) == dim, whole).otherwise(wrong)


def normalize(x: Column, low: Column, high: Column) -> Column:
    """[low, high] onto [-1, 1]; a constant dimension becomes 0."""
    width = high - low
    return F.when(width == 0, F.lit(0.0)).otherwise(F.lit(2.0) * (x - low) / F.nullif(width, F.lit(0.0)) - F.lit(1.0))


def denormalize(x: Column, low: Column, high: Column) -> Column:
    width = high - low
    return F.when(width == 0, low).otherwise((x + F.lit(1.0)) / F.lit(2.0) * width + low)


def pad(vec: Column | str, dim: int, fill: float = 0.0) -> Column:
    """Zero-pad on the right; a longer vector is an error, never cut."""
    c = col(vec)
    missing = F.lit(dim) - F.size(c)
    wrong = F.raise_error(F.concat(F.lit(f"vector longer than {dim}: "), F.size(c).cast("string")))
    return F.when(missing >= 0, F.concat(c, F.array_repeat(F.lit(fill), missing))).otherwise(wrong)


def pad_mask(vec: Column | str, dim: int) -> Column:
    n = F.size(col(vec))
    return F.array(*[F.lit(i) < n for i in range(dim)])


def unpad(vec: Column | str, dim: int = JOINT_DIM) -> Column:
    return F.slice(col(vec), 1, dim)


def arm_of(vec: Column | str) -> list[Column]:
    return lanes(vec, ARM_DIM)

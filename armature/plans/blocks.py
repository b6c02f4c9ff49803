"""Ordered work over episodes of any length.

An episode normally holds some hundred frames, but one episode may hold a third of a
table. So nothing here sorts a whole episode in one task: an episode is cut into blocks
of consecutive positions, windows run per (keys, block), and what crosses a block edge
is either copied there (neighbours) or carried by a table with one row per block
(running totals). A block table is `BLOCK` times smaller than the frames: 10**12 frames
give 15 million block rows, so even the episode holding a third of them is a short sort.

Keys and positions are never null in the canonical tables, and positions are unique per
key; a null order value is ranked first.

`longest` is an upper bound on the positions in one episode. When it is known to fit in
one block the plain window is planned, without copies or carry.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK = 65_536
RANK_ROWS = 1_000_000


def block_of(pos: str, size: int = BLOCK) -> Column:
    return F.floor(F.col(pos) / F.lit(size)).cast("long")


def fits(longest: int | None, size: int) -> bool:
    return longest is not None and longest <= size


def longest_group(df: DataFrame, keys: Sequence[str], enough: int = BLOCK) -> int:
    """Upper bound on the rows per key, by a count that reads key columns only."""
    total = df.count()
    if total <= enough:
        return total
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def last_position(df: DataFrame, pos: str) -> int:
    """One past the largest position, read from a single column."""
    largest = df.agg(F.max(pos)).first()[0]
    return 0 if largest is None else int(largest) + 1


def over_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    columns: Callable[[WindowSpec], dict[str, Column]],
    before: int = 0,
    after: int = 0,
    size: int = BLOCK,
    longest: int | None = None,
) -> DataFrame:
    """Window columns that look at most `before` rows back and `after` rows ahead.

    Positions must be dense. Rows close to a block edge are copied into the block next
    door, (before + after) / size of all rows, and the copies are dropped afterwards.
    """
    if fits(longest, size):
        return df.withColumns(columns(Window.partitionBy(*keys).orderBy(pos)))
    at = F.col(pos)
    first = F.greatest(F.lit(0), F.floor((at - after) / F.lit(size))).cast("long")
    last = F.floor((at + before) / F.lit(size)).cast("long")
    spread = df.withColumn("_block", F.explode(F.sequence(first, last)))
    window = Window.partitionBy(*keys, "_block").orderBy(pos)
    return spread.withColumns(columns(window)).filter(F.col("_block") == block_of(pos, size)).drop("_block")


@dataclass(frozen=True)
class Fold:
    """A running value: kind is sum, max, min or last (last non-null value seen)."""

    kind: str
    value: Column
    inclusive: bool = True

    def _frame(self, window: WindowSpec) -> WindowSpec:
        return window.rowsBetween(Window.unboundedPreceding, 0 if self.inclusive else -1)

    def inside(self, window: WindowSpec) -> Column:
        return self._apply(self.value).over(self._frame(window))

    def _apply(self, value: Column) -> Column:
        if self.kind == "last":
            return F.last(value, ignorenulls=True)
        return {"sum": F.sum, "max": F.max, "min": F.min}[self.kind](value)

    def total(self, pos: str) -> Column:
        if self.kind == "last":
            return F.max_by(self.value, F.when(self.value.isNotNull(), F.col(pos)))
        return self._apply(self.value)

    def carried(self, total: Column, window: WindowSpec) -> Column:
        return self._apply(total).over(window.rowsBetween(Window.unboundedPreceding, -1))

    def combine(self, inside: Column, carried: Column) -> Column:
        if self.kind == "last":
            return F.coalesce(inside, carried)
        if self.kind == "sum":
            return F.when(inside.isNull(), carried).otherwise(inside + F.coalesce(carried, F.lit(0)))
        return (F.greatest if self.kind == "max" else F.least)(inside, carried)


def running(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    folds: dict[str, Fold],
    size: int | Column = BLOCK,
    longest: int | None = None,
    keep: bool = False,
) -> DataFrame:
    """Running values in position order, null before the first contributing row.

    Blocks are `size` positions wide, or given by a column that does not decrease along the positions.
    With `keep` the column `_block` stays, if there is one, for the next call, which then needs no other shuffle.
    """
    given = isinstance(size, Column)
    if not given and fits(longest, size):
        window = Window.partitionBy(*keys).orderBy(pos)
        return df.withColumns({name: fold.inside(window) for name, fold in folds.items()})
    if "_block" in df.columns:
        blocked = df
    else:
        blocked = df.withColumn("_block", F.coalesce(size, F.lit(-(2**62))) if given else block_of(pos, size))
    totals = blocked.groupBy(*keys, "_block").agg(*[f.total(pos).alias(f"_total_{n}") for n, f in folds.items()])
    ahead = Window.partitionBy(*keys).orderBy("_block")
    carry = totals.select(
        *keys, "_block", *[f.carried(F.col(f"_total_{n}"), ahead).alias(f"_carry_{n}") for n, f in folds.items()]
    )
    window = Window.partitionBy(*keys, "_block").orderBy(pos)
    inside = blocked.withColumns({f"_in_{n}": f.inside(window) for n, f in folds.items()})
    joined = inside.join(carry, [*keys, "_block"], "inner")  # in the order the window left
    out = joined.withColumns({n: f.combine(F.col(f"_in_{n}"), F.col(f"_carry_{n}")) for n, f in folds.items()})
    scratch = [c for n in folds for c in (f"_in_{n}", f"_carry_{n}")]
    return out.drop(*scratch, *([] if keep else ["_block"]))


#: Slices of a table at most, and splitters that are compared at once.
MOST_SLICES, AT_ONCE = 4096, 64


def slices_of(at: Column, splitters: Sequence[int]) -> Column:
    """Number of the slice: how many of the ascending splitters are not above the value. Null stays null.

    Splitters are compared in two steps, so a row meets some 2 * AT_ONCE of them at most.
    """
    rows = [list(splitters[i : i + AT_ONCE]) for i in range(0, len(splitters), AT_ONCE)]
    if not rows:
        return F.when(at.isNotNull(), F.lit(0).cast("long"))

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda s: s <= at)).cast("long")

    def numbers(values: list[int]) -> Column:
        return F.array(*[F.lit(int(v)).cast("long") for v in values])

    row = below(numbers([r[0] for r in rows]))
    inside = below(F.get(F.array(*[numbers(r) for r in rows]), F.greatest(row - 1, F.lit(0)).cast("int")))
    return F.when(at.isNotNull(), F.greatest(row - 1, F.lit(0)) * AT_ONCE + inside)


def rank_buckets(df: DataFrame, at: Column, rows: int = RANK_ROWS) -> Column | None:
    """Slices of a whole ordering value holding about `rows` rows each (1 / MOST_SLICES of a larger table); None if one is enough.

    Splitters are quantiles of a mergeable sketch, so outliers and bursts don't fill a slice. Rows with equal values stay together.
    """
    total = df.count()
    if total <= rows:
        return None
    slices = min(MOST_SLICES, -(-total // rows))
    shares = [i / slices for i in range(1, slices)]
    cuts = df.select(at.cast("long").alias("at")).agg(F.percentile_approx("at", shares, 20 * slices).alias("q")).first()["q"]
    return slices_of(at.cast("long"), sorted(set(cuts or [])))


def position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    bucket: Column | None = None,
    out: str = "position",
) -> DataFrame:
    """0-based row number per key. `bucket` must not decrease along `order`.

    Rows are ranked per (keys, bucket) and shifted by the rows in earlier buckets, so a
    key that owns a third of the table is spread over many tasks.
    """
    keys = list(keys)
    if bucket is None:
        spec = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(*order)
        return df.withColumn(out, (F.row_number().over(spec) - 1).cast("long"))
    sliced = df.withColumn("_bucket", F.coalesce(bucket, F.lit(-(2**62))))
    counts = sliced.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_bucket")
    shift = counts.select(
        *keys,
        "_bucket",
        F.coalesce(F.sum("_rows").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_shift"),
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    ranked = sliced.withColumn("_rank", F.row_number().over(inside)).join(shift, [*keys, "_bucket"], "inner")
    return ranked.withColumn(out, (F.col("_rank") - 1 + F.col("_shift")).cast("long")).drop("_bucket", "_rank", "_shift")


def attach(
    df: DataFrame,
    facts: DataFrame,
    keys: Sequence[str],
    pos: str,
    last: Column,
    how: str = "inner",
    size: int = BLOCK,
    longest: int | None = None,
) -> DataFrame:
    """Join per-episode facts to frames on (keys, block).

    A fact row is repeated once per block of its episode (`last` is the episode's largest
    position), so no join key holds more than `size` frames. Where every episode fits in a
    block the keys alone are joined, and frames partitioned by them are not shuffled again.
    """
    if fits(longest, size):
        return df.join(facts, list(keys), how)
    per_block = facts.withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / F.lit(size)).cast("long")))
    )
    return df.withColumn("_block", block_of(pos, size)).join(per_block, [*keys, "_block"], how).drop("_block")

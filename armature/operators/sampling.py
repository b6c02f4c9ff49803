"""Seeded shuffles, samples and mixtures that do not depend on partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armature.functions.draws import Draw, keyed
from armature.plans.blocks import RANK_ROWS, attach, position
from armature.schema import KEYS, POS

TOP_ROWS = 100_000


def shuffled(df: DataFrame, seed: int, keys: Sequence[str] = (*KEYS, POS), draw: Draw | None = None) -> DataFrame:
    """Rows in a seeded random order: one range-partitioned sort."""
    draw = draw or keyed(seed, *keys)
    return df.orderBy(draw("shuffle"), *keys)


def sample_rows(
    df: DataFrame, n: int, seed: int, keys: Sequence[str] = (*KEYS, POS), draw: Draw | None = None
) -> DataFrame:
    """n rows without replacement."""
    draw = draw or keyed(seed, *keys)
    return smallest(df.withColumn("_draw", draw("sample")), n, ["_draw", *keys], F.col("_draw")).drop("_draw")


def smallest(df: DataFrame, n: int, order: Sequence[str], share: Column, top_rows: int = TOP_ROWS) -> DataFrame:
    """The n first rows in `order`. `share`, in 0 to 1, must not decrease along it; it only cuts the work.

    A few rows are a bounded top-n. More rows are ranked in equal slices of the share, so
    no task sorts more than a slice and nothing passes through the driver. Both give the same rows.
    """
    if n <= top_rows:
        return df.orderBy(*order).limit(n)
    slices = max(1, df.count() // RANK_ROWS)
    ranked = position(df, [], list(order), F.floor(share * slices).cast("long"), "_rank")
    return ranked.filter(F.col("_rank") < n).drop("_rank")


def mixture_weights(
    frames: DataFrame, keys: Sequence[str] = KEYS, pos: str = POS, **plan
) -> DataFrame:
    """Frames with the weight that makes datasets, and episodes in them, equally likely.

    weight = 1 / (datasets * episodes of the dataset * frames of the episode).
    """
    dataset = keys[0]
    lengths = frames.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_frames"), F.max(pos).alias("_last")
    )
    sizes = lengths.groupBy(dataset).agg(F.count(F.lit(1)).alias("_episodes"))
    datasets = sizes.agg(F.count(F.lit(1)).alias("n")).scalar()
    weighted = lengths.join(sizes, dataset).select(
        *keys, "_last", (F.lit(1.0) / datasets / F.col("_episodes") / F.col("_frames")).alias("weight")
    )
    return attach(frames, weighted, keys, pos, F.col("_last"), **plan).drop("_last")


def draw_mixture(
    weighted: DataFrame,
    n: int,
    seed: int,
    keys: Sequence[str] = (*KEYS, POS),
    draw: Draw | None = None,
    top_rows: int = TOP_ROWS,
) -> DataFrame:
    """n distinct frames, drawn in proportion to weight: the smallest of -ln(u) / weight, whatever n is."""
    draw = draw or keyed(seed, *keys)
    ranked = weighted.withColumn("_time", -F.log(draw("mixture")) / F.col("weight"))
    typical = ranked.agg(F.avg("_time").alias("t")).scalar()
    return smallest(ranked, n, ["_time", *keys], -F.expm1(-F.col("_time") / typical), top_rows).drop("_time")

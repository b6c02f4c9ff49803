"""Merging datasets into one."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from armature.plans.blocks import BLOCK, Fold, running
from armature.plans.lookups import lookup_join, settled
from armature.schema import POS


def _together(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows with the number of the dataset they come from."""
    return reduce(DataFrame.unionByName, [p.withColumn("source", F.lit(i)) for i, p in enumerate(parts)])


def _before(sizes: DataFrame, **sums: str) -> DataFrame:
    """source, and for each name the sum of a column over the sources before; one row for each dataset."""
    ahead = Window.partitionBy(F.lit(0)).orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("source", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).cast("long").alias(name) for name, c in sums.items()])


def offsets(parts: Sequence[DataFrame]) -> DataFrame:
    """(source, _episodes, _frames): what is added to episode numbers and `index` of each dataset of frames."""
    sizes = _together([p.select("episode_index") for p in parts]).groupBy("source")
    sizes = sizes.agg((F.max("episode_index") + 1).alias("e"), F.count(F.lit(1)).alias("f"))
    return settled(_before(sizes, _episodes="e", _frames="f"), "merge-offsets")


def merge_frames(parts: Sequence[DataFrame], dictionary: DataFrame, name: str = "merged") -> DataFrame:
    """Append datasets whose episodes are numbered 0..; episode numbers and `index` go on.

    What a dataset adds to the numbers is a prefix sum over a table with a row for each dataset, joined
    by `source`, so frames are not shuffled for the renumbering and the plan grows with the number of datasets, not its
    square; task indices come from `merged_tasks`.
    """
    moved = {"dataset": F.lit(name), "episode_index": F.col("episode_index") + F.col("_episodes")}
    if "index" in parts[0].columns:
        moved["index"] = F.col("index") + F.col("_frames")
    spread = ["episode_index", POS]
    together = lookup_join(_together(parts), offsets(parts), ["source"], "inner", spread=spread).withColumns(moved).drop("_episodes", "_frames")
    new = settled(dictionary.select("source", "task_index", F.col("new_index").alias("_new")), "task-dictionary")
    joined = lookup_join(together, new, ["source", "task_index"], "left", spread=spread)
    return joined.withColumn("task_index", F.col("_new")).drop("_new", "source")


def merge_episodes(episodes: Sequence[DataFrame], frames: Sequence[DataFrame], name: str = "merged") -> DataFrame:
    """Episode tables of the same datasets, with the numbers that `merge_frames` gives."""
    joined = lookup_join(_together(episodes), offsets(frames), ["source"], "inner", spread=["episode_index"])
    moved = joined.withColumns({"dataset": F.lit(name), "episode_index": F.col("episode_index") + F.col("_episodes")})
    return moved.drop("source", "_episodes", "_frames")


def merged_tasks(parts: Sequence[DataFrame], size: int = BLOCK, rows: int | None = None) -> DataFrame:
    """Task dictionary by text: (source, task_index, task, new_index).

    Texts are numbered by first appearance: source, then task index.
    """
    listed = reduce(
        DataFrame.unionByName,
        [p.select(F.lit(i).alias("source"), "task_index", "task") for i, p in enumerate(parts)],
    )
    firsts = listed.groupBy("task").agg(F.min(F.struct("source", "task_index")).alias("_first"))
    firsts = firsts.select(
        "task", F.col("_first.source").alias("_source"), F.col("_first.task_index").alias("_index")
    )
    inside = running(firsts, ["_source"], "_index", {"_before": Fold("sum", F.lit(1), False)}, size, rows)
    added = _before(firsts.groupBy(F.col("_source").alias("source")).agg(F.count(F.lit(1)).alias("n")), _shift="n")
    numbered = inside.join(added, F.col("_source") == F.col("source")).select(
        "task", (F.coalesce(F.col("_before"), F.lit(0)) + F.col("_shift")).cast("long").alias("new_index")
    )
    return listed.join(numbered, "task")

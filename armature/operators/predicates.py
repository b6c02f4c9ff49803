"""Predicates on scenes: is an ingredient grasped, is the sandwich done."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armature.functions import vectors as V
from armature.schema import (
    DONE_HEIGHT,
    DONE_SPEED,
    DONE_XY,
    GRASP_DISTANCE,
    GRASP_GRIPPER,
    INGREDIENTS,
    PLATE,
    STACK,
)

STEP = ("demo", "t")


def grasped(
    frames: DataFrame,
    poses: DataFrame,
    distance: float = GRASP_DISTANCE,
    gripper: float = GRASP_GRIPPER,
    keys: Sequence[str] = STEP,
) -> DataFrame:
    """Per step: any present ingredient nearer than `distance` while the gripper is below `gripper`.

    Objects are reduced to one row per step before the join, so the frames are joined one
    to one; steps without any ingredient are not grasped.
    """
    ingredients = poses.filter(F.col("object").isin(*INGREDIENTS))
    at = ingredients.groupBy(*keys).agg(F.collect_list("pos").alias("_objects"))
    near = F.exists("_objects", lambda p: V.distance(p, "eef_pos") < distance)
    held = F.coalesce(near & (F.col("gripper") < gripper), F.lit(False))
    return frames.join(at, list(keys), "left").withColumn("grasped", held).drop("_objects")


def task_done(
    poses: DataFrame,
    xy: float = DONE_XY,
    test_mode: bool = False,
    height: float = DONE_HEIGHT,
    speed: float = DONE_SPEED,
    keys: Sequence[str] = STEP,
) -> DataFrame:
    """Per step: all layers over the plate, in rising order, and at rest. Every test is strict.

    A missing object gives false. In test mode every step is done.
    """
    if test_mode:
        return poses.select(*keys).distinct().withColumn("done", F.lit(True))

    def of(name: str, value: Column, alias: str) -> Column:
        return F.max_by(value, F.when(F.col("object") == name, F.lit(1))).alias(alias)

    wide = poses.filter(F.col("object").isin(PLATE, *STACK)).groupBy(*keys).agg(
        of(PLATE, F.col("pos"), "_plate"),
        *[of(name, F.struct("pos", V.speed("lin_vel").alias("speed")), f"_{name}") for name in STACK],
    )
    layers = [F.col(f"_{name}") for name in STACK]
    heights = [F.get(x.pos, F.lit(2)) - F.get(F.col("_plate"), F.lit(2)) for x in layers]
    aligned = [V.xy_distance(x.pos, "_plate") < xy for x in layers]
    order = [heights[0] > height, *[b > a for a, b in zip(heights, heights[1:], strict=False)]]
    rest = [x.speed < speed for x in layers]

    def every(checks: Sequence[Column]) -> Column:
        return F.coalesce(reduce(lambda p, q: p & q, checks), F.lit(False))

    return wide.select(
        *keys,
        every(aligned).alias("aligned"),
        every(order).alias("ordered"),
        every(rest).alias("stable"),
        every([*aligned, *order, *rest]).alias("done"),
    )


#: Predicates by the name a configuration uses.
PREDICATES: dict[str, Callable[..., DataFrame]] = {"grasp_ingredient": grasped, "success": task_done}

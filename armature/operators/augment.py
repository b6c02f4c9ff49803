"""New demonstrations from recorded ones: object-centred warping and stitching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from armature.functions import poses as P
from armature.functions import vectors as V
from armature.functions.draws import Draw, between, gaussian, keyed
from armature.operators.episodes import Subtask, frames_in_segments
from armature.operators.quality import generation_report
from armature.plans.blocks import BLOCK, Fold, attach, block_of, last_position, running
from armature.plans.lookups import lookup_join

# Object position range in metres, seed, and the stopping rule of a generation run.
SCENE_RANGE = 0.02
SEED = 42
TARGET_SUCCESSES = 20
MAX_FAILURES = 50


def segment_pool(
    frames: DataFrame, object_poses: DataFrame, segs: DataFrame, keys: Sequence[str] = ("demo",), **plan
) -> DataFrame:
    """Frames of every segment, numbered from its start, with the object's pose at that start.

    `segs` has (keys, subtask, object_ref, start, end); object_poses (keys, t, object, pose).
    """
    at_start = object_poses.select(
        *keys, F.col("t").alias("start"), F.col("object").alias("object_ref"), F.col("pose").alias("object_pose")
    )
    placed = segs.join(at_start, [*keys, "start", "object_ref"])
    rows = frames_in_segments(frames, placed, keys, "t", **plan)
    return rows.withColumn("step", F.col("t") - F.col("start")).drop("t", "start", "end")


def new_scenes(
    base: DataFrame,
    copies: int,
    spread: float = SCENE_RANGE,
    seed: int = SEED,
    keys: Sequence[str] = ("demo", "object_ref"),
    pose: str = "object_pose",
    draw: Draw | None = None,
) -> DataFrame:
    """`copies` randomised scenes per row: x and y move by up to `spread`, all else is kept."""
    draw = draw or keyed(seed, *keys, "copy")
    rows = base.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    p = V.lanes(pose, 7)
    moved = [p[0] + between(draw, "x", -spread, spread), p[1] + between(draw, "y", -spread, spread), *p[2:]]
    return rows.withColumn(pose, F.array(*moved))


def warp(
    chosen: DataFrame,
    pool: DataFrame,
    on: Sequence[str] = ("demo", "subtask"),
    poses: Sequence[str] = ("eef_pose", "target_eef_pose"),
    new_object: str = "new_object_pose",
    spread: Sequence[str] = ("scene",),
    scenes_per_task: int = 10_000,
    size: int = BLOCK,
) -> DataFrame:
    """Move a segment's poses along with its object: new_object * inverse(old object) * pose.

    `chosen` has one row per scene and subtask; the pose relative to the object is unchanged.
    A segment that many scenes chose is repeated for every `scenes_per_task` of them, and a
    segment longer than a block is joined block by block. `pool` should be `settled`.
    """
    on = list(on)
    if last_position(pool, "step") > size:
        blocks = pool.groupBy(*on).agg(F.max("step").alias("_last"))
        every = F.sequence(F.lit(0).cast("long"), F.floor(F.col("_last") / size).cast("long"))
        chosen = chosen.join(blocks.select(*on, F.explode(every).alias("_block")), on)
        pool = pool.withColumn("_block", block_of("step", size))
        on = [*on, "_block"]
    rows = lookup_join(chosen, pool, on, "inner", spread=spread, per_task=scenes_per_task).drop("_block")
    moved = rows.withColumns({f"_rel_{c}": P.relative("object_pose", c) for c in poses})
    turned = moved.withColumns({c: P.compose(new_object, f"_rel_{c}") for c in poses})
    return turned.drop(*[f"_rel_{c}" for c in poses])


def stitch(
    warped: DataFrame,
    subtasks: Sequence[Subtask],
    scene: Sequence[str] = ("scene",),
    pose: str = "target_eef_pose",
    **plan,
) -> DataFrame:
    """One trajectory per scene: transition, fixed steps, then the warped segment.

    Transitions start from the last target pose of the subtask before; the first subtask
    has none. Both use the gripper of the segment's first step. Offsets are computed from
    one row per (scene, subtask), so trajectories are never gathered in one task.
    """
    keys = [*scene, "subtask"]
    ends = warped.groupBy(*keys).agg(
        F.min_by(F.struct(pose, "gripper"), "step").alias("_first"),
        F.max_by(F.col(pose), "step").alias("_end"),
        (F.max("step") + 1).alias("_steps"),
    )
    order = Window.partitionBy(*scene).orderBy("subtask")
    extra = F.create_map(
        *[F.lit(v) for i, s in enumerate(subtasks) for v in (i, s.interpolation_steps)]
    )
    pause = F.create_map(*[F.lit(v) for i, s in enumerate(subtasks) for v in (i, s.fixed_steps)])
    planned = (
        ends.withColumn("_before", F.lag("_end").over(order))
        .withColumn(
            "_bridge", F.when(F.col("_before").isNull(), F.lit(0)).otherwise(F.try_element_at(extra, F.col("subtask")))
        )
        .withColumn("_pause", F.try_element_at(pause, F.col("subtask")))
        .withColumn("_rows", F.col("_bridge") + F.col("_pause") + F.col("_steps"))
        .withColumn(
            "_start", F.coalesce(F.sum("_rows").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        )
    )
    facts = planned.select(*keys, "_steps", (F.col("_start") + F.col("_bridge") + F.col("_pause")).alias("_at"))
    body = attach(warped, facts, keys, "step", F.col("_steps") - 1, **plan).select(
        *keys, (F.col("_at") + F.col("step")).cast("long").alias("t"), pose, "gripper", F.lit("segment").alias("part")
    )
    steps = planned.filter(F.col("_bridge") + F.col("_pause") > 0).withColumn(
        "_i", F.explode(F.sequence(F.lit(1), F.col("_bridge") + F.col("_pause")))
    )
    share = F.least(F.lit(1.0), F.col("_i") / (F.col("_bridge") + 1.0))
    in_bridge = F.col("_i") <= F.col("_bridge")
    bridge = steps.select(
        *keys,
        (F.col("_start") + F.col("_i") - 1).cast("long").alias("t"),
        F.when(in_bridge, P.interpolate("_before", f"_first.{pose}", share)).otherwise(F.col(f"_first.{pose}")).alias(pose),
        F.col("_first.gripper").alias("gripper"),
        F.when(in_bridge, "interpolation").otherwise("fixed").alias("part"),
    )
    return body.unionByName(bridge)


def add_action_noise(
    df: DataFrame,
    amplitude: float = 0.03,
    in_interpolation: bool = False,
    seed: int = SEED,
    keys: Sequence[str] = ("scene", "t"),
    pose: str = "target_eef_pose",
    draw: Draw | None = None,
) -> DataFrame:
    """Gaussian noise on positions; transitions and pauses stay clean unless asked."""
    draw = draw or keyed(seed, *keys)
    p = V.lanes(pose, 7)
    noisy = F.array(*[x + F.lit(amplitude) * gaussian(draw, f"noise/{i}") for i, x in enumerate(p[:3])], *p[3:])
    if in_interpolation or "part" not in df.columns:
        return df.withColumn(pose, noisy)
    return df.withColumn(pose, F.when(F.col("part") == "segment", noisy).otherwise(F.col(pose)))


def accept(
    attempts: DataFrame,
    successes: int = TARGET_SUCCESSES,
    failures: int = MAX_FAILURES,
    keep_failed: bool = True,
    guarantee: bool = True,
    by: Sequence[str] = ("run",),
    order: str = "attempt",
    size: int = BLOCK,
    longest: int | None = None,
) -> DataFrame:
    """Attempts up to the first limit reached: enough successes or too many failures.

    Without the guarantee, exactly `successes` attempts are made.
    """
    ok = F.coalesce(F.col("success"), F.lit(False)).cast("int")
    counted = running(
        attempts,
        by,
        order,
        {"_won": Fold("sum", ok, False), "_lost": Fold("sum", 1 - ok, False), "_made": Fold("sum", F.lit(1), False)},
        size,
        longest,
    )
    before = lambda c: F.coalesce(F.col(c), F.lit(0))
    open_ = (before("_won") < successes) & (before("_lost") < failures) if guarantee else before("_made") < successes
    kept = counted.filter(open_).drop("_won", "_lost", "_made")
    return kept if keep_failed else kept.filter(F.coalesce(F.col("success"), F.lit(False)))


def acceptance_report(accepted: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    ok = F.coalesce(F.col("success"), F.lit(False))
    return accepted.groupBy(*by).agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(ok).alias("successes"), F.count_if(~ok).alias("failures")
    )


def lineage(demos: DataFrame) -> DataFrame:
    """Generated demos per source demo and subtask position."""
    return (
        demos.filter(F.coalesce(F.col("mimic_generated"), F.lit(False)))
        .select("success", F.posexplode("src_demo_inds").alias("subtask", "source_demo"))
        .groupBy("subtask", "source_demo")
        .agg(
            F.count(F.lit(1)).alias("generated"),
            F.count_if(F.coalesce(F.col("success"), F.lit(False))).alias("successes"),
        )
    )


def augmentation_report(demos: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Source and generated demos with the factor gained, beside the quality report."""
    made = F.coalesce(F.col("mimic_generated"), F.lit(False))
    counts = demos.groupBy(*by).agg(
        F.count_if(~made).alias("source_demos"),
        F.count_if(made).alias("generated_demos"),
        (F.count(F.lit(1)) / F.nullif(F.count_if(~made), F.lit(0))).alias("factor"),
    )
    return counts.join(generation_report(demos, by=by).drop("generated"), list(by))

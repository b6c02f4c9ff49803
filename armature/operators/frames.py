"""Row-wise operators on frame, demo and telemetry tables: no shuffle unless said so."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armature.functions import vectors as V
from armature.functions.poses import relative
from armature.plans.blocks import attach
from armature.plans.lookups import lookup_join, settled
from armature.schema import (
    CHUNK_EPISODES,
    DEFAULT_TASK,
    DEGREE_LIMITS,
    EMBODIMENTS,
    FPS,
    JOINT_DIM,
    JOINT_SCHEMES,
    KEYS,
    MIN_DEMO_FRAMES,
    MODALITY,
    NORMAL_LIMITS,
    POS,
    PROMPTS,
    SKIPPED_FRAMES,
)


def remap_joints(
    df: DataFrame, col: str, direction: str = "to_normalized", radians: bool = True, arms: int = 1, out: str | None = None
) -> DataFrame:
    """Joint angles to normalised units, or back, per joint and without clamping.

    Two arms are two blocks of six with the same limits.
    """
    if direction not in ("to_normalized", "to_angles"):
        raise ValueError("direction must be 'to_normalized' or 'to_angles'")
    degrees, normal = DEGREE_LIMITS * arms, NORMAL_LIMITS * arms

    def remap(x: Column, i: int) -> Column:
        if direction == "to_normalized":
            return V.rescale(F.degrees(x) if radians else x, *degrees[i], *normal[i])
        angle = V.rescale(x, *normal[i], *degrees[i])
        return F.radians(angle) if radians else angle

    return df.withColumn(out or col, V.each(col, JOINT_DIM * arms, remap))


def normalize_ticks(df: DataFrame, calibration: DataFrame, col: str = "ticks", out: str = "value") -> DataFrame:
    """Encoder ticks per (robot, joint) to -100..100, grippers to 0..100.

    The homing offset is subtracted, drive_mode 1 turns the direction round, and values
    outside the calibrated range are not clamped.
    """
    joined = _calibrated(df, calibration)
    part = (F.col(col) - F.col("homing_offset") - F.col("range_min")) / F.col("_width")
    return _turned(joined, part, out)


def denormalize_ticks(df: DataFrame, calibration: DataFrame, col: str = "value", out: str = "ticks") -> DataFrame:
    joined = _calibrated(df, calibration)
    value = F.col(col)
    part = F.when(F.col("joint") == "gripper", value / 100.0).otherwise((value + 100.0) / 200.0)
    part = F.when(F.col("drive_mode") == 1, F.lit(1.0) - part).otherwise(part)
    ticks = part * F.col("_width") + F.col("range_min") + F.col("homing_offset")
    return joined.withColumn(out, ticks).drop(*_CALIBRATION)


_CALIBRATION = ("id", "drive_mode", "homing_offset", "range_min", "range_max", "_width")


def _calibrated(df: DataFrame, calibration: DataFrame) -> DataFrame:
    joined = lookup_join(df, calibration, ["robot", "joint"], "left")
    return joined.withColumn("_width", F.nullif(F.col("range_max") - F.col("range_min"), F.lit(0)))


def _turned(df: DataFrame, part: Column, out: str) -> DataFrame:
    part = F.when(F.col("drive_mode") == 1, F.lit(1.0) - part).otherwise(part)
    scaled = F.when(F.col("joint") == "gripper", part * 100.0).otherwise(part * 200.0 - 100.0)
    return df.withColumn(out, scaled).drop(*_CALIBRATION)


def range_fractions(df: DataFrame, col: str, out: str = "fraction") -> DataFrame:
    """Share of each joint's range, clamped to 0..1; the last joint is the gripper."""
    return df.withColumn(out, V.each(col, JOINT_DIM, lambda x, i: V.range_fraction(x, i == JOINT_DIM - 1)))


def split_modalities(df: DataFrame, col: str, slices: Mapping[str, tuple[int, int]] = MODALITY) -> DataFrame:
    """One column `<col>.<name>` per half-open slice."""
    return df.withColumns({f"{col}.{name}": V.slice_of(col, a, b) for name, (a, b) in slices.items()})


def merge_modalities(
    df: DataFrame, col: str, names: Sequence[str] = tuple(MODALITY), out: str = "action", dim: int = JOINT_DIM
) -> DataFrame:
    return df.withColumn(out, V.concat_checked([F.col(f"`{col}.{n}`") for n in names], dim))


def remap_keys(df: DataFrame, original_keys: Mapping[str, str]) -> DataFrame:
    """Rename columns from their original keys to modality names.

    All renames apply at once, so a swapped pair of cameras can be put right.
    """
    new_names = {old: new for new, old in original_keys.items()}
    missing = sorted(set(new_names) - set(df.columns))
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.toDF(*[new_names.get(c, c) for c in df.columns])


def _extremes(stats: DataFrame, feature: str, dim: int, by: Sequence[str]) -> DataFrame:
    rows = stats.filter(F.col("feature") == feature)
    pick = lambda name, i: F.max(F.when(F.col("dim") == i, F.col(name)))
    packed = F.struct(
        F.array(*[pick("min", i) for i in range(dim)]).alias("low"),
        F.array(*[pick("max", i) for i in range(dim)]).alias("high"),
    ).alias("_range")
    return rows.groupBy(*by).agg(packed) if by else rows.agg(packed)


def normalize_minmax(
    df: DataFrame,
    stats: DataFrame,
    col: str,
    dim: int = JOINT_DIM,
    by: Sequence[str] = (),
    enabled: bool = True,
    out: str | None = None,
    inverse: bool = False,
) -> DataFrame:
    """Scale to [-1, 1] with dataset statistics (rows of feature, dim, min, max), or back.

    Statistics of the whole table reach the expression as a scalar subquery, so no join is
    planned; per-group statistics are looked up by the `by` columns.
    """
    if not enabled:
        return df.withColumn(out, F.col(col)) if out and out != col else df
    extremes = _extremes(stats, col, dim, by)
    scale = V.denormalize if inverse else V.normalize
    if by:
        ranged = lookup_join(df, settled(extremes, "ranges"), by, "left")
    else:
        ranged = df.withColumn("_range", extremes.scalar())
    lows, highs = V.lanes("_range.low", dim), V.lanes("_range.high", dim)
    vector = V.each(col, dim, lambda x, i: scale(x, lows[i], highs[i]))
    return ranged.withColumn(out or col, vector).drop("_range")


def denormalize_minmax(df: DataFrame, stats: DataFrame, col: str, **kw) -> DataFrame:
    return normalize_minmax(df, stats, col, inverse=True, **kw)


def pad_with_mask(df: DataFrame, col: str, dim: int) -> DataFrame:
    """Zero-pad to `dim` and add `<col>_mask`, true where a value was given."""
    return df.withColumns({f"{col}_mask": V.pad_mask(col, dim), col: V.pad(col, dim)})


def unpad(df: DataFrame, col: str, dim: int = JOINT_DIM) -> DataFrame:
    return df.withColumn(col, V.unpad(col, dim))


def embodiment_id(df: DataFrame, col: str = "embodiment", ids: Mapping[str, int] = EMBODIMENTS) -> DataFrame:
    """Id of an embodiment tag, null for unknown tags."""
    table = F.create_map(*[F.lit(v) for pair in ids.items() for v in pair])
    return df.withColumn("embodiment_id", F.try_element_at(table, F.col(col)).cast("long"))


def to_ik(df: DataFrame) -> DataFrame:
    """Actions become recorded effector pose (7) and gripper, the last joint action."""
    return df.withColumn("actions", F.concat("ee_frame_state", F.slice("actions", -1, 1)))


def to_joint(df: DataFrame) -> DataFrame:
    """Actions become the recorded joint targets."""
    return df.withColumn("actions", F.col("joint_pos_target"))


def convert_actions(demos: DataFrame, frames: DataFrame, to: str | None) -> DataFrame:
    """Frames of successful demos with actions in the asked space: 'ik' or 'joint'.

    The poses and targets were recorded with the frames, so both are projections.
    """
    if to not in ("ik", "joint"):
        raise ValueError("ask for exactly one conversion: 'ik' or 'joint'")
    kept = filter_successful(demos, frames)
    return to_ik(kept) if to == "ik" else to_joint(kept)


def successful(demos: DataFrame) -> DataFrame:
    """A demo without a verdict counts as failed."""
    return demos.filter(F.coalesce(F.col("success"), F.lit(False)))


def filter_successful(
    demos: DataFrame,
    frames: DataFrame,
    keys: Sequence[str] = ("demo",),
    length: str = "num_samples",
    pos: str = "t",
    **plan,
) -> DataFrame:
    """Frames of successful demos; joined per block, so a very long demo is spread out."""
    kept = successful(demos).select(*keys, length)
    return attach(frames, kept, keys, pos, F.col(length) - 1, "left_semi", **plan)


def filter_min_length(demos: DataFrame, frames: int = MIN_DEMO_FRAMES) -> DataFrame:
    return demos.filter(F.col("num_samples") >= frames)


def skip_first(df: DataFrame, n: int = SKIPPED_FRAMES, pos: str = POS, fps: int | None = FPS) -> DataFrame:
    """Drop the first n frames and number the rest from 0, with fresh timestamps."""
    kept = df.filter(F.col(pos) >= n).withColumn(pos, F.col(pos) - n)
    return add_timestamp(kept, fps, pos) if fps and "timestamp" in df.columns else kept


def episode_slice(df: DataFrame, episode: int | None = None, start: int = 0, pos: str = POS) -> DataFrame:
    """One episode, or all, from a start frame; the filters reach partition pruning and the scan."""
    kept = df if episode is None else df.filter(F.col("episode_index") == episode)
    return kept.filter(F.col(pos) >= start)


def episode_sampler(
    df: DataFrame,
    first: int = 0,
    last: int = 0,
    keys: Sequence[str] = KEYS,
    pos: str = POS,
    lengths: DataFrame | None = None,
    **plan,
) -> DataFrame:
    """Frames that may start a sample: without the first `first` and last `last` of an episode."""
    if not last:
        return df.filter(F.col(pos) >= first)
    if lengths is None:
        lengths = df.groupBy(*keys).agg((F.max(pos) + 1).alias("length"))
    bounds = lengths.select(*keys, F.col("length").alias("_length"))
    joined = attach(df.filter(F.col(pos) >= first), bounds, keys, pos, F.col("_length") - 1, **plan)
    return joined.filter(F.col(pos) < F.col("_length") - last).drop("_length")


def cap_relative_goal(df: DataFrame, goal: str, present: str, max_relative: float, dim: int = JOINT_DIM) -> DataFrame:
    """Keep every goal within `max_relative` of the present position; flag joints moved by it."""
    limit = F.lit(float(max_relative))
    safe = V.each2(goal, present, dim, lambda g, p: p + V.clip(g - p, -limit, limit))
    moved = V.each2("safe_goal", goal, dim, lambda s, g: F.abs(s - g) > F.lit(1e-4))
    return df.withColumn("safe_goal", safe).withColumn("clamped", moved)


def default_task(c: Column | str, default: str = DEFAULT_TASK) -> Column:
    """Null and empty become the default; blanks are kept."""
    return F.coalesce(F.nullif(V.col(c), F.lit("")), F.lit(default))


def assign_prompt(df: DataFrame, col: str, prompts: Mapping[str, str] = PROMPTS, out: str = "task") -> DataFrame:
    """Instruction for an ingredient name, or for the ingredient a file name carries."""
    names = sorted(prompts, key=len, reverse=True)
    found = F.regexp_extract(F.col(col), f"({'|'.join(names)})", 1)
    table = F.create_map(*[F.lit(v) for name in names for v in (name, prompts[name])])
    return df.withColumn(out, default_task(F.try_element_at(table, found)))


def render_paths(
    df: DataFrame, chunks_size: int = CHUNK_EPISODES, cameras: Sequence[str] = (), chunk_first: bool = True
) -> DataFrame:
    """Data and video paths per episode; the chunk is episode_index div chunks_size."""
    chunk = F.floor(F.col("episode_index") / chunks_size).cast("long")
    name = F.format_string("episode_%06d", "episode_index")
    folder = F.format_string("chunk-%03d", chunk)
    out = df.withColumns(
        {"episode_chunk": chunk, "data_path": F.concat(F.lit("data/"), folder, F.lit("/"), name, F.lit(".parquet"))}
    )
    for camera in cameras:
        order = (folder, F.lit(camera)) if chunk_first else (F.lit(camera), folder)
        path = F.concat(F.lit("videos/"), order[0], F.lit("/"), order[1], F.lit("/"), name, F.lit(".mp4"))
        out = out.withColumn(f"video_path.{camera}", path)
    return out


def add_timestamp(df: DataFrame, fps: int = FPS, pos: str = POS) -> DataFrame:
    return df.withColumn("timestamp", F.col(pos) / F.lit(float(fps)))


def name_joints(df: DataFrame, col: str, scheme: str = "arm", value: str = "value") -> DataFrame:
    """One row per joint, named by position."""
    names = F.array(*[F.lit(n) for n in JOINT_SCHEMES[scheme]])
    pairs = F.arrays_zip(names.alias("joint"), F.col(col).alias(value))
    rest = [c for c in df.columns if c != col]
    return df.select(*rest, F.inline(pairs).alias("joint", value))


def in_base_frame(df: DataFrame, base: str, target: str, out: str = "ee_frame_state") -> DataFrame:
    """World pose of the target as seen from the base."""
    return df.withColumn(out, relative(base, target))

"""Windows along an episode: chunks, history, changes, latches, segments, numbering."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from armature.functions import vectors as V
from armature.functions.draws import Draw, integer, keyed
from armature.plans.blocks import BLOCK, Fold, attach, block_of, fits, over_neighbours, running
from armature.plans.lookups import lookup_join
from armature.schema import FPS, HORIZON, JOINT_DIM, KEYS, POS


def action_chunks(
    df: DataFrame,
    col: str = "action",
    horizon: int = HORIZON,
    out: str = "chunk",
    keys: Sequence[str] = KEYS,
    pos: str = POS,
    **plan,
) -> DataFrame:
    """The current and next horizon-1 vectors; past the episode end the last one repeats,
    flagged in `<out>_is_pad`. A missing vector is null in the chunk and is no padding."""
    taken = over_neighbours(
        df,
        keys,
        pos,
        lambda w: {"_taken": F.collect_list(F.struct(F.col(col).alias("v"))).over(w.rowsBetween(0, horizon - 1))},
        after=horizon - 1,
        **plan,
    )
    taken = taken.withColumn("_taken", F.transform("_taken", lambda s: s["v"]))
    have = F.size("_taken")
    filler = F.array_repeat(F.element_at("_taken", -1), F.lit(horizon) - have)
    return taken.withColumns(
        {
            out: F.concat("_taken", filler),
            f"{out}_is_pad": F.array(*[F.lit(i) >= have for i in range(horizon)]),
        }
    ).drop("_taken")


def delta_windows(
    df: DataFrame,
    deltas: Mapping[str, Sequence[float]],
    fps: float = FPS,
    keys: Sequence[str] = KEYS,
    pos: str = POS,
    **plan,
) -> DataFrame:
    """Values at time offsets in seconds, as arrays `<col>_window` with `<col>_is_pad`.

    An offset is rounded to frames. Outside the episode the first or last frame stands in.
    """
    offsets = {c: [round(d * fps) for d in ds] for c, ds in deltas.items()}
    every = [o for os in offsets.values() for o in os]

    def columns(w):
        made = {}
        for c, os in offsets.items():
            for i, o in enumerate(os):
                frame = w.rowsBetween(min(o, 0), max(o, 0))
                made[f"_{c}_{i}"] = (F.first(c) if o < 0 else F.last(c)).over(frame)
                made[f"_pad_{c}_{i}"] = F.count(F.lit(1)).over(frame) <= abs(o)
        return made

    wide = over_neighbours(
        df, keys, pos, columns, before=max(0, -min(every)), after=max(0, max(every)), **plan
    )
    out = wide.withColumns(
        {f"{c}_window": F.array(*[F.col(f"_{c}_{i}") for i in range(len(os))]) for c, os in offsets.items()}
        | {f"{c}_is_pad": F.array(*[F.col(f"_pad_{c}_{i}") for i in range(len(os))]) for c, os in offsets.items()}
    )
    return out.drop(*[x for c, os in offsets.items() for i in range(len(os)) for x in (f"_{c}_{i}", f"_pad_{c}_{i}")])


def with_history(
    df: DataFrame, cols: Sequence[str], offsets: Sequence[int] = (-1, 0), keys=KEYS, pos: str = POS, **plan
) -> DataFrame:
    """Earlier frames beside the current one; before the start the first frame stands in."""
    return delta_windows(df, {c: list(offsets) for c in cols}, 1, keys, pos, **plan)


def step_delta(
    df: DataFrame, col: str = "action", dim: int = JOINT_DIM, keys=KEYS, pos: str = POS, out: str = "delta", **plan
) -> DataFrame:
    """Change since the frame before and its largest absolute element; null on the first frame."""
    before = over_neighbours(
        df, keys, pos, lambda w: {"_before": F.lag(col, 1).over(w)}, before=1, **plan
    )
    change = F.when(F.col("_before").isNotNull(), V.each2(col, "_before", dim, lambda x, y: x - y))
    return before.withColumns(
        {out: change, f"{out}_max": F.when(F.col("_before").isNotNull(), V.max_abs_difference(col, "_before", dim))}
    ).drop("_before")


def latch(
    df: DataFrame, signal: str, out: str = "latched", keys=KEYS, pos: str = POS, **plan
) -> DataFrame:
    """False until the signal was first true, true from there on."""
    on = F.coalesce(F.col(signal), F.lit(False)).cast("int")
    latched = running(df, keys, pos, {out: Fold("max", on)}, **plan)
    return latched.withColumn(out, F.col(out) == 1)


def boundaries(
    df: DataFrame, signals: Sequence[str], keys: Sequence[str] = KEYS, pos: str = POS
) -> DataFrame:
    """First position where each signal is true (null: never) and the episode length."""
    firsts = [F.min(F.when(F.col(s), F.col(pos))).alias(f"{s}_boundary") for s in signals]
    return df.groupBy(*keys).agg(*firsts, (F.max(pos) + 1).alias("length"))


def never_triggered(bounds: DataFrame, signals: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per episode and signal that never became true."""
    rows = F.inline(
        F.array(*[F.struct(F.lit(s).alias("signal"), F.col(f"{s}_boundary").alias("_at")) for s in signals])
    )
    return bounds.select(*keys, rows.alias("signal", "_at")).filter(F.col("_at").isNull()).drop("_at")


@dataclass(frozen=True)
class Subtask:
    """One step of a task; the last one has no signal and ends with the episode."""

    object_ref: str
    signal: str | None = None
    offset_range: tuple[int, int] = (0, 0)
    strategy: str = "random"
    nn_k: int = 3
    action_noise: float = 0.03
    interpolation_steps: int = 5
    fixed_steps: int = 0
    noise_in_interpolation: bool = False
    description: str = ""


# The two subtasks of picking an ingredient and placing it.
PICK_AND_PLACE = (
    Subtask("bread_slice_1", "grasp_ingredient", (10, 20), "nearest_neighbor_object", 5, 0.002, 8, 0, False,
            "Grasp bread slice from cartridge"),
    Subtask("plate", None, (0, 0), "nearest_neighbor_object", 5, 0.002, 8, 0, False, "Place bread slice on plate"),
)


def segments(
    bounds: DataFrame,
    subtasks: Sequence[Subtask],
    seed: int = 42,
    keys: Sequence[str] = KEYS,
    draw: Draw | None = None,
) -> DataFrame:
    """Half-open [start, end) per subtask, for episodes where every signal triggered.

    A drawn offset moves each boundary but the last; ends stay inside the episode and in order.
    """
    if not subtasks or subtasks[-1].signal is not None or subtasks[-1].offset_range != (0, 0):
        raise ValueError("the last subtask must have no signal and an offset range of (0, 0)")
    draw = draw or keyed(seed, *keys)
    start: Column = F.lit(0).cast("long")
    rows, known = [], F.lit(True)
    for i, task in enumerate(subtasks):
        if task.signal is None:
            end = F.col("length")
        else:
            boundary = F.col(f"{task.signal}_boundary")
            known = known & boundary.isNotNull()
            end = F.greatest(start, F.least(boundary + integer(draw, f"offset/{i}", *task.offset_range), F.col("length")))
        rows.append(
            F.struct(
                F.lit(i).alias("subtask"),
                F.lit(task.object_ref).alias("object_ref"),
                start.alias("start"),
                end.alias("end"),
            )
        )
        start = end
    return bounds.filter(known).select(*keys, F.inline(F.array(*rows)))


def frames_in_segments(
    df: DataFrame,
    segs: DataFrame,
    keys: Sequence[str] = KEYS,
    pos: str = POS,
    size: int = BLOCK,
    longest: int | None = None,
) -> DataFrame:
    """Frames with the segment they fall in (start <= position < end).

    A segment is repeated per block it touches, so the join has an equality on
    (keys, block) and a range test only within a block.
    """
    inside = (F.col(pos) >= F.col("start")) & (F.col(pos) < F.col("end"))
    if fits(longest, size):
        return df.join(segs, list(keys)).filter(inside)
    touched = segs.filter(F.col("end") > F.col("start")).withColumn(
        "_block",
        F.explode(
            F.sequence(
                F.floor(F.col("start") / size).cast("long"), F.floor((F.col("end") - 1) / size).cast("long")
            )
        ),
    )
    joined = df.withColumn("_block", block_of(pos, size)).join(touched, [*keys, "_block"])
    return joined.filter(inside).drop("_block")


def renumber(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    pos: str = POS,
    size: int = BLOCK,
    rows: int | None = None,
) -> DataFrame:
    """Close the gaps left by filters: episodes 0.., frames 0.. and a global `index` per dataset.

    Counts per (episode, block) give all offsets; frames are ranked within a block only.
    `rows` is an upper bound on the table, if known.
    """
    *outer, episode = keys
    counts = df.groupBy(*keys, block_of(pos, size).alias("_block")).agg(F.count(F.lit(1)).alias("_rows"))
    lengths = counts.groupBy(*keys).agg(F.sum("_rows").alias("_length"))
    numbered = running(
        lengths,
        outer,
        episode,
        {"_episode": Fold("sum", F.lit(1), False), "_offset": Fold("sum", F.col("_length"), False)},
        size,
        rows,
    )
    if fits(rows, size):
        offsets, on = numbered.withColumn("_before", F.lit(0)), list(keys)
        joined = df.join(offsets, on)
    else:
        ahead = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        shifted = counts.select(*keys, "_block", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_before"))
        on = [*keys, "_block"]
        joined = df.withColumn("_block", block_of(pos, size)).join(shifted.join(numbered, list(keys)), on)
    rank = F.row_number().over(Window.partitionBy(*on).orderBy(pos)) - 1
    placed = joined.withColumn("_frame", (rank + F.col("_before")).cast("long"))
    return placed.withColumns(
        {
            episode: F.coalesce(F.col("_episode"), F.lit(0)).cast("long"),
            pos: F.col("_frame"),
            "index": (F.coalesce(F.col("_offset"), F.lit(0)) + F.col("_frame")).cast("long"),
        }
    ).drop("_block", "_before", "_episode", "_offset", "_length", "_frame")


def list_episodes(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Available episodes in order."""
    return df.select(*keys).distinct().orderBy(*keys)


def frame_gaps(
    df: DataFrame,
    fps: float = FPS,
    tolerance: float = 1e-4,
    keys: Sequence[str] = KEYS,
    pos: str = POS,
    size: int = BLOCK,
    longest: int | None = None,
) -> DataFrame:
    """Frames whose time step differs from 1/fps; works on positions with holes, too."""
    seen = running(df, keys, pos, {"_last": Fold("last", F.col("timestamp"), False)}, size, longest)
    step = F.col("timestamp") - F.col("_last")
    return seen.withColumn("step_seconds", step).drop("_last").filter(F.abs(step - F.lit(1.0 / fps)) > tolerance)


def with_tasks(frames: DataFrame, tasks: DataFrame, on: Sequence[str] = ("dataset", "task_index")) -> DataFrame:
    """Frames with their instruction; unknown and empty tasks get the default text."""
    from armature.operators.frames import default_task

    joined = lookup_join(frames, tasks.select(*on, "task"), on, "left", spread=[POS, "episode_index"])
    return joined.withColumn("task", default_task("task"))


def video_cuts(
    frames: DataFrame,
    episodes: DataFrame,
    keys: Sequence[str] = KEYS,
    pos: str = POS,
    **plan,
) -> DataFrame:
    """Frames with their camera segment: seconds in the combined file, and whether inside it.

    `episodes` holds video_segments, a map from camera to (from_ts, to_ts); a camera
    without times is skipped.
    """
    segs = cut_manifest(episodes, keys).select(*keys, "camera", "from_ts", "to_ts", "_last")
    joined = attach(frames, segs, keys, pos, F.col("_last"), "inner", **plan)
    at = F.col("from_ts") + F.col("timestamp")
    return joined.drop("_last").withColumn("video_ts", at).filter((at >= F.col("from_ts")) & (at < F.col("to_ts")))


def cut_manifest(episodes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per episode and camera: where to cut the combined video."""
    named = episodes.select(
        *keys, (F.col("length") - 1).alias("_last"), F.explode("video_segments").alias("camera", "_segment")
    )
    known = named.filter(F.col("_segment.from_ts").isNotNull() & F.col("_segment.to_ts").isNotNull())
    target = F.concat(
        F.lit("videos/"), F.col("camera"), F.lit("/chunk-000/"), F.format_string("episode_%06d.mp4", "episode_index")
    )
    return known.select(
        *keys,
        "camera",
        F.col("_segment.from_ts").alias("from_ts"),
        F.col("_segment.to_ts").alias("to_ts"),
        (F.col("_segment.to_ts") - F.col("_segment.from_ts")).alias("duration"),
        target.alias("target"),
        "_last",
    )

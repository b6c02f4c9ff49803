"""Statistics, integrity checks and reports. Groups are aggregated partially before any shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from armature.functions import vectors as V
from armature.plans.blocks import Fold, rank_buckets, running
from armature.plans.lookups import lookup_join, settled
from armature.schema import (
    ARM_DIM,
    CHUNK_EPISODES,
    JOINT_DIM,
    JOINTS,
    KEYS,
    NEAR_ZERO,
    OUT_OF_RANGE,
    STATIC_VARIANCE,
    TWITCH,
)

CHUNK_KEYS = ("run", "episode_index", "chunk")


def feature_stats(df: DataFrame, features: Mapping[str, int], by: Sequence[str] = (), ddof: int = 1) -> DataFrame:
    """Rows of (by, feature, dim, min, max, mean, std, count) from one pass.

    ddof 1 is the rule for dataset statistics, ddof 0 the one for predicted chunks.
    """
    deviation = F.stddev_samp if ddof else F.stddev_pop
    aggregates, rows = [], []
    for feature, dim in features.items():
        for i, x in enumerate(V.lanes(f"`{feature}`", dim)):
            name = f"_{feature}_{i}"
            x = x.cast("double")
            aggregates += [
                F.min(x).alias(f"{name}_min"),
                F.max(x).alias(f"{name}_max"),
                F.avg(x).alias(f"{name}_mean"),
                deviation(x).alias(f"{name}_std"),
                F.count(x).alias(f"{name}_count"),
            ]
            rows.append(
                F.struct(
                    F.lit(feature).alias("feature"),
                    F.lit(i).alias("dim"),
                    *[F.col(f"`{name}_{s}`").alias(s) for s in ("min", "max", "mean", "std", "count")],
                )
            )
    wide = df.groupBy(*by).agg(*aggregates) if by else df.agg(*aggregates)
    return wide.select(*by, F.inline(F.array(*rows)))


def joint_ranges(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Smallest and largest value per named joint."""
    stats = feature_stats(df, {col: JOINT_DIM}, by)
    names = F.array(*[F.lit(n) for n in JOINTS])
    return stats.select(*by, F.get(names, F.col("dim")).alias("joint"), "min", "max")


def episode_summary(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Length and sorted task indices per episode."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("length"), F.sort_array(F.collect_set("task_index")).alias("tasks")
    )


def dataset_info(
    df: DataFrame, video_features: int = 0, chunks_size: int = CHUNK_EPISODES, by: Sequence[str] = ("dataset",)
) -> DataFrame:
    """Totals per dataset; videos are episodes times video features, chunks the ones in use."""
    per_episode = df.groupBy(*by, "episode_index", "task_index").agg(F.count(F.lit(1)).alias("_rows"))
    return per_episode.groupBy(*by).agg(
        F.count_distinct("episode_index").alias("total_episodes"),
        F.sum("_rows").alias("total_frames"),
        F.count_distinct("task_index").alias("total_tasks"),
        (F.count_distinct("episode_index") * video_features).alias("total_videos"),
        F.count_distinct(F.floor(F.col("episode_index") / chunks_size)).alias("total_chunks"),
    )


def generation_report(demos: DataFrame, total: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Totals of a generated dataset. The percentage is of `total`, the demo count if not given."""
    n = F.count(F.lit(1)) if total is None else F.lit(total)
    ok = F.coalesce(F.col("success"), F.lit(False))
    return demos.groupBy(*by).agg(
        n.cast("long").alias("total"),
        F.count_if(ok).alias("successes"),
        (F.lit(100.0) * F.count_if(ok) / F.nullif(n, F.lit(0))).alias("success_percent"),
        F.avg("num_samples").alias("mean_length"),
        F.min("num_samples").alias("min_length"),
        F.max("num_samples").alias("max_length"),
        F.count_if(F.coalesce(F.col("mimic_generated"), F.lit(False))).alias("generated"),
    )


def verify_counts(
    demos: DataFrame, frames: DataFrame, columns: Sequence[str] = ("actions",), keys: Sequence[str] = ("demo",)
) -> DataFrame:
    """Stored length against the rows that really hold each column; demos without frames have 0."""
    found = frames.groupBy(*keys).agg(*[F.count(c).alias(f"{c}_rows") for c in columns])
    joined = demos.select(*keys, "num_samples").join(found, list(keys), "left")
    counts = {f"{c}_rows": F.coalesce(F.col(f"{c}_rows"), F.lit(0)) for c in columns}
    complete = reduce(lambda a, b: a & b, [F.col(f"{c}_rows") == F.col("num_samples") for c in columns])
    return joined.withColumns(counts).withColumn("complete", complete)


def diagnose_chunks(pred: DataFrame, col: str = "action", keys: Sequence[str] = CHUNK_KEYS) -> DataFrame:
    """Four health checks per predicted chunk, all strict.

    near_zero looks at every joint, the other three at the arm only. A chunk is a fixed
    number of steps, so the window below never grows. With one step the change is null
    and the chunk is not called twitching.
    """
    window = Window.partitionBy(*keys).orderBy("step")
    arm = V.arm_of(col)
    change = F.when(
        F.col("_before").isNotNull(),
        V.max_abs_difference(col, "_before", ARM_DIM),
    )
    checked = pred.withColumn("_before", F.lag(col, 1).over(window)).groupBy(*keys).agg(
        F.max(V.max_abs(col, JOINT_DIM)).alias("max_abs"),
        F.max(V.max_abs(col, ARM_DIM)).alias("arm_max_abs"),
        F.greatest(*[F.var_pop(x) for x in arm]).alias("arm_max_variance"),
        F.max(change).alias("max_step_change"),
    )
    return checked.withColumns(
        {
            "near_zero": F.col("max_abs") < NEAR_ZERO,
            "static": F.col("arm_max_variance") < STATIC_VARIANCE,
            "out_of_range": F.col("arm_max_abs") > OUT_OF_RANGE,
            "twitching": F.coalesce(F.col("max_step_change") < TWITCH, F.lit(False)),
        }
    )


def masked_mse(df: DataFrame, predicted: str, target: str, mask: str, dim: int, by: Sequence[str] = ()) -> DataFrame:
    """Sum of masked squared errors over the number of masked-in elements; null if none is."""
    kept = [F.coalesce(m, F.lit(False)) for m in V.lanes(mask, dim)]
    errors = [
        F.when(m, (p - y) * (p - y)).otherwise(F.lit(0.0))
        for m, p, y in zip(kept, V.lanes(predicted, dim), V.lanes(target, dim), strict=True)
    ]
    number = F.sum(V.total([m.cast("int") for m in kept]))
    return df.groupBy(*by).agg((F.sum(V.total(errors)) / F.nullif(number, F.lit(0))).alias("loss"), number.alias("elements"))


def prediction_error(
    pred: DataFrame, recorded: DataFrame, on: Sequence[str], predicted="action", dim: int = JOINT_DIM, by=()
) -> DataFrame:
    """Masked error of predictions against the recorded vectors at the same step."""
    truth = recorded.select(*on, F.col("action").alias("_truth"))
    masked = pred.join(truth, list(on)).withColumn("_mask", F.array(*[F.lit(True)] * dim))
    return masked_mse(masked, predicted, "_truth", "_mask", dim, by)


def success_rate(trials: DataFrame, by: Sequence[str]) -> DataFrame:
    ok = F.coalesce(F.col("success"), F.lit(False))
    return trials.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trials"),
        F.count_if(ok).alias("successes"),
        F.avg(ok.cast("int")).alias("success_rate"),
    )


def instruction_effect(trials: DataFrame, state: Sequence[str], outcome: str = "outcome") -> DataFrame:
    """Per visual state: does the outcome change when only the instruction does?

    One outcome per instruction first, so outcomes that vary on their own are told apart.
    """
    per_instruction = trials.groupBy(*state, "instruction").agg(
        F.min(outcome).alias("_low"), F.max(outcome).alias("_high")
    )
    return per_instruction.groupBy(*state).agg(
        F.count(F.lit(1)).alias("instructions"),
        (F.min("_low") != F.max("_high")).alias("outcomes_differ"),
        F.bool_and(F.col("_low") == F.col("_high")).alias("repeatable"),
    ).withColumn("instruction_matters", F.col("outcomes_differ") & F.col("repeatable"))


def histogram(df: DataFrame, col: str, dim: int = JOINT_DIM, bins: int = 50, by: Sequence[str] = ()) -> DataFrame:
    """Equal bins over the data range of each dimension, the last one closed, empty ones included.

    Two passes: ranges first (per `by` group, a handful of rows), then counts.
    """
    lanes = F.array(*[F.struct(F.lit(i).alias("dim"), x.alias("x")) for i, x in enumerate(V.lanes(col, dim))])
    ranges = df.groupBy(*by).agg(
        F.array(
            *[F.struct(F.min(x).alias("low"), F.max(x).alias("high")) for x in V.lanes(col, dim)]
        ).alias("_ranges")
    )
    if by:
        ranges = settled(ranges, "ranges")
        ranged = lookup_join(df, ranges, by, "left")
    else:
        ranged = df.withColumn("_ranges", ranges.scalar())
    flat = lambda c: F.col("high") == F.col("low")
    edges = {
        "_from": F.when(flat(0), F.col("low") - 0.5).otherwise(F.col("low")),
        "_to": F.when(flat(0), F.col("high") + 0.5).otherwise(F.col("high")),
    }
    values = (
        ranged.select(*by, "_ranges", F.inline(lanes))
        .withColumn("_range", F.get("_ranges", F.col("dim")))
        .withColumns({"low": F.col("_range.low"), "high": F.col("_range.high")})
        .withColumns(edges)
    )
    place = F.floor((F.col("x") - F.col("_from")) / (F.col("_to") - F.col("_from")) * bins)
    counted = (
        values.filter(F.col("x").isNotNull())
        .groupBy(*by, "dim", F.least(place, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    frame = (
        ranges.select(*by, F.posexplode("_ranges").alias("dim", "_range"))
        .select(*by, "dim", F.col("_range.low").alias("low"), F.col("_range.high").alias("high"))
        .withColumns(edges)
        .withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    )
    width = (F.col("_to") - F.col("_from")) / bins
    return frame.join(counted, [*by, "dim", "bin"], "left").select(
        *by,
        "dim",
        "bin",
        (F.col("_from") + F.col("bin") * width).alias("low"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def quantile_values(df: DataFrame, by: Sequence[str], col: str, shares: Sequence[float], accuracy: int = 1000) -> DataFrame:
    """by, _share, value: the smallest value that at least the share of a group's values do not exceed, exactly.

    Approximate quantiles a little to both sides enclose it. Values below are only counted, and only
    the different values in between are put in order, a small part of the group.
    """
    by = list(by)
    values = df.filter(F.col(col).isNotNull()).select(*by, F.col(col).alias("_value"))
    ends = [x for s in shares for x in (max(0.0, s - 2.0 / accuracy), min(1.0, s + 2.0 / accuracy))]
    facts = values.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_value", [float(x) for x in ends], accuracy * 2).alias("_ends"))
    asked = F.explode(F.array(*[F.struct(F.lit(float(s)).alias("_share"), F.get("_ends", F.lit(2 * i)).alias("_low"), F.get("_ends", F.lit(2 * i + 1)).alias("_high")) for i, s in enumerate(shares)]))
    bounds = facts.select(*by, "_n", asked.alias("_a")).select(*by, "_n", "_a.*")
    rows = lookup_join(values, settled(bounds, "quantile-bounds"), by, "inner")
    below = rows.filter(F.col("_value") < F.col("_low")).groupBy(*by, "_share").agg(F.count(F.lit(1)).alias("_below"))
    near = rows.filter((F.col("_value") >= F.col("_low")) & (F.col("_value") <= F.col("_high"))).groupBy(*by, "_share", "_n", "_value").agg(F.count(F.lit(1)).alias("_rows"))
    window = Window.partitionBy(*by, "_share").orderBy("_value")
    upto = near.join(below, [*by, "_share"], "left").withColumn("_upto", F.coalesce("_below", F.lit(0)) + F.sum("_rows").over(window))
    # Shares times counts are exact enough to tell a whole rank from the next.
    return upto.filter(F.col("_upto") >= F.ceil(F.col("_share") * F.col("_n") - F.lit(1e-9))).groupBy(*by, "_share").agg(F.min("_value").alias("value"))


def latency_report(telemetry: DataFrame, by: Sequence[str] = ("stage",)) -> DataFrame:
    """Latency per stage in milliseconds with exact quantiles, and the rate one event at a time allows."""
    by = list(by)
    facts = telemetry.groupBy(*by).agg(
        F.count("latency_ms").alias("events"),
        F.avg("latency_ms").alias("mean_ms"),
        F.max("latency_ms").alias("max_ms"),
        (F.lit(1000.0) / F.nullif(F.avg("latency_ms"), F.lit(0.0))).alias("hz"),
    )
    found = quantile_values(telemetry, by, "latency_ms", [0.5, 0.95])
    wide = found.groupBy(*by).agg(
        F.max(F.when(F.col("_share") == 0.5, F.col("value"))).alias("p50_ms"),
        F.max(F.when(F.col("_share") == 0.95, F.col("value"))).alias("p95_ms"),
    )
    return facts.join(wide, by, "left").select(*by, "events", "mean_ms", "p50_ms", "p95_ms", "max_ms", "hz")


def task_overlap(tasks: DataFrame) -> DataFrame:
    """Datasets per task text, and whether the text belongs to one dataset only."""
    return tasks.groupBy("task").agg(
        F.sort_array(F.collect_set("dataset")).alias("datasets"), F.count_distinct("dataset").alias("n_datasets")
    ).withColumn("is_distinct", F.col("n_datasets") == 1)


def video_sizes(files: DataFrame, by: Sequence[str] = ("camera", "codec")) -> DataFrame:
    return files.groupBy(*by).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def missing_required(required: DataFrame, present: DataFrame, on: Sequence[str]) -> DataFrame:
    """Required rows that are not present."""
    return required.join(present.select(*on), list(on), "left_anti")


# Files a dataset must hold; a tuple lists names of which one is enough.
REQUIRED_FILES = (("meta/info.json",), ("meta/stats.json",), ("meta/tasks.json", "meta/tasks.parquet"))


# Files a training loader asks for, and fields a recorded demo must hold.
TRAINING_FILES = (("meta/modality.json",), ("meta/info.json",), ("meta/episodes.jsonl",), ("meta/tasks.jsonl",))
DEMO_FIELDS = (("actions",), ("obs/joint_pos",), ("obs/front",), ("obs/wrist",))


def missing_files(
    files: DataFrame, owners: DataFrame, required=REQUIRED_FILES, owner: str = "dataset", name: str = "path"
) -> DataFrame:
    """Rows (owner, missing) for each required file or field none of whose names is listed."""
    wanted = {name: " or ".join(names) for names in required for name in names}
    table = F.create_map(*[F.lit(v) for pair in wanted.items() for v in pair])
    have = files.select(owner, F.try_element_at(table, F.col(name)).alias("missing")).filter("missing is not null")
    every = F.array(*[F.lit(" or ".join(names)) for names in required])
    return missing_required(
        owners.select(owner, F.explode(every).alias("missing")), have.distinct(), [owner, "missing"]
    )


def check_ik(before: DataFrame, after: DataFrame, keys: Sequence[str] = ("demo",), pos: str = "t") -> DataFrame:
    """Per demo: same steps, 6 became 8 elements, gripper and effector pose kept."""
    a = before.select(*keys, pos, F.col("actions").alias("_in"), F.col("ee_frame_state").alias("_eef"), F.lit(1).alias("_a"))
    b = after.select(*keys, pos, F.col("actions").alias("_out"), F.lit(1).alias("_b"))
    both = a.join(b, [*keys, pos], "full")
    last = lambda c: F.array(F.try_element_at(c, F.lit(-1)))
    return both.groupBy(*keys).agg(
        F.count("_a").alias("steps_in"),
        F.count("_b").alias("steps_out"),
        F.coalesce(F.bool_and((F.size("_in") == JOINT_DIM) & (F.size("_out") == 8)), F.lit(False)).alias("widths_ok"),
        F.bool_and(V.all_close(last("_in"), last("_out"), 1)).alias("gripper_ok"),
        F.bool_and(V.all_close("_eef", "_out", 7)).alias("pose_ok"),
    ).withColumn(
        "valid", (F.col("steps_in") == F.col("steps_out")) & F.col("widths_ok") & F.col("gripper_ok") & F.col("pose_ok")
    )


def check_joint(before: DataFrame, after: DataFrame, keys: Sequence[str] = ("demo",), pos: str = "t") -> DataFrame:
    """Per demo of `after`: actions equal the recorded joint targets, and the largest difference."""
    a = before.select(*keys, pos, F.col("joint_pos_target").alias("_target"))
    b = after.select(*keys, pos, F.col("actions").alias("_out"))
    return a.join(b, [*keys, pos], "right").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("steps"),
        F.bool_and(V.all_close("_target", "_out", JOINT_DIM)).alias("equal"),
        F.max(V.max_abs_difference("_target", "_out", JOINT_DIM)).alias("max_difference"),
    )


def common_demos(left: DataFrame, right: DataFrame, on: Sequence[str] = ("demo",)) -> DataFrame:
    """Rows of the left side whose demo exists on the right, too."""
    return left.join(right.select(*on).distinct(), list(on), "left_semi")


def camera_mapping(wanted: DataFrame, available: DataFrame, by: Sequence[str] = ("rig",)) -> DataFrame:
    """The i-th wanted camera gets the i-th available id; status tells same, mapped or missing."""
    by = list(by)
    w = wanted.withColumn("slot", F.row_number().over(Window.partitionBy(*by).orderBy("camera_order")) - 1)
    a = available.withColumn("slot", F.row_number().over(Window.partitionBy(*by).orderBy("camera_id")) - 1)
    status = (
        F.when(F.col("camera_id").isNull(), "missing")
        .when(F.col("camera_id") == F.col("slot"), "same")
        .otherwise("mapped")
    )
    return w.join(a, [*by, "slot"], "left").select(*by, "slot", "camera", "camera_id", status.alias("status"))


def tracking_error(df: DataFrame, commanded: str, actual: str, dim: int = JOINT_DIM) -> DataFrame:
    """Commanded minus actual position per joint, with the largest size."""
    return df.withColumns(
        {
            "tracking_error": V.each2(commanded, actual, dim, lambda a, b: a - b),
            "max_tracking_error": V.max_abs_difference(commanded, actual, dim),
        }
    )


def asof_tracking(
    commands: DataFrame,
    actuals: DataFrame,
    keys: Sequence[str],
    pos: str,
    col: str = "joints",
    size: int | None = None,
    longest: int | None = None,
) -> DataFrame:
    """Each actual row with the newest command at or before it.

    `pos` is an integer time; at equal times the command comes first. One ordered union
    with a running last value, carried over blocks of `size` time units; if not given, blocks
    are cut at quantiles of the time, so that each holds about as many rows.
    """
    cut = rank_buckets(actuals, F.col(pos)) if size is None else None
    if size is None:
        size, longest = 1, None if cut is not None else 1
    rest = [c for c in actuals.columns if c not in (*keys, pos, col)]
    empty = [F.lit(None).cast(actuals.schema[c].dataType).alias(c) for c in rest]
    both = (
        commands.select(*keys, pos, F.col(col).alias("_command"), F.lit(None).cast(actuals.schema[col].dataType).alias(col),
                        F.lit(0).alias("_side"), *empty)
        .unionByName(
            actuals.select(*keys, pos, F.lit(None).cast(commands.schema[col].dataType).alias("_command"), col,
                           F.lit(1).alias("_side"), *rest)
        )
        .withColumn("_order", F.col(pos) * 2 + F.col("_side"))
    )
    filled = running(both, keys, "_order", {"commanded": Fold("last", F.col("_command"))}, 2 * size if cut is None else cut, longest)
    return filled.filter(F.col("_side") == 1).drop("_command", "_side", "_order")


def compare_stats(pred_stats: DataFrame, train_stats: DataFrame, on: Sequence[str] = ("dim",)) -> DataFrame:
    """Predicted against training ranges per joint."""
    p = pred_stats.select(*on, *[F.col(c).alias(f"pred_{c}") for c in ("min", "max", "mean", "std")])
    t = train_stats.select(*on, *[F.col(c).alias(f"train_{c}") for c in ("min", "max", "mean", "std")])
    outside = (F.col("pred_min") < F.col("train_min")) | (F.col("pred_max") > F.col("train_max"))
    return p.join(t, list(on)).withColumn("outside_training", outside)


def training_alerts(
    metrics: DataFrame, patience: int = 1000, by: Sequence[str] = ("run",), size: int = 1_000_000, longest: int | None = None
) -> DataFrame:
    """Flags per logged step: plateau, overfit, NaN and a loss above 1.

    Plateau: no new lowest loss for `patience` steps. Overfit: validation loss rose while
    training loss fell since the row before.
    """
    loss, step = F.col("loss"), F.col("step")
    usable = F.when(~F.isnan(loss), loss)
    best = running(metrics, by, "step", {"_best": Fold("min", usable, False)}, size, longest, keep=True)
    improved = usable.isNotNull() & (F.col("_best").isNull() | (usable < F.col("_best")))
    seen = running(
        best,
        by,
        "step",
        {
            "_best_step": Fold("last", F.when(improved, step)),
            "_loss": Fold("last", loss, False),
            "_eval": Fold("last", F.col("eval_loss"), False),
        },
        size,
        longest,
    )
    flags = {
        "plateau": F.coalesce(step - F.col("_best_step") >= patience, F.lit(False)),
        "overfit": F.coalesce((F.col("eval_loss") > F.col("_eval")) & (loss < F.col("_loss")), F.lit(False)),
        "is_nan": F.isnan(loss),
        "too_high": ~F.isnan(loss) & (loss > 1.0),
    }
    return seen.withColumns(flags).drop("_best", "_best_step", "_loss", "_eval")


def best_checkpoint(evals: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """Lowest validation loss and highest success rate per run; the earlier checkpoint wins ties."""
    step = F.col("checkpoint")
    return evals.groupBy(*by).agg(
        F.min_by(step, F.struct("eval_loss", "checkpoint")).alias("by_loss"),
        F.max_by(step, F.struct(F.col("success_rate"), -step)).alias("by_success"),
    )


def first_steps(df: DataFrame, n: int, step: str = "step") -> DataFrame:
    """The first n steps of every chunk."""
    return df.filter(F.col(step) < n)

"""Row-wise operators on frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from armature.catalog import base as Q
from armature.catalog.base import query, r6, spread, sql_r6
from armature.fixtures import literal_rows
from armature.functions import vectors as V
from armature.operators import frames as P
from armature.operators import quality as A
from armature.operators.episodes import with_tasks
from armature.plans.lookups import settled
from armature.schema import DEGREE_LIMITS, JOINTS, KEYS, NORMAL_LIMITS, POS, PROMPTS

FRAME = [*KEYS, POS]


def _normal(i: int, x: str) -> str:
    (a, b), (c, d) = DEGREE_LIMITS[i], NORMAL_LIMITS[i]
    return f"({x} - ({a}::DOUBLE)) / ({b - a}::DOUBLE) * ({d - c}::DOUBLE) + ({c}::DOUBLE)"


def _angle(i: int, x: str) -> str:
    (a, b), (c, d) = DEGREE_LIMITS[i], NORMAL_LIMITS[i]
    return f"({x} - ({c}::DOUBLE)) / ({d - c}::DOUBLE) * ({b - a}::DOUBLE) + ({a}::DOUBLE)"


@query(
    "remap_joints",
    f"WITH {Q.FRAMES} SELECT {Q.EPISODE}, "
    + ", ".join(sql_r6(_normal(i, f"degrees(radians(a{i}))"), f"n{i}") for i in range(6))
    + ", "
    + ", ".join(sql_r6(f"radians({_angle(i, f'a{i}')})", f"r{i}") for i in range(6))
    + " FROM fx",
)
def remap_joints(fx):
    turned = fx.frames().withColumn("radians", V.to_radians("action"))
    normal = P.remap_joints(turned, "radians", "to_normalized", out="normal")
    both = P.remap_joints(normal, "action", "to_angles", out="angles")
    return both.select(*FRAME, *spread("normal", "n", 6), *spread("angles", "r", 6))


@query(
    "remap_two_arms",
    f"WITH {Q.WITH_STATE} SELECT {Q.EPISODE}, "
    + ", ".join(sql_r6(_normal(i, f"a{i}"), f"n{i}") for i in range(6))
    + ", "
    + ", ".join(sql_r6(_normal(i, f"s{i}"), f"n{i + 6}") for i in range(6))
    + " FROM fs",
)
def remap_two_arms(fx):
    both = fx.frames_with_state().withColumn("arms", F.concat("action", "state"))
    normal = P.remap_joints(both, "arms", "to_normalized", radians=False, arms=2)
    return normal.select(*FRAME, *spread("arms", "n", 12))


@query(
    "convert_degrees",
    f"WITH {Q.FRAMES} SELECT {Q.EPISODE}, "
    + ", ".join(sql_r6(f"radians(a{i})", f"rad{i}") for i in range(6))
    + ", "
    + ", ".join(sql_r6(f"degrees(a{i} / 100.0::DOUBLE)", f"deg{i}") for i in range(6))
    + " FROM fx",
)
def convert_degrees(fx):
    small = V.each("action", 6, lambda x, _: x / F.lit(100.0))
    return fx.frames().select(
        *FRAME, *spread(V.to_radians("action"), "rad", 6), *spread(V.to_degrees(small), "deg", 6)
    )


@query(
    "range_fraction",
    f"WITH {Q.FRAMES} SELECT {Q.EPISODE}, "
    + ", ".join(
        sql_r6(
            f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, "
            + (f"(a{i} + 100.0::DOUBLE) / 200.0::DOUBLE" if i < 5 else f"a{i} / 100.0::DOUBLE")
            + "))",
            f"f{i}",
        )
        for i in range(6)
    )
    + " FROM fx",
)
def range_fraction(fx):
    return P.range_fractions(fx.frames(), "action").select(*FRAME, *spread("fraction", "f", 6))


CALIBRATION = """
cal AS (SELECT * FROM (VALUES
  ('shoulder_pan', 1, 0, -156, 1024, 3072), ('shoulder_lift', 2, 0, 89, 1200, 2900), ('elbow_flex', 3, 1, 12, 900, 3100),
  ('wrist_flex', 4, 0, -40, 1000, 3000), ('wrist_roll', 5, 1, 7, 0, 4095), ('gripper', 6, 0, 3, 1500, 2700))
  c(joint, id, drive_mode, homing_offset, range_min, range_max))"""
_PART = "(ticks - homing_offset - range_min) / CAST(range_max - range_min AS DOUBLE)"


def _calibration(fx):
    rows = [
        ("shoulder_pan", 1, 0, -156, 1024, 3072),
        ("shoulder_lift", 2, 0, 89, 1200, 2900),
        ("elbow_flex", 3, 1, 12, 900, 3100),
        ("wrist_flex", 4, 0, -40, 1000, 3000),
        ("wrist_roll", 5, 1, 7, 0, 4095),
        ("gripper", 6, 0, 3, 1500, 2700),
    ]
    names = ("joint", "id", "drive_mode", "homing_offset", "range_min", "range_max")
    return literal_rows(fx.spark, names, rows).withColumn("robot", F.lit("events"))


@query(
    "normalize_ticks",
    f"""WITH {Q.FRAMES}, {CALIBRATION},
    j AS (SELECT {Q.EPISODE}, unnest([{", ".join(repr(n) for n in JOINTS)}]) AS joint,
          unnest([{Q.ACTION}]) AS value, event_id FROM fx),
    k AS (SELECT j.*, cal.* EXCLUDE (joint), floor(value * 10.0::DOUBLE) + 2000.0::DOUBLE AS ticks FROM j JOIN cal USING (joint)),
    p AS (SELECT *, CASE WHEN drive_mode = 1 THEN 1.0::DOUBLE - {_PART} ELSE {_PART} END AS part FROM k)
    SELECT {Q.EPISODE}, joint, {sql_r6("CASE WHEN joint = 'gripper' THEN part * 100.0::DOUBLE ELSE part * 200.0::DOUBLE - 100.0::DOUBLE END", "value")},
           {sql_r6("ticks", "ticks")} FROM p""",
)
def normalize_ticks(fx):
    calibration = _calibration(fx)
    joints = P.name_joints(fx.frames(), "action").select(
        *FRAME, "joint", F.col("dataset").alias("robot"), (F.floor(F.col("value") * 10.0) + 2000.0).alias("ticks")
    )
    normal = P.normalize_ticks(joints, calibration).drop("ticks")
    back = P.denormalize_ticks(normal, calibration)
    return back.select(*FRAME, "joint", r6("value").alias("value"), r6("ticks").alias("ticks"))


@query(
    "split_modalities",
    f"""WITH {Q.FRAMES} SELECT {Q.EPISODE}, 5 AS arm_size, 1 AS gripper_size, a0 AS arm_first, a4 AS arm_last, a5 AS gripper,
    a0 AS m0, a1 AS m1, a2 AS m2, a3 AS m3, a4 AS m4, a5 AS m5 FROM fx""",
)
def split_modalities(fx):
    parts = P.split_modalities(fx.frames(), "action")
    whole = P.merge_modalities(parts, "action", out="merged")
    arm, gripper = F.col("`action.single_arm`"), F.col("`action.gripper`")
    return whole.select(
        *FRAME,
        F.size(arm).alias("arm_size"),
        F.size(gripper).alias("gripper_size"),
        F.get(arm, F.lit(0)).alias("arm_first"),
        F.get(arm, F.lit(4)).alias("arm_last"),
        F.get(gripper, F.lit(0)).alias("gripper"),
        *spread("merged", "m", 6, False),
    )


@query(
    "remap_keys",
    f"""WITH {Q.FRAMES} SELECT {Q.EPISODE}, 'camera_b/' || frame_index AS front, 'camera_a/' || frame_index AS wrist FROM fx""",
)
def remap_keys(fx):
    named = fx.frames().select(
        *FRAME,
        F.concat(F.lit("camera_a/"), F.col(POS).cast("string")).alias("front"),
        F.concat(F.lit("camera_b/"), F.col(POS).cast("string")).alias("wrist"),
    )
    return P.remap_keys(named, {"front": "wrist", "wrist": "front"})


_RANGES = f"mm AS (SELECT {Q.sql_list('min(a{i}) AS lo{i}, max(a{i}) AS hi{i}', 6)} FROM fx)"


def _scaled(i: int) -> str:
    return (
        f"CASE WHEN hi{i} = lo{i} THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * (a{i} - lo{i}) / nullif(hi{i} - lo{i}, 0) - 1.0::DOUBLE END"
    )


@query(
    "normalize_minmax",
    f"WITH {Q.FRAMES}, {_RANGES} SELECT {Q.EPISODE}, "
    + ", ".join(sql_r6(_scaled(i), f"n{i}") for i in range(6))
    + f", {Q.ROUNDED_ACTION} FROM fx, mm",
)
def normalize_minmax(fx):
    frames = fx.frames()
    stats = settled(A.feature_stats(frames, {"action": 6}), "stats")
    scaled = P.normalize_minmax(frames, stats, "action", out="scaled")
    renamed = stats.withColumn("feature", F.lit("scaled"))
    back = P.denormalize_minmax(scaled, renamed, "scaled", out="restored")
    return back.select(*FRAME, *spread("scaled", "n", 6), *spread("restored", "a", 6))


@query(
    "normalize_by_dataset",
    f"""WITH {Q.TWO_DATASETS},
    mm AS (SELECT dataset, {Q.sql_list('min(a{i}) AS lo{i}, max(a{i}) AS hi{i}', 6)} FROM ab GROUP BY dataset)
    SELECT dataset, episode_index, frame_index, """
    + ", ".join(sql_r6(_scaled(i), f"n{i}") for i in range(6))
    + " FROM ab JOIN mm USING (dataset)",
)
def normalize_by_dataset(fx):
    frames = fx.two_datasets()
    stats = settled(A.feature_stats(frames, {"action": 6}, by=["dataset"]), "stats")
    return P.normalize_minmax(frames, stats, "action", by=["dataset"]).select(*FRAME, *spread("action", "n", 6))


@query(
    "pad_with_mask",
    f"""WITH {Q.FRAMES} SELECT {Q.EPISODE}, 64 AS state_size, 32 AS action_size, {Q.ROUNDED_ACTION},
    0.0::DOUBLE AS first_pad, true AS last_valid, false AS first_invalid, 6 AS valid_state, 6 AS valid_action,
    {sql_r6("a0 + a1 + a2 + a3 + a4 + a5", "total")} FROM fx""",
)
def pad_with_mask(fx):
    both = fx.frames().withColumn("state", F.col("action"))
    padded = P.pad_with_mask(P.pad_with_mask(both, "state", 64), "action", 32)
    count = lambda c: F.size(F.filter(c, lambda m: m))
    return padded.select(
        *FRAME,
        F.size("state").alias("state_size"),
        F.size("action").alias("action_size"),
        *spread(V.unpad("state"), "a", 6),
        F.get("action", F.lit(6)).alias("first_pad"),
        F.get("action_mask", F.lit(5)).alias("last_valid"),
        F.get("action_mask", F.lit(6)).alias("first_invalid"),
        count("state_mask").alias("valid_state"),
        count("action_mask").alias("valid_action"),
        r6(F.aggregate("state", F.lit(0.0), lambda s, x: s + x)).alias("total"),
    )


@query(
    "pad_embedding_states",
    """SELECT vec_id, 64 AS size, 64 AS valid, CASE WHEN label = 3 THEN 31 END::BIGINT AS embodiment_id,
    round(list_sum(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))), 4) AS total FROM embeddings""",
)
def pad_embedding_states(fx):
    """Vectors that fill the state width exactly; only label 3 carries a known embodiment tag."""
    tagged = fx.table("embeddings").select(
        "vec_id",
        F.col("embedding").cast("array<double>").alias("state"),
        F.when(F.col("label") == 3, "new_embodiment").otherwise("other").alias("embodiment"),
    )
    padded = P.embodiment_id(P.pad_with_mask(tagged, "state", 64))
    return padded.select(
        "vec_id",
        F.size("state").alias("size"),
        F.size(F.filter("state_mask", lambda m: m)).alias("valid"),
        "embodiment_id",
        F.round(F.aggregate("state", F.lit(0.0), lambda s, x: s + F.abs(x)), 4).alias("total"),
    )


@query(
    "cap_relative_goal",
    f"WITH {Q.WITH_STATE}, c AS (SELECT *, "
    + ", ".join(f"s{i} + greatest(-20.0::DOUBLE, least(20.0::DOUBLE, a{i} - s{i})) AS g{i}" for i in range(6))
    + f" FROM fs) SELECT {Q.EPISODE}, "
    + ", ".join(sql_r6(f"g{i}", f"g{i}") for i in range(6))
    + ", "
    + ", ".join(f"abs(g{i} - a{i}) > 1e-4 AS c{i}" for i in range(6))
    + " FROM c",
)
def cap_relative_goal(fx):
    capped = P.cap_relative_goal(fx.frames_with_state(), "action", "state", 20.0)
    return capped.select(*FRAME, *spread("safe_goal", "g", 6), *spread("clamped", "c", 6, False))


@query(
    "frames_with_task",
    f"""WITH {Q.FRAMES}, {Q.TASKS} SELECT {Q.EPISODE}, task_index,
    CASE WHEN task_index = 2 THEN 'Perform the task.' ELSE task END AS task FROM fx LEFT JOIN tk USING (task_index)""",
)
def frames_with_task(fx):
    """Task 2 has an empty text here, so its frames get the default instruction."""
    tasks = fx.tasks().withColumn("task", F.when(F.col("task_index") == 2, "").otherwise(F.col("task")))
    return with_tasks(fx.frames(), tasks).select(*FRAME, "task_index", "task")


@query(
    "assign_prompt",
    f"""SELECT p_partkey, CASE p_partkey % 5 {" ".join(f"WHEN {i} THEN '{PROMPTS[n]}'" for i, n in enumerate(PROMPTS))}
    ELSE 'Perform the task.' END AS task FROM part""",
)
def assign_prompt(fx):
    names = F.array(*[F.lit(n) for n in (*PROMPTS, "lettuce")])
    files = fx.table("part").select(
        "p_partkey",
        F.concat(
            F.lit("datasets/"), F.get(names, (F.col("p_partkey") % 5).cast("int")), F.lit("_demos_"), F.col("p_partkey")
        ).alias("path"),
    )
    return P.assign_prompt(files, "path").drop("path")


@query(
    "render_paths",
    """WITH e AS (SELECT DISTINCT l_orderkey AS episode_index FROM lineitem)
    SELECT episode_index, episode_index // 1000 AS episode_chunk,
      printf('data/chunk-%03d/episode_%06d.parquet', episode_index // 1000, episode_index) AS data_path,
      printf('videos/chunk-%03d/wrist/episode_%06d.mp4', episode_index // 1000, episode_index) AS wrist_path,
      printf('videos/wrist/chunk-%03d/episode_%06d.mp4', episode_index // 1000, episode_index) AS old_wrist_path FROM e""",
)
def render_paths(fx):
    episodes = fx.table("lineitem").select(F.col("l_orderkey").alias("episode_index")).distinct()
    new = P.render_paths(episodes, cameras=["wrist"]).withColumnRenamed("video_path.wrist", "wrist_path")
    old = P.render_paths(new, cameras=["wrist"], chunk_first=False)
    return old.withColumnRenamed("video_path.wrist", "old_wrist_path")


@query(
    "name_joints",
    f"""WITH {Q.FRAMES} SELECT {Q.EPISODE}, unnest(['Rotation', 'Pitch', 'Elbow', 'Wrist_Pitch', 'Wrist_Roll', 'Jaw']) AS joint,
    unnest([{Q.ACTION}]) AS value FROM fx""",
)
def name_joints(fx):
    return P.name_joints(fx.frames().select(*FRAME, "action"), "action", "simulated")


@query(
    "skip_first",
    f"""WITH {Q.FRAMES} SELECT dataset, episode_index, frame_index - 5 AS frame_index,
    {sql_r6("(frame_index - 5) / 30.0::DOUBLE", "timestamp")}, event_id FROM fx WHERE frame_index >= 5""",
)
def skip_first(fx):
    return P.skip_first(fx.frames()).select(*FRAME, r6("timestamp").alias("timestamp"), "event_id")


@query(
    "episode_slice",
    f"""WITH {Q.FRAMES} SELECT {Q.EPISODE}, a0 FROM fx WHERE frame_index >= 10""",
)
def episode_slice(fx):
    return P.episode_slice(fx.frames(), start=10).select(*FRAME, F.get("action", F.lit(0)).alias("a0"))


@query(
    "episode_sampler",
    f"""WITH {Q.FRAMES}, n AS (SELECT dataset, episode_index, count(*) AS length FROM fx GROUP BY ALL)
    SELECT dataset, episode_index, frame_index FROM fx JOIN n USING (dataset, episode_index)
    WHERE frame_index >= 5 AND frame_index < length - 15""",
)
def episode_sampler(fx):
    return P.episode_sampler(fx.frames(), 5, 15, longest=fx.longest).select(*FRAME)


@query(
    "filter_demos",
    f"""WITH {Q.DEMOS} SELECT fx.dataset, fx.episode_index, frame_index FROM fx JOIN dm USING (dataset, episode_index)
    WHERE coalesce(success, false) AND num_samples >= 60""",
)
def filter_demos(fx):
    kept = P.filter_min_length(fx.demos(), 60)
    return P.filter_successful(kept, fx.frames(), KEYS, pos=POS, longest=fx.longest).select(*FRAME)

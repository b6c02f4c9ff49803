"""Canonical tables and fixed values."""

from __future__ import annotations

import math

from pyspark.sql import types as T

KEYS = ("dataset", "episode_index")
POS = "frame_index"

JOINT_DIM = 6
ARM_DIM = 5
STATE_PAD = 64
ACTION_PAD = 32
HORIZON = 16
EXECUTED = 8
FPS = 30
CHUNK_EPISODES = 1000
MIN_DEMO_FRAMES = 10
SKIPPED_FRAMES = 5

FRAMES = T.StructType(
    [
        T.StructField("index", T.LongType()),
        T.StructField("frame_index", T.LongType()),
        T.StructField("episode_index", T.LongType()),
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("task_index", T.LongType()),
        T.StructField("action", T.ArrayType(T.FloatType())),
        T.StructField("observation.state", T.ArrayType(T.FloatType())),
    ]
)

TELEMETRY = T.StructType(
    [
        T.StructField("robot", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("kind", T.StringType()),
        T.StructField("joints", T.ArrayType(T.DoubleType())),
        T.StructField("stage", T.StringType()),
        T.StructField("latency_ms", T.DoubleType()),
    ]
)

# Joint names by position, in the three naming schemes in use.
JOINTS = ("shoulder_pan", "shoulder_lift", "elbow_flex", "wrist_flex", "wrist_roll", "gripper")
JOINT_SCHEMES = {
    "arm": JOINTS,
    "physical": ("joint_1", "joint_2", "joint_3", "joint_4", "joint_5", "joint_6"),
    "simulated": ("Rotation", "Pitch", "Elbow", "Wrist_Pitch", "Wrist_Roll", "Jaw"),
}

# Joint limits in degrees and in normalised units, by position.
DEGREE_LIMITS = ((-110.0, 110.0), (-100.0, 100.0), (-100.0, 90.0), (-95.0, 95.0), (-160.0, 160.0), (-10.0, 100.0))
NORMAL_LIMITS = ((-100.0, 100.0), (-100.0, 100.0), (-100.0, 100.0), (-100.0, 100.0), (-100.0, 100.0), (0.0, 100.0))

# Smoothing presets as (alpha, largest change per step, seconds between steps).
SMOOTHING_PRESETS = {"light": (0.7, 10.0, 0.03), "medium": (0.4, 5.0, 0.05), "heavy": (0.2, 3.0, 0.08)}
SMOOTHING_ALPHA = 0.3
SMOOTHING_MAX_DELTA = 5.0

# Modality slices of the single-arm vectors.
MODALITY = {"single_arm": (0, 5), "gripper": (5, 6)}

# Embodiment ids; the tag for custom robots is 31.
EMBODIMENTS = {"new_embodiment": 31}

# The instruction used when a task text is missing.
DEFAULT_TASK = "Perform the task."

# Ingredient to instruction.
PROMPTS = {
    "bread_slice_1": "Pick up the first bread slice and place it on the plate",
    "bread_slice_2": "Pick up the second bread slice and place it on top",
    "cheese_slice": "Pick up the cheese slice and place it on the bread",
    "patty": "Pick up the patty and place it on the cheese",
}

# Scene objects, and the thresholds of the grasp and done predicates.
INGREDIENTS = ("bread_slice_1", "bread_slice_2", "patty", "cheese_slice")
STACK = ("bread_slice_1", "cheese_slice", "patty", "bread_slice_2")
PLATE = "plate"
GRASP_DISTANCE = 0.05
GRASP_GRIPPER = 0.60
DONE_XY = 0.05
DONE_HEIGHT = 0.005
DONE_SPEED = 0.05

# Chunk health limits.
NEAR_ZERO = 0.01
STATIC_VARIANCE = 1e-4
OUT_OF_RANGE = math.pi
TWITCH = 0.01

# Dataset versions, path templates and codecs.
V3, V21 = "v3.0", "v2.1"
EPISODE_DATA_PATH = "data/chunk-{episode_chunk:03d}/episode_{episode_index:06d}.parquet"
CAMERA_FIRST_PATH = "videos/{video_key}/chunk-{episode_chunk:03d}/episode_{episode_index:06d}.mp4"
CHUNK_FIRST_PATH = "videos/chunk-{episode_chunk:03d}/{video_key}/episode_{episode_index:06d}.mp4"
V3_ONLY_FIELDS = ("data_files_size_in_mb", "video_files_size_in_mb")

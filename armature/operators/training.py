"""Training rows: packed samples and flow-matching targets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armature.functions import vectors as V
from armature.functions.draws import Draw, gaussian, keyed
from armature.operators.episodes import action_chunks, with_history, with_tasks
from armature.operators.frames import embodiment_id, normalize_minmax
from armature.schema import ACTION_PAD, EMBODIMENTS, HORIZON, JOINT_DIM, KEYS, POS, STATE_PAD

# Shape of the timestep distribution and number of buckets.
BETA_ALPHA = 1.5
NOISE_SCALE = 0.999
TIME_BUCKETS = 1000


def flow_times(df: DataFrame, seed: int = 0, keys: Sequence[str] = (*KEYS, POS), draw: Draw | None = None) -> DataFrame:
    """One time per chunk: (0.999 - B) / 0.999 with B from Beta(1.5, 1), and its bucket.

    Beta(a, 1) has the distribution function b**a, so a draw is u**(1/a). The bucket
    truncates toward zero, as the time can fall just below 0.
    """
    draw = draw or keyed(seed, *keys)
    beta = F.pow(draw("time"), F.lit(1.0 / BETA_ALPHA))
    time = (F.lit(NOISE_SCALE) - beta) / F.lit(NOISE_SCALE)
    return df.withColumn("flow_t", time).withColumn("flow_bucket", (F.col("flow_t") * TIME_BUCKETS).cast("long"))


def flow_targets(
    chunks: DataFrame,
    col: str = "chunk",
    horizon: int = HORIZON,
    dim: int = JOINT_DIM,
    seed: int = 0,
    keys: Sequence[str] = (*KEYS, POS),
    draw: Draw | None = None,
) -> DataFrame:
    """Noise N(0,1), the noisy chunk (1-t)*noise + t*action, and the velocity action - noise."""
    draw = draw or keyed(seed, *keys)
    timed = flow_times(chunks, seed, keys, draw)
    noise = F.array(
        *[F.array(*[gaussian(draw, f"noise/{s}/{d}") for d in range(dim)]) for s in range(horizon)]
    )
    steps = lambda fn: F.zip_with(col, "noise", lambda a, n: V.each2(a, n, dim, fn))
    t = F.col("flow_t")
    return timed.withColumn("noise", noise).withColumns(
        {
            "noisy": steps(lambda a, n: (F.lit(1.0) - t) * n + t * a),
            "velocity": steps(lambda a, n: a - n),
        }
    )


def training_samples(
    frames: DataFrame,
    tasks: DataFrame,
    stats: DataFrame,
    embodiment: str = "new_embodiment",
    ids: Mapping[str, int] = EMBODIMENTS,
    horizon: int = HORIZON,
    dim: int = JOINT_DIM,
    keys: Sequence[str] = KEYS,
    pos: str = POS,
    **plan,
) -> DataFrame:
    """Instruction, normalised state and action chunk, both zero-padded with masks.

    Vectors are normalised before chunks are cut, once per frame instead of once per step.
    """
    scaled = normalize_minmax(normalize_minmax(frames, stats, "action", dim), stats, "state", dim)
    told = with_tasks(scaled, tasks)
    chunked = action_chunks(told, "action", horizon, "chunk", keys, pos, **plan)
    padded_steps = F.transform("chunk", lambda step: V.pad(step, ACTION_PAD))
    mask = F.array_repeat(V.pad_mask("action", ACTION_PAD), horizon)
    tagged = chunked.withColumn("embodiment", F.lit(embodiment))
    return embodiment_id(tagged, ids=ids).select(
        *keys,
        pos,
        "task",
        "embodiment_id",
        V.pad("state", STATE_PAD).alias("state"),
        V.pad_mask("state", STATE_PAD).alias("state_mask"),
        padded_steps.alias("action"),
        mask.alias("action_mask"),
        F.col("chunk_is_pad").alias("action_is_pad"),
    )


def frame_pairs(frames: DataFrame, cols: Sequence[str], keys: Sequence[str] = KEYS, pos: str = POS, **plan) -> DataFrame:
    """Previous and current frame of each listed column, as video history is sampled."""
    return with_history(frames, cols, (-1, 0), keys, pos, **plan)

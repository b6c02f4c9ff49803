"""Training rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from armature.catalog import base as Q
from armature.catalog.base import md5_draw, query, r6, spread, sql_draw, sql_r6
from armature.operators import episodes as W
from armature.operators import quality as A
from armature.operators import training as R
from armature.plans.lookups import settled
from armature.schema import KEYS, POS

FRAME = [*KEYS, POS]
_TIME = f"(0.999::DOUBLE - pow({sql_draw(0, 'time', 'episode_index', 'frame_index')}, {1 / 1.5!r}::DOUBLE)) / 0.999::DOUBLE"


@query(
    "flow_times",
    f"WITH {Q.FRAMES}, t AS (SELECT *, {_TIME} AS ft FROM fx) SELECT {Q.EPISODE}, {sql_r6('ft', 'flow_t')}, CAST(trunc(ft * 1000) AS BIGINT) AS flow_bucket FROM t",
)
def flow_times(fx):
    timed = R.flow_times(fx.frames(), draw=md5_draw(0, "episode_index", POS))
    return timed.select(*FRAME, r6("flow_t").alias("flow_t"), "flow_bucket")


def _noise(s: int, d: int) -> str:
    keys = ("episode_index", "frame_index")
    return f"sqrt(-2.0::DOUBLE * ln({sql_draw(0, f'noise/{s}/{d}/radius', *keys)})) * cos(2.0::DOUBLE * pi() * {sql_draw(0, f'noise/{s}/{d}/angle', *keys)})"


_PICKS = ((0, 0), (0, 5), (3, 2))


@query(
    "flow_targets",
    f"WITH {Q.FRAMES}, t AS (SELECT *, {_TIME} AS ft, "
    + ", ".join(
        f"last_value(a{d}) OVER (PARTITION BY dataset, episode_index ORDER BY frame_index ROWS BETWEEN CURRENT ROW AND {s} FOLLOWING) AS x{s}_{d}, {_noise(s, d)} AS n{s}_{d}"
        for s, d in _PICKS
    )
    + f" FROM fx) SELECT {Q.EPISODE}, "
    + ", ".join(
        f"{sql_r6(f'(1.0::DOUBLE - ft) * n{s}_{d} + ft * x{s}_{d}', f'noisy{s}_{d}')}, {sql_r6(f'x{s}_{d} - n{s}_{d}', f'velocity{s}_{d}')}"
        for s, d in _PICKS
    )
    + " FROM t",
)
def flow_targets(fx):
    """Four-step chunks; three elements of the noisy chunk and the velocity are compared."""
    chunks = W.action_chunks(fx.frames(), horizon=4, longest=fx.longest)
    flow = R.flow_targets(chunks, horizon=4, draw=md5_draw(0, "episode_index", POS))
    at = lambda c, s, d: F.get(F.get(c, F.lit(s)), F.lit(d))
    return flow.select(
        *FRAME,
        *[r6(at("noisy", s, d)).alias(f"noisy{s}_{d}") for s, d in _PICKS],
        *[r6(at("velocity", s, d)).alias(f"velocity{s}_{d}") for s, d in _PICKS],
    )


@query("flow_moments")
def flow_moments(fx):
    """Mean and deviation of hashed times and noise over every frame."""
    chunks = fx.frames().withColumn("chunk", F.array("action"))
    flow = R.flow_targets(chunks, horizon=1)
    noise = F.get(F.get("noise", F.lit(0)), F.lit(0))
    return flow.agg(
        r6(F.avg("flow_t")).alias("mean_t"),
        r6(F.avg(noise)).alias("mean_noise"),
        r6(F.stddev_pop(noise)).alias("std_noise"),
        F.min("flow_bucket").alias("low"),
        F.max("flow_bucket").alias("high"),
    )


_LOHI = f"mm AS (SELECT {Q.sql_list('min(a{i}) AS lo{i}, max(a{i}) AS hi{i}, min(s{i}) AS ls{i}, max(s{i}) AS hs{i}', 6)} FROM fs)"


@query(
    "training_samples",
    f"""WITH {Q.WITH_STATE}, {Q.TASKS}, {_LOHI},
    n AS (SELECT {Q.EPISODE}, task_index, {", ".join(f"2.0::DOUBLE * (a{i} - lo{i}) / (hi{i} - lo{i}) - 1.0::DOUBLE AS a{i}" for i in range(6))},
      {", ".join(f"2.0::DOUBLE * (s{i} - ls{i}) / (hs{i} - ls{i}) - 1.0::DOUBLE AS s{i}" for i in range(6))} FROM fs, mm),
    c AS (SELECT *, count(*) OVER w AS have, {", ".join(f"last_value(a{i}) OVER w AS z{i}" for i in range(6))} FROM n
      WINDOW w AS (PARTITION BY dataset, episode_index ORDER BY frame_index ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING))
    SELECT {Q.EPISODE}, task, 31::BIGINT AS embodiment_id, {", ".join(sql_r6(f"s{i}", f"s{i}") for i in range(6))},
      {", ".join(sql_r6(f"z{i}", f"z{i}") for i in range(6))}, 64 AS state_size, 16 AS steps, 32 AS action_size, 6 AS state_valid, 6 AS action_valid,
      16 - CAST(have AS INTEGER) AS padded FROM c JOIN tk USING (task_index)""",
)
def training_samples(fx):
    """Packed samples; the state, the last step of the chunk, sizes and masks are compared."""
    frames = fx.frames_with_state()
    stats = settled(A.feature_stats(frames, {"action": 6, "state": 6}), "stats")
    samples = R.training_samples(frames, fx.tasks(), stats, longest=fx.longest)
    last = F.get("action", F.lit(15))
    true = lambda c: F.size(F.filter(c, lambda m: m))
    return samples.select(
        *FRAME,
        "task",
        "embodiment_id",
        *spread("state", "s", 6),
        *spread(last, "z", 6),
        F.size("state").alias("state_size"),
        F.size("action").alias("steps"),
        F.size(last).alias("action_size"),
        true("state_mask").alias("state_valid"),
        true(F.get("action_mask", F.lit(15))).alias("action_valid"),
        true("action_is_pad").alias("padded"),
    )

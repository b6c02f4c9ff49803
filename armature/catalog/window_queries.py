"""Windows along episodes, smoothing and predicted chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from armature.catalog import base as Q
from armature.catalog.base import md5_draw, query, r3, r6, spread, sql_draw, sql_r3, sql_r6
from armature.functions import vectors as V
from armature.operators import episodes as W
from armature.operators import quality as A
from armature.operators import sampling as T
from armature.operators import smoothing as S
from armature.schema import KEYS, POS

FRAME = [*KEYS, POS]
OVER = "OVER (PARTITION BY dataset, episode_index ORDER BY frame_index"


@query(
    "action_chunks",
    f"WITH {Q.FRAMES}, n AS (SELECT *, count(*) {OVER} ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS have FROM fx) SELECT {Q.EPISODE}, "
    + ", ".join(f"last_value(a0) {OVER} ROWS BETWEEN CURRENT ROW AND {k} FOLLOWING) AS first{k}" for k in range(16))
    + ", "
    + ", ".join(f"last_value(a5) {OVER} ROWS BETWEEN CURRENT ROW AND {k} FOLLOWING) AS grip{k}" for k in range(16))
    + ", 16 - CAST(have AS INTEGER) AS padded, have < 16 AS last_is_pad FROM n",
)
def action_chunks(fx):
    chunks = W.action_chunks(fx.frames(), longest=fx.longest)
    steps = [F.get("chunk", F.lit(k)) for k in range(16)]
    return chunks.select(
        *FRAME,
        *[F.get(s, F.lit(0)).alias(f"first{k}") for k, s in enumerate(steps)],
        *[F.get(s, F.lit(5)).alias(f"grip{k}") for k, s in enumerate(steps)],
        F.size(F.filter("chunk_is_pad", lambda p: p)).alias("padded"),
        F.get("chunk_is_pad", F.lit(15)).alias("last_is_pad"),
    )


@query(
    "action_chunks_missing",
    f"""WITH {Q.FRAMES}, m AS (SELECT *, CASE WHEN event_id % 5 = 0 THEN NULL ELSE a0 END AS x FROM fx),
    n AS (SELECT *, count(*) {OVER} ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS have FROM m) SELECT {Q.EPISODE}, """
    + ", ".join(f"last_value(x) {OVER} ROWS BETWEEN CURRENT ROW AND {k} FOLLOWING) AS step{k}" for k in range(4))
    + ", 4 - CAST(have AS INTEGER) AS padded FROM n",
)
def action_chunks_missing(fx):
    """Frames without an action keep their place in a chunk."""
    frames = fx.frames().withColumn("action", F.when(F.col("event_id") % 5 != 0, F.col("action")))
    chunks = W.action_chunks(frames, horizon=4, longest=fx.longest)
    steps = [F.get(F.get("chunk", F.lit(k)), F.lit(0)).alias(f"step{k}") for k in range(4)]
    return chunks.select(*FRAME, *steps, F.size(F.filter("chunk_is_pad", lambda p: p)).alias("padded"))


@query(
    "action_chunks_blocked",
    f"WITH {Q.FRAMES} SELECT {Q.EPISODE}, least(16, count(*) {OVER} ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)) AS have, "
    + sql_r6(f"sum(a0) {OVER} ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)", "total")
    + " FROM fx",
)
def action_chunks_blocked(fx):
    """The plan for long episodes, forced by a block of 32 frames."""
    chunks = W.action_chunks(fx.frames(), size=32)
    valid = F.filter(F.arrays_zip("chunk", "chunk_is_pad"), lambda s: ~s["chunk_is_pad"])
    return chunks.select(
        *FRAME,
        F.size(valid).cast("long").alias("have"),
        r6(F.aggregate(valid, F.lit(0.0), lambda t, s: t + F.get(s["chunk"], F.lit(0)))).alias("total"),
    )


@query(
    "history",
    f"WITH {Q.FRAMES} SELECT {Q.EPISODE}, "
    + ", ".join(f"coalesce(lag(a{i}) {OVER}), a{i}) AS before{i}, a{i} AS now{i}" for i in range(6))
    + ", frame_index = 0 AS is_pad FROM fx",
)
def history(fx):
    pairs = W.with_history(fx.frames(), ["action"], longest=fx.longest)
    before, now = F.get("action_window", F.lit(0)), F.get("action_window", F.lit(1))
    return pairs.select(
        *FRAME, *spread(before, "before", 6, False), *spread(now, "now", 6, False), F.get("action_is_pad", F.lit(0)).alias("is_pad")
    )


@query(
    "delta_windows",
    f"""WITH {Q.FRAMES}, n AS (SELECT *, max(frame_index) OVER (PARTITION BY dataset, episode_index) AS last FROM fx)
    SELECT {Q.EPISODE}, first_value(a0) {OVER} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS w0, frame_index < 3 AS p0,
      a0 AS w1, last_value(a0) {OVER} ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS w2, frame_index + 15 > last AS p2,
      last_value(a5) {OVER} ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS g0 FROM n""",
)
def delta_windows(fx):
    frames = fx.frames().withColumn("grip", F.get("action", F.lit(5)))
    wide = W.delta_windows(frames, {"action": [-0.1, 0.0, 0.5], "grip": [0.033]}, longest=fx.longest)
    at = lambda i: F.get(F.get("action_window", F.lit(i)), F.lit(0))
    return wide.select(
        *FRAME,
        at(0).alias("w0"),
        F.get("action_is_pad", F.lit(0)).alias("p0"),
        at(1).alias("w1"),
        at(2).alias("w2"),
        F.get("action_is_pad", F.lit(2)).alias("p2"),
        F.get("grip_window", F.lit(0)).alias("g0"),
    )


@query(
    "step_delta",
    f"WITH {Q.FRAMES}, d AS (SELECT {Q.EPISODE}, "
    + ", ".join(f"a{i} - lag(a{i}) {OVER}) AS d{i}" for i in range(6))
    + f" FROM fx) SELECT {Q.EPISODE}, "
    + ", ".join(sql_r6(f"d{i}", f"d{i}") for i in range(6))
    + ", "
    + sql_r6("greatest(" + ", ".join(f"abs(d{i})" for i in range(6)) + ")", "biggest")
    + " FROM d",
)
def step_delta(fx):
    changed = W.step_delta(fx.frames(), longest=fx.longest)
    return changed.select(*FRAME, *spread("delta", "d", 6), r6("delta_max").alias("biggest"))


LATCHED = f"bool_or(a0 > 150) {OVER} ROWS UNBOUNDED PRECEDING)"


@query("latch", f"WITH {Q.FRAMES} SELECT {Q.EPISODE}, {LATCHED} AS latched FROM fx")
def latch(fx):
    return W.latch(_signal(fx), "grasp", longest=fx.longest).select(*FRAME, "latched")


@query("latch_blocked", f"WITH {Q.FRAMES} SELECT {Q.EPISODE}, {LATCHED} AS latched FROM fx")
def latch_blocked(fx):
    """The plan for long episodes, forced by a block of 32 frames."""
    return W.latch(_signal(fx), "grasp", size=32).select(*FRAME, "latched")


def _signal(fx):
    return fx.frames().withColumn("grasp", F.get("action", F.lit(0)) > 150)


BOUNDS = f"""{Q.FRAMES},
b AS (SELECT dataset, episode_index, min(frame_index) FILTER (a0 > 150) AS boundary, max(frame_index) + 1 AS length
      FROM fx GROUP BY dataset, episode_index)"""


@query("boundaries", f"WITH {BOUNDS} SELECT dataset, episode_index, boundary AS grasp_boundary, length FROM b")
def boundaries(fx):
    return W.boundaries(_signal(fx), ["grasp"])


@query(
    "never_triggered",
    f"WITH {BOUNDS} SELECT dataset, episode_index, 'grasp' AS signal FROM b WHERE boundary IS NULL",
)
def never_triggered(fx):
    return W.never_triggered(W.boundaries(_signal(fx), ["grasp"]), ["grasp"])


SEGMENTS = f"""{BOUNDS},
o AS (SELECT *, greatest(0, least(length, boundary + 10 + CAST(floor({sql_draw(42, "offset/0", "episode_index")} * 11) AS BIGINT))) AS cut
      FROM b WHERE boundary IS NOT NULL),
sg AS (SELECT dataset, episode_index, 0 AS subtask, 'bread_slice_1' AS object_ref, 0::BIGINT AS start, cut AS end_ FROM o
       UNION ALL SELECT dataset, episode_index, 1, 'plate', cut, length FROM o)"""


def _segments(fx):
    steps = (W.Subtask("bread_slice_1", "grasp", (10, 20)), W.Subtask("plate"))
    return W.segments(W.boundaries(_signal(fx), ["grasp"]), steps, draw=md5_draw(42, "episode_index"))


@query("segments", f'WITH {SEGMENTS} SELECT dataset, episode_index, subtask, object_ref, start, end_ AS "end" FROM sg')
def segments(fx):
    return _segments(fx)


@query(
    "frames_in_segments",
    f"""WITH {SEGMENTS} SELECT dataset, episode_index, frame_index, subtask, object_ref FROM fx
    JOIN sg USING (dataset, episode_index) WHERE frame_index >= start AND frame_index < end_""",
)
def frames_in_segments(fx):
    return W.frames_in_segments(fx.frames(), _segments(fx), longest=fx.longest).select(*FRAME, "subtask", "object_ref")


RENUMBERED = f"""{Q.FRAMES},
k AS (SELECT * FROM fx WHERE a0 > 150),
d AS (SELECT *, dense_rank() OVER (PARTITION BY dataset ORDER BY episode_index) - 1 AS new_episode,
      row_number() {OVER}) - 1 AS new_frame,
      row_number() OVER (PARTITION BY dataset ORDER BY episode_index, frame_index) - 1 AS index FROM k)"""


def _thinned(fx):
    return fx.frames().filter(F.get("action", F.lit(0)) > 150)


@query("renumber", f"WITH {RENUMBERED} SELECT dataset, new_episode AS episode_index, new_frame AS frame_index, index, event_id FROM d")
def renumber(fx):
    """Frames over a threshold are kept: episodes and frames go missing, the numbering closes the gaps."""
    return W.renumber(_thinned(fx), rows=fx.rows).select(*FRAME, "index", "event_id")


@query(
    "renumber_blocked",
    f"WITH {RENUMBERED} SELECT dataset, new_episode AS episode_index, new_frame AS frame_index, index, event_id FROM d",
)
def renumber_blocked(fx):
    """The plan for long episodes, forced by blocks of 16 frames and 16 episodes."""
    return W.renumber(_thinned(fx), size=16).select(*FRAME, "index", "event_id")


@query(
    "frame_gaps",
    f"""WITH {Q.FRAMES}, k AS (SELECT *, frame_index / 30.0::DOUBLE AS sec FROM fx WHERE a0 > 5),
    s AS (SELECT *, sec - lag(sec) {OVER}) AS step FROM k)
    SELECT {Q.EPISODE}, {sql_r6("step", "step_seconds")} FROM s WHERE abs(step - 1.0::DOUBLE / 30) > 1e-4""",
)
def frame_gaps(fx):
    holes = fx.frames().filter(F.get("action", F.lit(0)) > 5)
    return W.frame_gaps(holes, longest=fx.longest).select(*FRAME, r6("step_seconds").alias("step_seconds"))


def recursion(stages, source=Q.FRAMES, table="fx", keys=("dataset", "episode_index"), pos="frame_index", dim=6) -> str:
    """Recursive SQL: one output column y per element, filtered step by step."""
    k = ", ".join(keys)
    start, step = [], []
    for i in range(dim):
        start += [f"a{i} AS z{n}_{i}" for n, _ in enumerate(stages)]
        value = f"t.a{i}"
        for n, (kind, p) in enumerate(stages):
            last = f"r.z{n}_{i}"
            if kind == "ema":
                value = f"({p}::DOUBLE * {value} + {1.0 - p!r}::DOUBLE * {last})"
            else:
                value = f"({last} + greatest(-{p}::DOUBLE, least({p}::DOUBLE, {value} - {last})))"
            step.append(value)
    on = " AND ".join(f"t.{c} = r.{c}" for c in keys)
    return f"""RECURSIVE {source},
src AS MATERIALIZED (SELECT * FROM {table}),
r AS (
  SELECT {k}, {pos}, {", ".join(start)} FROM src WHERE {pos} = 0
  UNION ALL
  SELECT {", ".join(f"t.{c}" for c in keys)}, t.{pos}, {", ".join(step)}
  FROM r JOIN src t ON {on} AND t.{pos} = r.{pos} + 1)"""


def _smoothed_sql(stages) -> str:
    last = len(stages) - 1
    return f"WITH {recursion(stages)} SELECT {Q.EPISODE}, " + ", ".join(sql_r6(f"z{last}_{i}", f"y{i}") for i in range(6)) + " FROM r"


def _actions(fx):
    """What the filter needs: rows go through Arrow whole."""
    return fx.frames().select(*FRAME, "action")


def _y(df, col):
    return df.select(*FRAME, *spread(col, "y", 6))


@query("ema", _smoothed_sql([("ema", 0.3)]))
def ema(fx):
    return _y(S.ema(_actions(fx), "action", longest=fx.longest), "smoothed")


@query("limit_velocity", _smoothed_sql([("limit", 5.0)]))
def limit_velocity(fx):
    return _y(S.limit_velocity(_actions(fx), "action", longest=fx.longest), "limited")


@query("smooth_custom", _smoothed_sql([("ema", 0.55), ("limit", 7.5)]))
def smooth_custom(fx):
    return _y(S.smooth(_actions(fx), "action", "custom", alpha=0.55, max_delta=7.5, longest=fx.longest), "smoothed")


@query("smooth_light", _smoothed_sql([("ema", 0.7), ("limit", 10.0)]))
def smooth_light(fx):
    return _y(S.smooth(_actions(fx), "action", "light", longest=fx.longest), "smoothed")


@query("smooth_medium", _smoothed_sql([("ema", 0.4), ("limit", 5.0)]))
def smooth_medium(fx):
    return _y(S.smooth(_actions(fx), "action", "medium", longest=fx.longest), "smoothed")


@query("smooth_heavy", _smoothed_sql([("ema", 0.2), ("limit", 3.0)]))
def smooth_heavy(fx):
    return _y(S.smooth(_actions(fx), "action", "heavy", longest=fx.longest), "smoothed")


@query("smooth_blocked", _smoothed_sql([("ema", 0.4), ("limit", 5.0)]))
def smooth_blocked(fx):
    """The plan for long episodes, forced by a block of 16 frames."""
    return _y(S.smooth(_actions(fx), "action", "medium", size=16), "smoothed")


OVERLAPPING = f"""{Q.FRAMES},
ov AS (SELECT dataset AS run, episode_index, chunk, CAST(frame_index - chunk * 8 AS INTEGER) AS step,
       {", ".join(f"a{i} + chunk AS a{i}" for i in range(6))}
       FROM fx, LATERAL (SELECT unnest(range(greatest(frame_index // 8 - 1, 0), frame_index // 8 + 1)) AS chunk) c)"""


@query(
    "execute_chunks",
    f"""WITH {OVERLAPPING}, s AS (SELECT *, chunk * 8 + step AS frame_index FROM ov WHERE step < 12),
    w AS (SELECT *, row_number() OVER (PARTITION BY run, episode_index, frame_index ORDER BY chunk DESC) AS n FROM s)
    SELECT run, episode_index, frame_index, chunk, {Q.ROUNDED_ACTION} FROM w WHERE n = 1""",
)
def execute_chunks(fx):
    """Twelve of sixteen steps of chunks starting every eight frames: four frames overlap."""
    sent = S.execute_chunks(fx.overlapping_predictions(), k=12, stride=8)
    return sent.select("run", "episode_index", POS, "chunk", *spread("action", "a", 6))


@query(
    "smooth_predictions",
    f"WITH {recursion([('ema', 0.4), ('limit', 5.0)], OVERLAPPING + ', oo AS (SELECT *, row_number() OVER (PARTITION BY run, episode_index ORDER BY chunk, step) - 1 AS n FROM ov)', 'oo', ('run', 'episode_index'), 'n')}"
    + ", m AS (SELECT r.*, src.chunk, src.step FROM r JOIN src USING (run, episode_index, n)) SELECT run, episode_index, chunk, step, "
    + ", ".join(sql_r6(f"z1_{i}", f"y{i}") for i in range(6))
    + " FROM m",
)
def smooth_predictions(fx):
    """Overlapping chunks smoothed through all their steps, executed or not."""
    smoothed = S.smooth_predictions(fx.overlapping_predictions(), longest=2 * fx.longest + 32)
    return smoothed.select("run", "episode_index", "chunk", "step", *spread("smoothed", "y", 6))


HEALTH = """
  max(greatest({all})) AS max_abs, max(greatest({arm})) AS arm_max_abs,
  greatest({var}) AS arm_max_variance, max(greatest({chg})) AS max_step_change"""


def _health_sql(cte: str, table: str, keys: str, col: str = "a", scale: str = "") -> str:
    arm = ", ".join(f"abs({col}{i})" for i in range(5))
    lag = ", ".join(f"{col}{i} - lag({col}{i}) OVER w AS g{i}" for i in range(5))
    body = HEALTH.format(
        all=f"{arm}, abs({col}5)",
        arm=arm,
        var=", ".join(f"var_pop({col}{i})" for i in range(5)),
        chg=", ".join(f"abs(g{i})" for i in range(5)),
    )
    return f"""WITH {cte},
    l AS (SELECT *, {lag} FROM {table} WINDOW w AS (PARTITION BY {keys} ORDER BY step)),
    h AS (SELECT {keys}, {body} FROM l GROUP BY {keys})
    SELECT {keys}, {sql_r6("max_abs", "max_abs")}, {sql_r6("arm_max_abs", "arm_max_abs")},
      {sql_r3("arm_max_variance", "arm_max_variance")}, {sql_r6("max_step_change", "max_step_change")},
      max_abs < 0.01 AS near_zero, arm_max_variance < 1e-4 AS static, arm_max_abs > pi() AS out_of_range,
      coalesce(max_step_change < 0.01, false) AS twitching FROM h"""


def _health(report, *keys):
    return report.select(
        *keys,
        r6("max_abs").alias("max_abs"),
        r6("arm_max_abs").alias("arm_max_abs"),
        r3("arm_max_variance").alias("arm_max_variance"),
        r6("max_step_change").alias("max_step_change"),
        "near_zero",
        "static",
        "out_of_range",
        "twitching",
    )


@query("diagnose_chunks", _health_sql(Q.PREDICTIONS, "pr", "run, episode_index, chunk"))
def diagnose_chunks(fx):
    return _health(A.diagnose_chunks(fx.predictions()), *A.CHUNK_KEYS)


_SMOOTHED = recursion([("ema", 0.4), ("limit", 5.0)]) + (
    ", sp AS (SELECT dataset AS run, episode_index, frame_index // 16 AS chunk, CAST(frame_index % 16 AS INTEGER) AS step, "
    + ", ".join(f"z1_{i} AS a{i}" for i in range(6))
    + " FROM r)"
)


@query("smoothed_health", _health_sql(_SMOOTHED, "sp", "run, episode_index, chunk"))
def smoothed_health(fx):
    """Flagship: recorded actions smoothed at preset medium, cut in chunks, and diagnosed."""
    smoothed = S.smooth(_actions(fx), "action", "medium", longest=fx.longest)
    frame = F.col(POS)
    pred = smoothed.select(
        F.col("dataset").alias("run"),
        "episode_index",
        F.floor(frame / 16).cast("long").alias("chunk"),
        (frame % 16).cast("int").alias("step"),
        F.col("smoothed").alias("action"),
    )
    return _health(A.diagnose_chunks(pred), *A.CHUNK_KEYS)


@query(
    "prediction_error",
    f"WITH {recursion([('ema', 0.4)])} SELECT r.episode_index, "
    + sql_r6("sum(" + " + ".join(f"(z0_{i} - a{i}) * (z0_{i} - a{i})" for i in range(6)) + ") / (6 * count(*))", "loss")
    + ", CAST(6 * count(*) AS BIGINT) AS elements FROM r JOIN src USING (dataset, episode_index, frame_index) GROUP BY r.episode_index",
)
def prediction_error(fx):
    """The moving average as prediction, the recorded action as truth."""
    pred = S.ema(_actions(fx), "action", 0.4, longest=fx.longest).drop("action")
    errors = A.prediction_error(pred, fx.frames(), FRAME, "smoothed", by=["episode_index"])
    return errors.select("episode_index", r6("loss").alias("loss"), "elements")


@query(
    "masked_mse",
    f"WITH {Q.WITH_STATE} SELECT episode_index, "
    + sql_r6(
        "sum("
        + " + ".join(f"CASE WHEN a{i} > 0 THEN (a{i} - s{i}) * (a{i} - s{i}) ELSE 0.0::DOUBLE END" for i in range(6))
        + ") / nullif(sum("
        + " + ".join(f"CAST(a{i} > 0 AS INTEGER)" for i in range(6))
        + "), 0)",
        "loss",
    )
    + " FROM fs GROUP BY episode_index",
)
def masked_mse(fx):
    """Elements above zero count, the state stands in for the prediction."""
    masked = fx.frames_with_state().withColumn("mask", V.each("action", 6, lambda x, _: x > 0))
    errors = A.masked_mse(masked, "state", "action", "mask", 6, ["episode_index"])
    return errors.select("episode_index", r6("loss").alias("loss"))


@query(
    "first_steps",
    f"WITH {Q.PREDICTIONS} SELECT run, episode_index, chunk, step, {Q.ROUNDED_ACTION} FROM pr WHERE step < 5",
)
def first_steps(fx):
    first = A.first_steps(fx.predictions(), 5)
    return first.select("run", "episode_index", "chunk", "step", *spread("action", "a", 6))


@query(
    "tracking_error",
    f"WITH {Q.WITH_STATE} SELECT {Q.EPISODE}, "
    + ", ".join(sql_r6(f"a{i} - s{i}", f"e{i}") for i in range(6))
    + ", "
    + sql_r6("greatest(" + ", ".join(f"abs(a{i} - s{i})" for i in range(6)) + ")", "biggest")
    + " FROM fs",
)
def tracking_error(fx):
    errors = A.tracking_error(fx.frames_with_state(), "action", "state")
    return errors.select(*FRAME, *spread("tracking_error", "e", 6), r6("max_tracking_error").alias("biggest"))


@query(
    "asof_tracking",
    """WITH e AS (SELECT user_id % 8 AS robot, epoch_us(ts) AS at_us, event_id, event_type, value FROM events),
    c AS (SELECT robot, at_us, max(value) AS value FROM e WHERE event_type = 'click' GROUP BY robot, at_us),
    a AS (SELECT robot, at_us, event_id, value FROM e WHERE event_type <> 'click')
    SELECT a.robot, a.event_id, a.at_us, a.value, c.value AS commanded FROM a ASOF LEFT JOIN c ON a.robot = c.robot AND a.at_us >= c.at_us""",
)
def asof_tracking(fx):
    """Clicks are commands; the other events look up the newest command of their robot."""
    events = fx.table("events").select(
        (F.col("user_id") % 8).alias("robot"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"),
        "event_id",
        "event_type",
        "value",
    )
    is_command = F.col("event_type") == "click"
    commands = events.filter(is_command).groupBy("robot", "at_us").agg(F.max("value").alias("value"))
    return A.asof_tracking(commands, events.filter(~is_command).drop("event_type"), ["robot"], "at_us", "value")


@query(
    "shuffle_sample",
    f"""WITH {Q.FRAMES} SELECT {Q.EPISODE} FROM fx ORDER BY {sql_draw(11, "sample", "episode_index", "frame_index")}, {Q.EPISODE} LIMIT 2000""",
)
def shuffle_sample(fx):
    """A sample of 2,000 frames without replacement; the limit is the sampling operator."""
    return T.sample_rows(fx.frames().select(*FRAME), 2000, 11, FRAME, md5_draw(11, "episode_index", POS))


@query(
    "shuffled_frames",
    f"""WITH {Q.FRAMES} SELECT {Q.EPISODE}, row_number() OVER (ORDER BY {sql_draw(5, "shuffle", "episode_index", "frame_index")}, {Q.EPISODE}) - 1 AS place FROM fx""",
)
def shuffled_frames(fx):
    """Place of every frame in a seeded shuffle, ranked in equal slices of the draw."""
    from armature.plans.blocks import RANK_ROWS, position

    draw = md5_draw(5, "episode_index", POS)
    drawn = fx.frames().select(*FRAME, draw("shuffle").alias("_draw"))
    slices = max(16, fx.rows // RANK_ROWS)
    return position(drawn, [], ["_draw", *FRAME], F.floor(F.col("_draw") * slices).cast("long"), "place").drop("_draw")


MIXTURE = f"""{Q.TWO_DATASETS},
n AS (SELECT dataset, episode_index, count(*) AS frames FROM ab GROUP BY ALL),
m AS (SELECT dataset, count(*) AS episodes FROM n GROUP BY ALL),
wt AS (SELECT ab.*, 1.0::DOUBLE / (SELECT count(*) FROM m) / episodes / frames AS weight
       FROM ab JOIN n USING (dataset, episode_index) JOIN m USING (dataset))"""


@query("mixture_weights", f"WITH {MIXTURE} SELECT {Q.EPISODE}, round(weight, 12) AS weight FROM wt")
def mixture_weights(fx):
    return T.mixture_weights(fx.two_datasets(), longest=fx.longest).select(*FRAME, F.round("weight", 12).alias("weight"))


@query(
    "mixture_draw",
    f"""WITH {MIXTURE} SELECT {Q.EPISODE} FROM wt
    ORDER BY -ln({sql_draw(3, "mixture", "dataset", "episode_index", "frame_index")}) / weight, {Q.EPISODE} LIMIT 1000""",
)
def mixture_draw(fx):
    """1,000 frames drawn by weight; the limit is the sampling operator."""
    weighted = T.mixture_weights(fx.two_datasets(), longest=fx.longest).select(*FRAME, "weight")
    return T.draw_mixture(weighted, 1000, 3, FRAME, md5_draw(3, *FRAME)).select(*FRAME)

"""Predicates, statistics, integrity checks, reports and merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armature.catalog import base as Q
from armature.catalog.base import query, r3, r6, spread, sql_r3, sql_r6
from armature.fixtures import literal_rows
from armature.functions import vectors as V
from armature.operators import episodes as W
from armature.operators import frames as P
from armature.operators import merge as M
from armature.operators import predicates as O
from armature.operators import quality as A
from armature.plans.blocks import RANK_ROWS, position, rank_buckets
from armature.plans.lookups import settled
from armature.schema import JOINTS, KEYS, POS

FRAME = [*KEYS, POS]


def e(i: int) -> str:
    return f"CAST(embedding[{i}] AS DOUBLE)"


def norm(parts: list[str]) -> str:
    return "sqrt(" + " + ".join(f"({p}) * ({p})" for p in parts) + ")"


NEAR = norm([f"{e(i + 3)} * 0.2::DOUBLE - {e(i)} * 0.2::DOUBLE" for i in (1, 2, 3)])


@query(
    "grasped",
    f"""SELECT 'demo_' || (vec_id % 20) AS demo, vec_id // 20 AS t,
    label % 5 <> 4 AND {NEAR} < 0.05 AND abs({e(10)}) * 4.0::DOUBLE < 0.6 AS grasped FROM embeddings""",
)
def grasped(fx):
    frames, poses = fx.grasp()
    return O.grasped(frames, poses).select("demo", "t", "grasped")


@query(
    "grasp_signal",
    f"""WITH g AS (SELECT 'demo_' || (vec_id % 20) AS demo, vec_id // 20 AS t,
      label % 5 <> 4 AND {NEAR} < 0.05 AND abs({e(10)}) * 4.0::DOUBLE < 0.6 AS grasped FROM embeddings)
    SELECT demo, t, grasped, bool_or(grasped) OVER (PARTITION BY demo ORDER BY t ROWS UNBOUNDED PRECEDING) AS latched FROM g""",
)
def grasp_signal(fx):
    """The instantaneous predicate, then the latched signal an annotation stores."""
    frames, poses = fx.grasp()
    return W.latch(O.grasped(frames, poses), "grasped", keys=["demo"], pos="t").select("demo", "t", "grasped", "latched")


def _layer(j: int) -> tuple[str, str, str]:
    xy = norm([f"{e(4 * j + 11)} * 0.2::DOUBLE", f"{e(4 * j + 12)} * 0.2::DOUBLE"])
    z = f"({0.015 * (j + 1)!r}::DOUBLE + {e(4 * j + 13)} * 0.05::DOUBLE)"
    return f"{xy} < 0.05", z, f"abs({e(4 * j + 14)}) * 0.2::DOUBLE < 0.05"


_LAYERS = [_layer(j) for j in range(4)]


@query(
    "task_done",
    f"""WITH s AS (SELECT CAST(vec_id AS VARCHAR) AS demo, 0::BIGINT AS t,
      {" AND ".join(a for a, _, _ in _LAYERS)} AS aligned,
      {_LAYERS[0][1]} > 0.005 AND {" AND ".join(f"{b[1]} > {a[1]}" for a, b in zip(_LAYERS, _LAYERS[1:]))} AS ordered,
      {" AND ".join(c for _, _, c in _LAYERS)} AS stable FROM embeddings)
    SELECT *, aligned AND ordered AND stable AS done FROM s""",
)
def task_done(fx):
    return O.task_done(fx.stack())


def _demo_frames(fx):
    x = fx._e
    return fx._embedding().select(
        F.concat(F.lit("demo_"), (F.col("vec_id") % 20).cast("string")).alias("demo"),
        F.floor(F.col("vec_id") / 20).cast("long").alias("t"),
        F.array(*[x(i) for i in range(20, 26)]).alias("actions"),
        F.array(*[x(i) for i in range(1, 8)]).alias("ee_frame_state"),
        F.array(*[x(i) for i in range(30, 36)]).alias("joint_pos_target"),
    )


def _demo_rows(fx):
    """Length and verdict per demo: failed where the mean of an element is high, unknown for one."""
    return (
        fx._embedding()
        .groupBy(F.concat(F.lit("demo_"), (F.col("vec_id") % 20).cast("string")).alias("demo"))
        .agg(
            F.count(F.lit(1)).alias("num_samples"),
            F.when(F.min(F.col("vec_id")) != 13, F.max("label") == 9).alias("success"),
        )
    )


DEMO_ROWS = f"""
df AS (SELECT 'demo_' || (vec_id % 20) AS demo, vec_id // 20 AS t,
  [{", ".join(e(i) for i in range(20, 26))}] AS actions, [{", ".join(e(i) for i in range(1, 8))}] AS eef,
  [{", ".join(e(i) for i in range(30, 36))}] AS target FROM embeddings),
dr AS (SELECT 'demo_' || (vec_id % 20) AS demo, count(*) AS num_samples,
  CASE WHEN min(vec_id) <> 13 THEN max(label) = 9 END AS success FROM embeddings GROUP BY vec_id % 20)"""


@query(
    "to_ik",
    f"""WITH {DEMO_ROWS} SELECT demo, t, {", ".join(f"eef[{i + 1}] AS k{i}" for i in range(7))}, actions[6] AS k7
    FROM df SEMI JOIN (SELECT demo FROM dr WHERE coalesce(success, false)) USING (demo)""",
)
def to_ik(fx):
    done = P.convert_actions(_demo_rows(fx), _demo_frames(fx), "ik")
    return done.select("demo", "t", *spread("actions", "k", 8, False))


@query(
    "to_joint",
    f"""WITH {DEMO_ROWS} SELECT demo, t, {", ".join(f"target[{i + 1}] AS k{i}" for i in range(6))}
    FROM df SEMI JOIN (SELECT demo FROM dr WHERE coalesce(success, false)) USING (demo)""",
)
def to_joint(fx):
    done = P.convert_actions(_demo_rows(fx), _demo_frames(fx), "joint")
    return done.select("demo", "t", *spread("actions", "k", 6, False))


@query(
    "check_ik",
    f"""WITH {DEMO_ROWS}, a AS (SELECT *, list_append(eef, CASE WHEN eef[2] > 0.3 THEN actions[6] + 0.01 ELSE actions[6] END) AS converted
      FROM df WHERE abs(eef[1]) <= 0.25),
    j AS (SELECT df.demo, df.t, df.actions[6] AS g0, a.converted[8] AS g1, a.demo IS NOT NULL AS found
      FROM df LEFT JOIN a USING (demo, t)),
    s AS (SELECT demo, count(*) AS steps_in, count(*) FILTER (found) AS steps_out, bool_and(found) AS pose_ok,
      bool_and(coalesce(abs(g0 - g1) <= 1e-8 + 1e-5 * abs(g1), false)) AS gripper_ok FROM j GROUP BY demo)
    SELECT demo, steps_in, steps_out, true AS widths_ok, gripper_ok, pose_ok,
      steps_in = steps_out AND gripper_ok AND pose_ok AS valid FROM s""",
)
def check_ik(fx):
    """A conversion that lost steps and disturbed some grippers."""
    before = _demo_frames(fx)
    eef = lambda i: F.get("ee_frame_state", F.lit(i))
    kept = P.to_ik(before.filter(F.abs(eef(0)) <= 0.25))
    grip = F.get("actions", F.lit(7))
    moved = F.concat(F.slice("actions", 1, 7), F.array(F.when(eef(1) > 0.3, grip + 0.01).otherwise(grip)))
    return A.check_ik(before, kept.withColumn("actions", moved))


@query(
    "check_joint",
    f"""WITH {DEMO_ROWS}, a AS (SELECT demo, t, target,
      CASE WHEN eef[3] > 0.35 THEN list_transform(target, lambda x: x + 0.5) ELSE target END AS out_ FROM df)
    SELECT demo, count(*) AS steps, bool_and(target = out_) AS equal,
      {sql_r6("max(list_max(list_transform(list_zip(target, out_), lambda p: abs(p[1] - p[2]))))", "max_difference")}
    FROM a GROUP BY demo""",
)
def check_joint(fx):
    before = _demo_frames(fx)
    after = P.to_joint(before)
    off = V.each("actions", 6, lambda x, _: x + F.lit(0.5))
    changed = after.withColumn(
        "actions", F.when(F.get("ee_frame_state", F.lit(2)) > 0.35, off).otherwise(F.col("actions"))
    )
    return A.check_joint(before, changed).withColumn("max_difference", r6("max_difference"))


@query(
    "common_demos",
    f"""WITH {Q.TWO_DATASETS} SELECT DISTINCT episode_index FROM ab WHERE dataset = 'A'
    AND episode_index IN (SELECT episode_index FROM ab WHERE dataset = 'B')""",
)
def common_demos(fx):
    both = fx.two_datasets().select(*KEYS).distinct()
    left = both.filter("dataset = 'A'").select("episode_index")
    return A.common_demos(left, both.filter("dataset = 'B'"), ["episode_index"])


@query(
    "episode_summary",
    f"""WITH {Q.FRAMES} SELECT dataset, episode_index, count(*) AS length, count(DISTINCT task_index) AS n_tasks,
    min(task_index) AS first_task FROM fx GROUP BY dataset, episode_index""",
)
def episode_summary(fx):
    summary = A.episode_summary(fx.frames())
    return summary.select(
        *KEYS, "length", F.size("tasks").cast("long").alias("n_tasks"), F.get("tasks", F.lit(0)).alias("first_task")
    )


@query(
    "dataset_info",
    f"""WITH {Q.TWO_DATASETS} SELECT dataset, count(DISTINCT episode_index) AS total_episodes, count(*) AS total_frames,
    count(DISTINCT task_index) AS total_tasks, count(DISTINCT episode_index) * 2 AS total_videos,
    count(DISTINCT episode_index // 10) AS total_chunks FROM ab GROUP BY dataset""",
)
def dataset_info(fx):
    return A.dataset_info(fx.two_datasets(), video_features=2, chunks_size=10)


def _stats_sql(source: str, table: str, features: dict[str, str], std: str, by: str = "") -> str:
    rows = [
        f"""SELECT {by + "," if by else ""} '{f}' AS feature, {i} AS dim, min({c}{i}) AS "min", max({c}{i}) AS "max",
        {sql_r6(f"avg({c}{i})", "mean")}, {sql_r6(f"{std}({c}{i})", "std")}, count({c}{i}) AS "count" FROM {table} {"GROUP BY " + by if by else ""}"""
        for f, c in features.items()
        for i in range(6)
    ]
    return f"WITH {source} " + " UNION ALL ".join(rows)


def _stats(df, *by):
    return df.select(*by, "feature", "dim", "min", "max", r6("mean").alias("mean"), r6("std").alias("std"), "count")


@query("feature_stats", _stats_sql(Q.WITH_STATE, "fs", {"action": "a", "state": "s"}, "stddev_samp"))
def feature_stats(fx):
    return _stats(A.feature_stats(fx.frames_with_state(), {"action": 6, "state": 6}))


@query("feature_stats_by_dataset", _stats_sql(Q.TWO_DATASETS, "ab", {"action": "a"}, "stddev_samp", "dataset"))
def feature_stats_by_dataset(fx):
    return _stats(A.feature_stats(fx.two_datasets(), {"action": 6}, ["dataset"]), "dataset")


@query("chunk_stats", _stats_sql(Q.PREDICTIONS, "pr", {"action": "a"}, "stddev_pop", "run, episode_index, chunk"))
def chunk_stats(fx):
    """Population deviation per predicted chunk."""
    return _stats(A.feature_stats(fx.predictions(), {"action": 6}, A.CHUNK_KEYS, ddof=0), *A.CHUNK_KEYS)


@query(
    "joint_ranges",
    f"WITH {Q.FRAMES} "
    + " UNION ALL ".join(
        f"""SELECT dataset, '{n}' AS joint, min(a{i}) AS "min", max(a{i}) AS "max" FROM fx GROUP BY dataset"""
        for i, n in enumerate(JOINTS)
    ),
)
def joint_ranges(fx):
    return A.joint_ranges(fx.frames(), "action", ["dataset"])


@query(
    "compare_stats",
    f"WITH {Q.WITH_STATE} "
    + " UNION ALL ".join(
        f"""SELECT {i} AS dim, min(s{i}) AS pred_min, max(s{i}) AS pred_max, {sql_r6(f"avg(s{i})", "pred_mean")},
        {sql_r6(f"stddev_pop(s{i})", "pred_std")}, min(a{i}) AS train_min, max(a{i}) AS train_max,
        {sql_r6(f"avg(a{i})", "train_mean")}, {sql_r6(f"stddev_samp(a{i})", "train_std")},
        min(s{i}) < min(a{i}) OR max(s{i}) > max(a{i}) AS outside_training FROM fs"""
        for i in range(6)
    ),
)
def compare_stats(fx):
    frames = fx.frames_with_state()
    pred = A.feature_stats(frames, {"state": 6}, ddof=0)
    both = A.compare_stats(pred, A.feature_stats(frames, {"action": 6}))
    return both.withColumns({c: r6(c) for c in ("pred_mean", "pred_std", "train_mean", "train_std")})


@query(
    "generation_report",
    f"""WITH {Q.DEMOS} SELECT mimic_generated, count(*) AS total, count(*) FILTER (coalesce(success, false)) AS successes,
    {sql_r6("100.0::DOUBLE * count(*) FILTER (coalesce(success, false)) / count(*)", "success_percent")},
    {sql_r6("avg(num_samples)", "mean_length")}, min(num_samples) AS min_length, max(num_samples) AS max_length,
    count(*) FILTER (mimic_generated) AS generated FROM dm GROUP BY mimic_generated""",
)
def generation_report(fx):
    report = A.generation_report(fx.demos(), by=["mimic_generated"])
    return report.withColumns({c: r6(c) for c in ("success_percent", "mean_length")})


@query(
    "verify_counts",
    f"""WITH {Q.DEMOS}, c AS (SELECT dataset, episode_index, count(*) FILTER (a0 >= 1) AS n FROM fx GROUP BY ALL)
    SELECT dataset, episode_index, num_samples, n AS action_rows, num_samples AS task_index_rows, n = num_samples AS complete
    FROM dm JOIN c USING (dataset, episode_index)""",
)
def verify_counts(fx):
    """Actions are missing where their first element is below 1."""
    holes = fx.frames().withColumn("action", F.when(F.get("action", F.lit(0)) >= 1, F.col("action")))
    return A.verify_counts(fx.demos(), holes, ["action", "task_index"], KEYS)


@query(
    "missing_required",
    "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)",
)
def missing_required(fx):
    return A.missing_required(fx.table("documents").select("doc_id"), fx.table("labels"), ["doc_id"])


@query(
    "missing_files",
    """WITH f AS (SELECT p_brand || '/' || p_type AS dataset,
      ['meta/info.json', 'meta/stats.json', 'meta/tasks.json', 'meta/tasks.parquet'][p_size % 4 + 1] AS path FROM part),
    d AS (SELECT DISTINCT dataset FROM f),
    r AS (SELECT dataset, unnest(['meta/info.json', 'meta/stats.json', 'meta/tasks.json or meta/tasks.parquet']) AS missing FROM d)
    SELECT dataset, missing FROM r WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.dataset = r.dataset AND contains(r.missing, f.path))""",
)
def missing_files(fx):
    names = F.array(*[F.lit(p) for p in ("meta/info.json", "meta/stats.json", "meta/tasks.json", "meta/tasks.parquet")])
    files = fx.table("part").select(
        F.concat_ws("/", "p_brand", "p_type").alias("dataset"), F.get(names, F.col("p_size") % 4).alias("path")
    )
    return A.missing_files(files, files.select("dataset").distinct())


@query(
    "missing_fields",
    """WITH f AS (SELECT p_partkey // 6 AS demo, ['actions', 'obs/joint_pos', 'obs/front', 'obs/wrist', 'obs/top'][p_size % 5 + 1] AS field FROM part),
    r AS (SELECT demo, unnest(['actions', 'obs/joint_pos', 'obs/front', 'obs/wrist']) AS missing FROM (SELECT DISTINCT demo FROM f))
    SELECT demo, missing FROM r WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.demo = r.demo AND f.field = r.missing)""",
)
def missing_fields(fx):
    """Demos of six parts each; a part's size names the field it holds."""
    names = F.array(*[F.lit(n) for n in ("actions", "obs/joint_pos", "obs/front", "obs/wrist", "obs/top")])
    fields = fx.table("part").select(
        F.floor(F.col("p_partkey") / 6).alias("demo"), F.get(names, F.col("p_size") % 5).alias("field")
    )
    return A.missing_files(fields, fields.select("demo").distinct(), A.DEMO_FIELDS, "demo", "field")


@query("list_episodes", f"WITH {Q.TWO_DATASETS} SELECT DISTINCT dataset, episode_index FROM ab")
def list_episodes(fx):
    return W.list_episodes(fx.two_datasets())


@query(
    "success_rate",
    f"""SELECT o_orderpriority AS task, o_orderstatus AS scenario, count(*) AS trials,
    count(*) FILTER (o_custkey % 5 <> 0) AS successes, {sql_r6("avg(CAST(o_custkey % 5 <> 0 AS INTEGER))", "success_rate")}
    FROM orders GROUP BY ALL""",
)
def success_rate(fx):
    trials = fx.table("orders").select(
        F.col("o_orderpriority").alias("task"),
        F.col("o_orderstatus").alias("scenario"),
        (F.col("o_custkey") % 5 != 0).alias("success"),
    )
    return A.success_rate(trials, ["task", "scenario"]).withColumn("success_rate", r6("success_rate"))


@query(
    "instruction_effect",
    """WITH p AS (SELECT o_custkey, o_orderpriority, min(o_orderstatus) AS lo, max(o_orderstatus) AS hi FROM orders GROUP BY ALL),
    s AS (SELECT o_custkey, count(*) AS instructions, min(lo) <> max(hi) AS outcomes_differ, bool_and(lo = hi) AS repeatable FROM p GROUP BY ALL)
    SELECT *, outcomes_differ AND repeatable AS instruction_matters FROM s""",
)
def instruction_effect(fx):
    trials = fx.table("orders").select(
        "o_custkey", F.col("o_orderpriority").alias("instruction"), F.col("o_orderstatus").alias("outcome")
    )
    return A.instruction_effect(trials, ["o_custkey"])


_BINS = " UNION ALL ".join(f"SELECT {i} AS dim, a{i} AS x FROM fx" for i in range(6))


@query(
    "histogram",
    f"""WITH {Q.FRAMES}, v AS ({_BINS}), r AS (SELECT dim, min(x) AS lo, max(x) AS hi FROM v GROUP BY dim),
    c AS (SELECT dim, CAST(least(floor((x - lo) / (hi - lo) * 50), 49) AS INTEGER) AS bin, count(*) AS n
          FROM v JOIN r USING (dim) GROUP BY ALL),
    g AS (SELECT dim, lo, hi, CAST(unnest(range(50)) AS INTEGER) AS bin FROM r)
    SELECT dim, bin, {sql_r6("lo + bin * ((hi - lo) / 50)", "low")}, coalesce(n, 0) AS "count" FROM g LEFT JOIN c USING (dim, bin)""",
)
def histogram(fx):
    return A.histogram(fx.frames(), "action").withColumn("low", r6("low"))


@query(
    "latency_report",
    f"""SELECT event_type AS stage, count(value) AS events, {sql_r6("avg(value)", "mean_ms")}, quantile_disc(value, 0.5) AS p50_ms,
    quantile_disc(value, 0.95) AS p95_ms, max(value) AS max_ms, {sql_r6("1000.0::DOUBLE / avg(value)", "hz")}
    FROM events GROUP BY event_type""",
)
def latency_report(fx):
    report = A.latency_report(fx.telemetry())
    return report.withColumns({"mean_ms": r6("mean_ms"), "hz": r6("hz")})


@query(
    "task_overlap",
    """SELECT 'order for ' || o_custkey AS task, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS datasets,
    count(DISTINCT o_orderstatus) AS n_datasets, count(DISTINCT o_orderstatus) = 1 AS is_distinct FROM orders GROUP BY o_custkey""",
)
def task_overlap(fx):
    tasks = fx.table("orders").select(
        F.concat(F.lit("order for "), F.col("o_custkey").cast("string")).alias("task"),
        F.col("o_orderstatus").alias("dataset"),
    )
    return A.task_overlap(tasks).withColumn("datasets", F.array_join("datasets", ","))


@query(
    "video_sizes",
    """SELECT CASE WHEN p_size % 2 = 0 THEN 'scene' ELSE 'wrist' END AS camera, p_brand AS codec, count(*) AS files,
    CAST(sum(CAST(floor(p_retailprice * 100) AS BIGINT)) AS BIGINT) AS bytes FROM part GROUP BY ALL""",
)
def video_sizes(fx):
    files = fx.table("part").select(
        F.when(F.col("p_size") % 2 == 0, "scene").otherwise("wrist").alias("camera"),
        F.col("p_brand").alias("codec"),
        F.floor(F.col("p_retailprice") * 100).alias("length"),
    )
    return A.video_sizes(files)


@query(
    "camera_mapping",
    """WITH w AS (SELECT c_nationkey AS rig, c_mktsegment AS camera,
      CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) - 1 AS INTEGER) AS slot
      FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer)),
    a AS (SELECT s_nationkey AS rig, camera_id,
      CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY camera_id) - 1 AS INTEGER) AS slot
      FROM (SELECT DISTINCT s_nationkey, s_suppkey % 10 AS camera_id FROM supplier))
    SELECT rig, slot, camera, camera_id, CASE WHEN camera_id IS NULL THEN 'missing' WHEN camera_id = slot THEN 'same' ELSE 'mapped' END AS status
    FROM w LEFT JOIN a USING (rig, slot)""",
)
def camera_mapping(fx):
    """Rigs are nations: wanted cameras are the customers' segments, available ids the suppliers'."""
    wanted = fx.table("customer").select(
        F.col("c_nationkey").alias("rig"), F.col("c_mktsegment").alias("camera"), F.col("c_mktsegment").alias("camera_order")
    )
    available = fx.table("supplier").select(
        F.col("s_nationkey").alias("rig"), (F.col("s_suppkey") % 10).alias("camera_id")
    )
    return A.camera_mapping(wanted.distinct(), available.distinct())


METRICS = """
m AS (SELECT o_orderpriority AS run, o_orderkey AS step,
  CASE WHEN o_custkey % 97 = 0 THEN 'nan'::DOUBLE ELSE o_totalprice / 400000.0::DOUBLE END AS loss,
  ((o_orderkey * 7919) % 1000) / 1000.0::DOUBLE AS eval_loss FROM orders)"""


def _metrics(fx):
    key = F.col("o_orderkey")
    return fx.table("orders").select(
        F.col("o_orderpriority").alias("run"),
        key.alias("step"),
        F.when(F.col("o_custkey") % 97 == 0, F.lit(float("nan")))
        .otherwise(F.col("o_totalprice") / F.lit(400000.0))
        .alias("loss"),
        (((key * 7919) % 1000) / F.lit(1000.0)).alias("eval_loss"),
    )


@query(
    "training_alerts",
    f"""WITH {METRICS},
    b AS (SELECT *, min(loss) FILTER (NOT isnan(loss)) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best,
          lag(loss) OVER w AS last_loss, lag(eval_loss) OVER w AS last_eval FROM m WINDOW w AS (PARTITION BY run ORDER BY step)),
    i AS (SELECT *, max(step) FILTER (NOT isnan(loss) AND (best IS NULL OR loss < best))
          OVER (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING) AS best_step FROM b)
    SELECT run, step, coalesce(step - best_step >= 1000, false) AS plateau,
      coalesce(eval_loss > last_eval AND loss < last_loss, false) AS overfit, isnan(loss) AS is_nan,
      NOT isnan(loss) AND loss > 1.0 AS too_high FROM i""",
)
def training_alerts(fx):
    return A.training_alerts(_metrics(fx)).drop("loss", "eval_loss")


@query(
    "best_checkpoint",
    """SELECT o_orderpriority AS run, arg_min(o_orderkey, o_totalprice) AS by_loss,
    min(o_orderkey) FILTER (o_custkey % 101 = top) AS by_success
    FROM (SELECT *, max(o_custkey % 101) OVER (PARTITION BY o_orderpriority) AS top FROM orders) GROUP BY run""",
)
def best_checkpoint(fx):
    evals = fx.table("orders").select(
        F.col("o_orderpriority").alias("run"),
        F.col("o_orderkey").alias("checkpoint"),
        F.col("o_totalprice").alias("eval_loss"),
        ((F.col("o_custkey") % 101) / F.lit(100.0)).alias("success_rate"),
    )
    return A.best_checkpoint(evals)


CUTS = f"""{Q.FRAMES},
l AS (SELECT dataset, episode_index, count(*) AS length FROM fx GROUP BY ALL),
c AS (SELECT *, 'observation.images.scene' AS camera, episode_index * 10.0::DOUBLE AS from_ts, episode_index * 10.0::DOUBLE + length / 30.0::DOUBLE AS to_ts FROM l
      UNION ALL
      SELECT *, 'observation.images.wrist', 0.0::DOUBLE, (length - 10) / 30.0::DOUBLE FROM l WHERE episode_index % 2 = 0)"""


def _episodes(fx):
    """The wrist camera has no times in odd episodes and stops ten frames early in even ones."""
    lengths = fx.frames().groupBy(*KEYS).agg(F.count(F.lit(1)).alias("length"))
    ep, length = F.col("episode_index"), F.col("length")
    scene = F.struct(
        (ep * F.lit(10.0)).alias("from_ts"), (ep * F.lit(10.0) + length / F.lit(30.0)).alias("to_ts")
    )
    even = ep % 2 == 0
    wrist = F.struct(
        F.when(even, F.lit(0.0)).alias("from_ts"), F.when(even, (length - 10) / F.lit(30.0)).alias("to_ts")
    )
    return lengths.withColumn(
        "video_segments",
        F.create_map(F.lit("observation.images.scene"), scene, F.lit("observation.images.wrist"), wrist),
    )


@query(
    "video_cut_manifest",
    f"""WITH {CUTS} SELECT dataset, episode_index, camera, {sql_r6("from_ts", "from_ts")}, {sql_r6("to_ts", "to_ts")},
    {sql_r6("to_ts - from_ts", "duration")}, 'videos/' || camera || printf('/chunk-000/episode_%06d.mp4', episode_index) AS target FROM c""",
)
def video_cut_manifest(fx):
    cuts = W.cut_manifest(_episodes(fx)).drop("_last")
    return cuts.withColumns({c: r6(c) for c in ("from_ts", "to_ts", "duration")})


@query(
    "video_cuts",
    f"""WITH {CUTS} SELECT dataset, episode_index, frame_index, camera, {sql_r6("from_ts + frame_index / 30.0::DOUBLE", "video_ts")}
    FROM fx JOIN c USING (dataset, episode_index) WHERE from_ts + (frame_index + 0.5) / 30.0::DOUBLE < to_ts""",
)
def video_cuts(fx):
    """Frames are asked for at their middle, so that no time lies on a segment's end."""
    middle = fx.frames().withColumn("timestamp", F.col("timestamp") + F.lit(0.5) / F.lit(30.0))
    placed = W.video_cuts(middle, _episodes(fx), longest=fx.longest)
    at = F.col("from_ts") + F.col(POS) / F.lit(30.0)
    return placed.select(*FRAME, "camera", r6(at).alias("video_ts"))


TASKS_A = ((0, "Pick up the bread"), (1, "Pick up the cheese"), (2, "Pick up the patty"))
TASKS_B = ((0, "Pick up the patty"), (1, "Wipe the plate"), (2, "Pick up the bread"))


def _parts(fx):
    both = fx.two_datasets().drop("ts", "timestamp")
    frames = [both.filter(F.col("dataset") == d) for d in ("A", "B")]
    tasks = [literal_rows(fx.spark, ("task_index", "task"), t).withColumn("task_index", F.col("task_index").cast("long")) for t in (TASKS_A, TASKS_B)]
    return frames, tasks


@query(
    "merge_datasets",
    f"""WITH {Q.TWO_DATASETS}, n AS (SELECT max(episode_index) + 1 AS added FROM ab WHERE dataset = 'A')
    SELECT 'merged' AS dataset, episode_index + CASE WHEN dataset = 'B' THEN added ELSE 0 END AS episode_index, frame_index,
      CASE WHEN dataset = 'A' THEN task_index ELSE [2, 3, 0][task_index + 1] END AS task_index, event_id FROM ab, n""",
)
def merge_datasets(fx):
    """Two datasets with partly the same task texts under other numbers."""
    frames, tasks = _parts(fx)
    merged = M.merge_frames(frames, M.merged_tasks(tasks, rows=6))
    return merged.select(*FRAME, "task_index", "event_id")


MANY = 20
_MANY = f"""{Q.FRAMES},
md AS (SELECT *, episode_index % {MANY} AS d, episode_index // {MANY} AS e FROM fx),
mo AS (SELECT d, sum(n) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS added FROM (SELECT d, max(e) + 1 AS n FROM md GROUP BY d)),
mg AS (SELECT CAST(e + coalesce(added, 0) AS BIGINT) AS episode_index, frame_index, row_number() OVER (ORDER BY d, e, frame_index) - 1 AS "index", d, task_index, event_id
  FROM md JOIN mo USING (d))"""


def _many(fx) -> list[DataFrame]:
    """Twenty datasets, episodes from 0 and `index` in each, task numbers that differ between them."""
    user = F.col("episode_index")
    moved = fx.frames().drop("ts", "timestamp", "action").withColumns({"_d": (user % MANY).cast("int"), "episode_index": F.floor(user / MANY).cast("long")})
    bucket = rank_buckets(moved, F.col("episode_index")) if fx.rows > RANK_ROWS else None
    moved = position(moved, ["_d"], ["episode_index", POS], bucket, "index").withColumn("task_index", (F.col("task_index") + F.col("_d")) % 3)
    moved = settled(moved, "twenty-datasets")
    return [moved.filter(F.col("_d") == d).drop("_d") for d in range(MANY)]


def _many_tasks(fx) -> DataFrame:
    """Text k of dataset d is number (k + d) % 3."""
    rows = [literal_rows(fx.spark, ("task_index", "task"), tuple(((k + d) % 3, t) for k, (_, t) in enumerate(TASKS_A))).withColumn("task_index", F.col("task_index").cast("long")) for d in range(MANY)]
    return M.merged_tasks(rows, rows=3 * MANY)


@query("merge_many", f"""WITH {_MANY} SELECT 'merged' AS dataset, episode_index, frame_index, "index", task_index, event_id FROM mg""")
def merge_many(fx):
    """Twenty datasets: numbers of episodes and rows go on, tasks are joined by text."""
    return M.merge_frames(_many(fx), _many_tasks(fx)).select(*FRAME, "index", "task_index", "event_id")


@query("merge_many_episodes", f"""WITH {_MANY} SELECT 'merged' AS dataset, episode_index, count(*) AS length FROM mg GROUP BY episode_index""")
def merge_many_episodes(fx):
    """Their episode tables, numbered as the frames are."""
    parts = _many(fx)
    return M.merge_episodes([A.episode_summary(p).drop("tasks") for p in parts], parts)


@query(
    "merge_many_info",
    f"""WITH {_MANY} SELECT 'merged' AS dataset, count(DISTINCT episode_index) AS total_episodes, count(*) AS total_frames, count(DISTINCT task_index) AS total_tasks,
    2 * count(DISTINCT episode_index) AS total_videos, count(DISTINCT episode_index // 10) AS total_chunks FROM mg""",
)
def merge_many_info(fx):
    """Totals of the merged dataset."""
    return A.dataset_info(M.merge_frames(_many(fx), _many_tasks(fx)), video_features=2, chunks_size=10)


@query(
    "dataset_mixture_info",
    f"""WITH {Q.TWO_DATASETS}, n AS (SELECT dataset, episode_index, count(*) AS length FROM ab GROUP BY ALL)
    SELECT dataset, {sql_r3("avg(length)", "mean_length")}, {sql_r3("1.0::DOUBLE / 2 / count(*)", "episode_probability")} FROM n GROUP BY dataset""",
)
def dataset_mixture_info(fx):
    """Probability of each episode when datasets and trajectories are balanced."""
    from armature.operators.sampling import mixture_weights

    weighted = mixture_weights(fx.two_datasets())
    per_episode = weighted.groupBy(*KEYS).agg(F.sum("weight").alias("p"), F.count(F.lit(1)).alias("length"))
    return per_episode.groupBy("dataset").agg(
        r3(F.avg("length")).alias("mean_length"), r3(F.avg("p")).alias("episode_probability")
    )

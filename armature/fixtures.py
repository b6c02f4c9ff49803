"""Canonical tables derived from the given test tables, for queries, tests and benches.

The derivations use integer arithmetic and existing doubles only, so the same text in SQL
gives the same bits. `Fixtures` counts rows once per table to choose between the plain
and the blocked plan.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from armature.functions import vectors as V
from armature.plans import blocks as B
from armature.schema import EXECUTED, FPS, HORIZON, KEYS, POS, STACK

TASK_TEXTS = (
    (0, "Pick up the bread slice and place it on the plate"),
    (1, "Pick up the cheese slice and place it on the bread"),
    (2, "Pick up the patty and place it on the cheese"),
)


def literal_rows(spark: SparkSession, names: tuple[str, ...], rows: tuple[tuple, ...]) -> DataFrame:
    """A few constant rows as a local relation, without Python tasks."""
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


class Fixtures:
    """Tables below one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def longest(self) -> int:
        """Upper bound on the frames of one episode of `frames`."""
        return B.longest_group(self.table("events").select("user_id"), ["user_id"])

    @cached_property
    def rows(self) -> int:
        return self.table("events").count()

    def time_buckets(self) -> Column | None:
        """Slices of event time with about a million rows; None if one holds them all."""
        events = self.table("events")
        return B.rank_buckets(events, F.unix_micros(F.col("ts").cast("timestamp")))

    def frames(self) -> DataFrame:
        """One episode per user of `events`, frames in time order, single dataset."""
        events = self.table("events").select("event_id", "ts", "user_id", "value")
        bucket = self.time_buckets() if self.longest > B.RANK_ROWS else None
        ordered = B.position(events, ["user_id"], ["ts", "event_id"], bucket, POS)
        e = F.col("event_id")
        arm = [((e * (7 * j + 3)) % 2001) / F.lit(10.0) - F.lit(100.0) for j in range(1, 5)]
        grip = ((e * 31) % 1001) / F.lit(10.0)
        return ordered.select(
            F.lit("events").alias("dataset"),
            F.col("user_id").alias("episode_index"),
            POS,
            (F.col(POS) / F.lit(float(FPS))).alias("timestamp"),
            (F.col("user_id") % 3).alias("task_index"),
            F.array(F.col("value"), *arm, grip).alias("action"),
            "event_id",
            "ts",
        )

    def frames_with_state(self) -> DataFrame:
        """State is the action one frame earlier; the first frame keeps its own."""
        return B.over_neighbours(
            self.frames(),
            KEYS,
            POS,
            lambda w: {"state": F.coalesce(F.lag("action", 1).over(w), F.col("action"))},
            before=1,
            longest=self.longest,
        )

    def tasks(self) -> DataFrame:
        rows = literal_rows(self.spark, ("task_index", "task"), TASK_TEXTS)
        return rows.select(F.lit("events").alias("dataset"), F.col("task_index").cast("long"), "task")

    def two_datasets(self) -> DataFrame:
        """Even users are dataset A, odd ones B; episodes numbered from 0 in each."""
        user = F.col("episode_index")
        return self.frames().withColumns(
            {"dataset": F.when(user % 2 == 0, "A").otherwise("B"), "episode_index": F.floor(user / 2).cast("long")}
        )

    def predictions(self) -> DataFrame:
        """Frames cut in steps of 16: chunk, step and the recorded action."""
        frame = F.col(POS)
        return self.frames().select(
            F.col("dataset").alias("run"),
            "episode_index",
            F.floor(frame / HORIZON).cast("long").alias("chunk"),
            (frame % HORIZON).cast("int").alias("step"),
            "action",
        )

    def overlapping_predictions(self) -> DataFrame:
        """Every eighth frame starts a chunk of 16, so neighbouring chunks overlap by 8.

        The chunk adds its own number to the recorded action, to tell the chunks apart.
        """
        frame, chunk = F.col(POS), F.col("chunk")
        newest = F.floor(frame / EXECUTED).cast("long")
        held = self.frames().withColumn("chunk", F.explode(F.sequence(F.greatest(newest - 1, F.lit(0).cast("long")), newest)))
        return held.select(
            F.col("dataset").alias("run"),
            "episode_index",
            "chunk",
            (frame - chunk * EXECUTED).cast("int").alias("step"),
            V.each("action", 6, lambda x, _: x + chunk).alias("action"),
        )

    def _embedding(self) -> DataFrame:
        return self.table("embeddings").withColumn("e", F.col("embedding").cast("array<double>"))

    @staticmethod
    def _e(i: int) -> Column:
        """Element by 1-based position, as in the SQL."""
        return F.get(F.col("e"), F.lit(i - 1))

    def grasp(self) -> tuple[DataFrame, DataFrame]:
        """(demo_frames, object_poses): one object near the effector in some frames."""
        e = self._e
        base = self._embedding().select(
            F.concat(F.lit("demo_"), (F.col("vec_id") % 20).cast("string")).alias("demo"),
            F.floor(F.col("vec_id") / 20).cast("long").alias("t"),
            "label",
            "e",
        )
        frames = base.select(
            "demo",
            "t",
            F.array(*[e(i) * F.lit(0.2) for i in (1, 2, 3)]).alias("eef_pos"),
            (F.abs(e(10)) * F.lit(4.0)).alias("gripper"),
        )
        poses = base.select(
            "demo",
            "t",
            F.get(F.array(*[F.lit(o) for o in (*STACK, "plate")]), F.col("label") % 5).alias("object"),
            F.array(*[e(i) * F.lit(0.2) for i in (4, 5, 6)]).alias("pos"),
        )
        return frames, poses

    def stack(self) -> DataFrame:
        """One scene per vector: a plate at the origin and four layers."""
        e = self._e
        plate = F.struct(
            F.lit("plate").alias("object"),
            F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("pos"),
            F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("lin_vel"),
        )
        layers = [
            F.struct(
                F.lit(name).alias("object"),
                F.array(
                    e(4 * j + 11) * F.lit(0.2),
                    e(4 * j + 12) * F.lit(0.2),
                    F.lit(0.015 * (j + 1)) + e(4 * j + 13) * F.lit(0.05),
                ).alias("pos"),
                F.array(F.abs(e(4 * j + 14)) * F.lit(0.2), F.lit(0.0), F.lit(0.0)).alias("lin_vel"),
            )
            for j, name in enumerate(STACK)
        ]
        return self._embedding().select(
            F.col("vec_id").cast("string").alias("demo"),
            F.lit(0).cast("long").alias("t"),
            F.inline(F.array(plate, *layers)),
        )

    def poses(self) -> DataFrame:
        """Effector, object and plate poses (x, y, z, w, x, y, z) with unit quaternions."""
        e = self._e

        def quat(first: int) -> Column:
            q = [e(i) for i in range(first, first + 4)]
            length = V.norm(q)
            return F.array(*[c / length for c in q])

        return self._embedding().select(
            "vec_id",
            "label",
            (F.col("vec_id") % 20).alias("demo_number"),
            F.floor(F.col("vec_id") / 20).cast("long").alias("t"),
            F.concat(F.array(e(1), e(2), e(3)), quat(7)).alias("eef_pose"),
            F.concat(F.array(e(4), e(5), e(6)), quat(13)).alias("object_pose"),
            F.concat(F.array(e(20), e(21), e(22)), quat(23)).alias("plate_pose"),
            (F.abs(e(17)) * F.lit(4.0)).alias("gripper"),
        )

    def demos(self) -> DataFrame:
        """Attributes per episode; success is missing for every seventh episode."""
        user = F.col("episode_index")
        lengths = self.frames().groupBy(*KEYS).agg(F.count(F.lit(1)).alias("num_samples"))
        return lengths.select(
            "dataset",
            "episode_index",
            F.concat(F.lit("demo_"), user.cast("string")).alias("demo"),
            "num_samples",
            F.when(user % 7 != 0, user % 4 != 0).alias("success"),
            (user % 2 == 0).alias("mimic_generated"),
            F.array((user % 5).cast("int"), (user % 3).cast("int")).alias("src_demo_inds"),
        )

    def telemetry(self) -> DataFrame:
        return self.table("events").select(
            (F.col("user_id") % 8).cast("string").alias("robot"),
            "ts",
            F.col("event_type").alias("stage"),
            F.col("value").alias("latency_ms"),
            "event_id",
        )

    def units(self) -> DataFrame:
        """Short episodes from order lines: 60,000 rows per 0.01 of scale."""
        lines = self.table("lineitem")
        order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
        bucket = None
        if B.longest_group(lines.select("l_orderkey"), ["l_orderkey"]) > B.RANK_ROWS:
            bucket = F.col("l_linenumber").cast("long")
        ordered = B.position(lines, ["l_orderkey"], order, bucket, POS)
        return ordered.select(
            F.lit("lines").alias("dataset"),
            F.col("l_orderkey").alias("episode_index"),
            POS,
            F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("action"),
        )

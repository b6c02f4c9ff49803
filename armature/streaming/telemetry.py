"""Live telemetry with Structured Streaming. Definitions are shared with the batch operators.

Keyed state is sequential per robot, so a micro-batch is kept bounded at the source
(bytes or files per trigger). What crosses micro-batches is a few numbers per robot and the rows the
watermark has not passed yet, so results don't depend on how rows are cut into micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from armature.operators.smoothing import advance
from armature.plans.blocks import Fold, running
from armature.schema import JOINT_SCHEMES, SMOOTHING_ALPHA, SMOOTHING_MAX_DELTA

LATE = "10 seconds"


def read_telemetry(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    late: str = LATE,
    files_per_trigger: int | None = None,
    bytes_per_trigger: int = 256 << 20,
    event_time: str = "ts",
    glob: str | None = None,
) -> DataFrame:
    """Telemetry files as a stream, bounded bytes (or files) per micro-batch; rows later than `late` drop."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger is None:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    else:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path).withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, late)


def loop_rate(telemetry: DataFrame, by: Sequence[str] = ("robot",), width: str = "1 second") -> DataFrame:
    """Events per tumbling window with mean and exact median latency; works on streams and tables.

    The median keeps counts by value, at most as many as one robot sends in a window.
    """
    return (
        telemetry.groupBy(F.window("ts", width), *by)
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.avg("latency_ms").alias("mean_ms"),
            F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY latency_ms)").alias("p50_ms"),
        )
        .select(F.col("window.start").alias("window_start"), *by, "events", "mean_ms", "p50_ms")
    )


#: Rows of a run, which is sorted at once; of a page of it in the state; and runs of a key that are merged at once.
RUN, PAGE, FAN = 65_536, 4096, 256
_NEVER = np.iinfo(np.int64).max
_ARROW = {"long": pa.int64(), "string": pa.string(), "array<double>": pa.list_(pa.float64())}


class InOrder(StatefulProcessor):
    """Gives a key's rows to `take` in event-time order, whatever micro-batches they came in.

    Rows wait in state until the watermark has passed them: rows that may still come before
    them are later than the watermark and were dropped. They wait as sorted runs in pages, which are merged
    when they are due, so a task holds a run or a page of each run, however many rows a key has.
    `take` gets them in pieces of about a run. `row` is the schema of a row: order_ts in
    microseconds, order_id, then what `take` needs; `kept` that of the value state `past` that `take` keeps.
    Rows that still wait when a finite stream has ended are taken by `tail`; a row without a time waits until then and comes last.
    """

    row = ""
    kept = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "run long, page long", "rows binary")
        self.listed = handle.getValueState("listed", "pages binary")
        self.past = handle.getValueState("past", self.kept)

    def take(self, key, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from self._release(key, rows, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._release(key, iter(()), timerValues)

    def _release(self, key, new: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        # Run, page and first time of each page that waits.
        pages = np.frombuffer(bytes(self.listed.get()[0]), "<i8").reshape(-1, 3).tolist() if self.listed.exists() else []
        for some in _gathered((_arrow(f, self.row) for f in new), RUN):
            pages += self._kept([_in_order(some)], 1 + max((p[0] for p in pages), default=0), 1 + max((p[1] for p in pages), default=0))
            numbers = sorted({p[0] for p in pages})
            if len(numbers) > FAN:
                old = [p for p in pages if p[0] < numbers[FAN]]
                rest = pages[len(old) :]
                pages = self._kept(self._merged(old, _NEVER, old), numbers[0], 1 + pages[-1][1]) + rest
                # Pages stay in the order of their runs.
                pages.sort()
        until = timers.getCurrentWatermarkInMs() * 1000
        due = [p for p in pages if p[2] < until]
        later = [p for p in pages if p[2] >= until]
        for some in _gathered(self._merged(due, until, later), RUN):
            yield from self.take(key, some.to_pandas())
        if later:
            self.listed.update((np.array(sorted(later), "<i8").tobytes(),))
            first = min(p[2] for p in later)
            if first < _NEVER:
                self.handle.registerTimer(first // 1000)
        elif pages:
            self.listed.clear()

    def _kept(self, tables: Iterable[pa.Table], run: int, page: int) -> list[list[int]]:
        """Pages of a run, given in order, written to the state."""
        out = []
        for table in _gathered(tables, PAGE):
            for at in range(0, len(table), PAGE):
                part = table.slice(at, PAGE)
                self.waiting.updateValue((run, page), (_packed(part),))
                out.append([run, page, int(_numbers(part, "order_ts")[0])])
                page += 1
        return out

    def _merged(self, pages: list[list[int]], until: int, later: list[list[int]]) -> Iterator[pa.Table]:
        """Rows of pages before a time, in order, and equal ones in the order of their runs; the pages leave the state.

        Rows from that time on go back to a page of their run, which is added to `later`.
        """
        if pages is later:
            later = []
        left: dict[int, list[list[int]]] = {}
        for p in sorted(pages):
            left.setdefault(p[0], []).append(p)
        heads: dict[int, tuple[pa.Table, np.ndarray, np.ndarray]] = {}
        at: dict[int, list[int]] = {}

        def load(run: int) -> None:
            at[run] = left[run].pop(0)
            table = _unpacked(bytes(self.waiting.getValue((run, at[run][1]))[0]))
            self.waiting.removeKey((run, at[run][1]))
            if run in heads:
                table = pa.concat_tables([heads[run][0], table])
            heads[run] = table, _numbers(table, "order_ts"), _numbers(table, "order_id")

        for run in list(left):
            load(run)
        while heads:
            # All rows before the last one of a run that goes on are loaded.
            going = [(int(h[1][-1]), int(h[2][-1]), run) for run, h in heads.items() if left[run]]
            ts, number, run = min(going, default=(until, -_NEVER, None))
            parts = []
            for name, (table, times, ids) in list(heads.items()):
                low, high = np.searchsorted(times, ts, "left"), np.searchsorted(times, ts, "right")
                n = len(table) if run is None and until == _NEVER else min(int(low + np.searchsorted(ids[low:high], number)), int(np.searchsorted(times, until)) if until < _NEVER else len(table))
                if n:
                    parts.append(table.slice(0, n))
                    heads[name] = table.slice(n), times[n:], ids[n:]
            if parts:
                yield _in_order(pa.concat_tables(parts))
            if run is None:
                break
            load(run)
        for run, (table, _, _) in heads.items():
            if len(table):
                # The page that was loaded last, and a few equal rows before it at most.
                self.waiting.updateValue((run, at[run][1]), (_packed(table),))
                later.append([run, at[run][1], int(_numbers(table, "order_ts")[0])])

    def close(self) -> None:
        pass


def _fields(row: str) -> list[tuple[str, str]]:
    return [tuple(c.split(" ", 1)) for c in row.split(", ")]


def _arrow(frame: pd.DataFrame, row: str) -> pa.Table:
    return pa.Table.from_pandas(frame, pa.schema([(name, _ARROW[kind]) for name, kind in _fields(row)]), preserve_index=False)


def _gathered(tables: Iterable[pa.Table], rows: int) -> Iterator[pa.Table]:
    """Neighbours of a sequence of tables together, until there are that many rows."""
    some, n = [], 0
    for table in tables:
        some.append(table)
        n += len(table)
        if n >= rows:
            yield pa.concat_tables(some)
            some, n = [], 0
    if n:
        yield pa.concat_tables(some)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    """A column of integers; null is the largest."""
    return table[name].fill_null(_NEVER).to_numpy()


def _in_order(table: pa.Table) -> pa.Table:
    return table.take(pa.array(np.lexsort((_numbers(table, "order_id"), _numbers(table, "order_ts"))))).combine_chunks()


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


class _Held:
    """A value state outside a stream."""

    def __init__(self, value: tuple | None):
        self.value = value

    def exists(self) -> bool:
        return self.value is not None

    def get(self) -> tuple:
        return self.value

    def update(self, value: tuple) -> None:
        self.value = value


def state_of(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """Rows of a state variable as a stopped stream has left them: `_key` and the fields of the state."""
    use_rocksdb(spark)
    rows = spark.read.format("statestore").option("stateVarName", variable).load(checkpoint)
    values = ["user_map_key.*", "user_map_value.*"] if "user_map_key" in rows.columns else ["value.*"]
    return rows.select(F.col("key").getField(rows.schema["key"].dataType.fieldNames()[0]).alias("_key"), *values)


def tail(spark: SparkSession, checkpoint: str, processor: InOrder, schema: str) -> DataFrame:
    """What `processor` gives for the rows that still wait in a stream that has ended, with the state it had then.

    A finite input is whole with these rows. A stream that goes on from the checkpoint gives them itself,
    once its watermark has passed them. Spark sorts them, and a task holds a batch of them.
    """
    fields = [name for name, _ in _fields(processor.row)]
    kept = [name for name, _ in _fields(processor.kept)]
    pages, past = state_of(spark, checkpoint, "waiting"), state_of(spark, checkpoint, "past")
    types = T.StructType([T.StructField(name, T._parse_datatype_string(kind)) for name, kind in _fields(processor.row)])
    placed = T.StructType([*pages.schema.fields[:2], T.StructField("page", T.LongType()), T.StructField("at", T.LongType()), *types.fields])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column(3)):
                table = _unpacked(data.as_buffer())
                n = len(table)
                before = [pa.concat_arrays([batch.column(c).slice(i, 1)] * n) for c in range(3)]
                whole = pa.Table.from_arrays([*before, pa.array(np.arange(n)), *table.columns], names=placed.names)
                yield from whole.combine_chunks().to_batches()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        now = [None]
        for batch in batches:
            table = pa.Table.from_batches([batch])
            names = table["_key"].to_pylist()
            edges = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]] + [len(names)]
            for a, b in zip(edges, edges[1:], strict=False):
                part = table.slice(a, b - a)
                if [names[a]] != now or processor.past is None:
                    now, processor.past = [names[a]], _Held(None)
                if part["_past"][0].as_py() is not None:
                    processor.past = _Held(tuple(part["_past"][0].as_py()[c] for c in kept))
                    part = part.slice(1)
                if len(part):
                    yield from processor.take((names[a],), part.select(fields).to_pandas())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor.past = None
        for found in finish(batches):
            yield from pa.Table.from_pandas(found, result, preserve_index=False).combine_chunks().to_batches()

    result = to_arrow_schema(T._parse_datatype_string(schema))
    # Python right on a scan of a state store waits for ever.
    rows = pages.repartition("_key", "run", "page").mapInArrow(unpack, placed)
    known = past.select("_key", F.struct(*kept).alias("_past")).join(rows.select("_key").distinct().withColumnRenamed("_key", "_waits"), F.col("_key").eqNullSafe(F.col("_waits")), "left_semi")
    both = rows.unionByName(known, allowMissingColumns=True).repartition("_key")
    # What a key keeps comes before its rows.
    order = ["_key", F.col("_past").isNull(), F.col("order_ts").asc_nulls_last(), F.col("order_id").asc_nulls_last(), "run", "page", "at"]
    return both.sortWithinPartitions(*order).mapInArrow(run, schema)


class OnlineSmoother(InOrder):
    """Moving average, then limiter, per robot; one state row of two vectors beside the rows that wait."""

    row = "order_ts long, order_id long, joints array<double>"
    kept = "ema array<double>, limited array<double>"

    def __init__(self, alpha: float = SMOOTHING_ALPHA, max_delta: float = SMOOTHING_MAX_DELTA):
        self.alpha, self.max_delta = alpha, max_delta

    def take(self, key, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        known = self.past.exists()
        x = np.array([list(j) for j in rows["joints"]], dtype=float)
        states = [np.array([v], dtype=float) for v in self.past.get()] if known else [np.zeros((1, x.shape[1])) for _ in "ab"]
        stages = [("ema", self.alpha), ("limit", self.max_delta)]
        smoothed = advance(x, np.array([0]), np.array([len(x)]), np.array([known]), states, stages)
        self.past.update(tuple(s[0].tolist() for s in states))
        yield pd.DataFrame({"robot": key[0], "order_id": rows["order_id"].to_numpy(np.int64), "smoothed": smoothed.tolist()})


SMOOTHED = "robot string, order_id long, smoothed array<double>"


def smooth_stream(
    telemetry: DataFrame, order_id: str, alpha: float = SMOOTHING_ALPHA, max_delta: float = SMOOTHING_MAX_DELTA
) -> DataFrame:
    """Smoothed joints per robot, state kept between micro-batches. Needs the RocksDB state store."""
    ordered = telemetry.select(
        "robot", "ts", F.unix_micros("ts").alias("order_ts"), F.col(order_id).alias("order_id"), "joints"
    )
    return ordered.groupBy("robot").transformWithStateInPandas(
        OnlineSmoother(alpha, max_delta), SMOOTHED, outputMode="append", timeMode="EventTime"
    )


# Keys of the recorder.
START, SUCCESS, FAIL, QUIT, RERECORD = "B", "N", "R", "quit", "left"
NEXT, STOP = "right", "esc"
CONTROLS = [START, SUCCESS, FAIL, QUIT, RERECORD, NEXT, STOP]
#: Keys that finish an episode with a verdict.
FINISHED = {SUCCESS: "success", NEXT: "success", FAIL: "fail"}


def label_episodes(
    events: DataFrame,
    key: str = "key",
    robot: Sequence[str] = ("robot",),
    pos: str = "position",
    size: int = 65_536,
    longest: int | None = None,
) -> DataFrame:
    """Rows with the recording state machine's phase: recording flag, episode number, verdict so far.

    B starts an episode when idle; N or the next key ends it with success, R with failure, quit and stop leave it
    unfinished. Re-record discards the running episode; when idle right after one was finished, that one.
    Other rows outside are ignored (episode is null). `key` is null for frames. The phase after a row depends on the last key only, and
    episode numbers are running counts of starts made while idle, so both are carried over
    blocks instead of walking a robot's whole history in one task.
    """
    control = F.when(F.col(key).isin(CONTROLS), F.col(key))
    before = running(events, robot, pos, {"_last": Fold("last", control, False)}, size, longest, keep=True)
    was_on = F.coalesce(F.col("_last") == START, F.lit(False))
    starts = F.coalesce((F.col(key) == START) & ~was_on, F.lit(False))
    marked = before.withColumns({"_on_before": was_on, "_starts": starts.cast("long")})
    counted = running(marked, robot, pos, {"_episode": Fold("sum", F.col("_starts"))}, size, longest)
    ends = F.col("_on_before") & F.coalesce(F.col(key).isin(CONTROLS[1:]), F.lit(False))
    takes_back = F.coalesce((F.col(key) == RERECORD) & F.col("_last").isin(list(FINISHED)) & (F.col("_episode") > 0), F.lit(False))
    inside = (F.col("_on_before") | (F.col("_starts") == 1)) & F.coalesce(F.col(key).isNull(), F.lit(False))
    return counted.withColumns(
        {
            "episode": F.when(F.col("_on_before") | (F.col("_starts") == 1) | takes_back, F.col("_episode") - 1),
            "is_frame": inside,
            "verdict": F.when(ends & F.col(key).isin(SUCCESS, NEXT), "success")
            .when(ends & (F.col(key) == FAIL), "fail")
            .when((ends & (F.col(key) == RERECORD)) | takes_back, "discarded")
            .when(ends & F.col(key).isin(QUIT, STOP), "unfinished"),
        }
    ).drop("_last", "_on_before", "_starts", "_episode")


def recorded_episodes(labelled: DataFrame, robot: Sequence[str] = ("robot",), pos: str = "position") -> DataFrame:
    """Finished episodes with frames and verdict; discarded ones are left out."""
    return (
        labelled.filter(F.col("episode").isNotNull())
        .groupBy(*robot, "episode")
        .agg(
            F.count_if("is_frame").alias("frames"),
            F.min(pos).alias("first_position"),
            F.max("verdict").alias("verdict"),
            F.coalesce(F.bool_or(F.col("verdict") == "discarded"), F.lit(False)).alias("_discarded"),
        )
        .filter(F.col("verdict").isin("success", "fail") & ~F.col("_discarded"))
        .drop("_discarded")
    )


class EpisodeRecorder(InOrder):
    """The same state machine on a stream: emits an episode when a key finishes it, and a row with the
    verdict `discarded` for one that is taken back after it was finished."""

    row = "order_ts long, order_id long, key string"
    kept = "last string, episode long, frames long, first long"

    def take(self, key, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        # `episode` counts the starts made so far.
        last, episode, frames, first = self.past.get() if self.past.exists() else ("", 0, 0, 0)
        batch = rows.reset_index(drop=True)
        pressed = batch["key"].where(batch["key"].isin(CONTROLS))
        before = pressed.ffill().shift(1).fillna(last)
        on = before == START
        starts = (pressed == START) & ~on
        number = episode + starts.cumsum() - 1
        seen = pd.DataFrame(
            {
                "episode": number,
                "frame": on & batch["key"].isna(),
                "first": batch["order_id"].where(starts),
                "verdict": pressed.where(on).map(FINISHED),
            }
        )[on | starts]
        done = seen.groupby("episode").agg(frames=("frame", "sum"), first_id=("first", "min"), verdict=("verdict", "first"))
        if last == START and episode - 1 in done.index:
            done.loc[episode - 1, "frames"] += frames
            done.loc[episode - 1, "first_id"] = first
        now = pressed.dropna()
        last = now.iloc[-1] if len(now) else last
        current = int(number.iloc[-1])
        if current in done.index:
            frames, first = int(done.loc[current, "frames"]), int(done.loc[current, "first_id"])
        self.past.update((last, current + 1, frames, first))
        ended = done[done["verdict"].notna()].reset_index()
        back = (pressed == RERECORD) & before.isin(list(FINISHED)) & (number >= 0)
        taken = pd.DataFrame({"episode": number[back], "frames": 0, "first_id": batch["order_id"][back], "verdict": "discarded"})
        out = pd.concat([p for p in (ended, taken) if len(p)], ignore_index=True) if len(ended) or len(taken) else ended
        if len(out):
            out.insert(0, "robot", key[0])
            yield out.astype({"episode": "int64", "frames": "int64", "first_id": "int64"})


RECORDED = "robot string, episode long, frames long, first_id long, verdict string"


def record_stream(telemetry: DataFrame, order_id: str) -> DataFrame:
    """Finished episodes, and a row with the verdict `discarded` for each that was taken back later."""
    ordered = telemetry.select(
        "robot", "ts", F.unix_micros("ts").alias("order_ts"), F.col(order_id).alias("order_id"), "key"
    )
    return ordered.groupBy("robot").transformWithStateInPandas(
        EpisodeRecorder(), RECORDED, outputMode="append", timeMode="EventTime"
    )


def first_tail(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Keys of `first_grasps` whose earliest row still waits in a stream that has ended."""
    return state_of(spark, checkpoint, "first").filter("not sent").withColumnRenamed("_key", "key").drop("sent")


def kept_episodes(recorded: DataFrame) -> DataFrame:
    """Rows of finished episodes that were not taken back, of what `record_stream` has written."""
    taken = recorded.filter(F.col("verdict") == "discarded").select("robot", "episode").distinct()
    return recorded.filter(F.col("verdict") != "discarded").join(taken, ["robot", "episode"], "left_anti")


class FirstSeen(StatefulProcessor):
    """Emits the earliest row of a key once the watermark has passed it, then nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "order_ts long, order_id long, sent boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.first.get() if self.first.exists() else None
        if known and known[2]:
            return
        firsts = [b.nsmallest(1, ["order_ts", "order_id"]) for b in rows]
        found = pd.concat(firsts).nsmallest(1, ["order_ts", "order_id"]).iloc[0]
        least = min([(int(found["order_ts"]), int(found["order_id"])), *([tuple(known[:2])] if known else [])])
        self.first.update((*least, False))
        self.handle.registerTimer(least[0] // 1000)
        yield from self.handleExpiredTimer(key, timerValues, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ts, number, sent = self.first.get()
        if sent or ts >= timerValues.getCurrentWatermarkInMs() * 1000:
            return
        self.first.update((ts, number, True))
        yield pd.DataFrame({"key": [key[0]], "order_ts": [ts], "order_id": [number]})

    def close(self) -> None:
        pass


def first_grasps(telemetry: DataFrame, signal: Column, key: str, order_id: str) -> DataFrame:
    """One event per key when its signal is first true. Only rows with the signal reach the state."""
    held = telemetry.filter(signal).select(
        F.col(key).cast("string").alias("key"), "ts", F.unix_micros("ts").alias("order_ts"), F.col(order_id).alias("order_id")
    )
    if not telemetry.isStreaming:
        first = held.groupBy("key").agg(F.min(F.struct("order_ts", "order_id")).alias("_first"))
        return first.select("key", "_first.*")
    return held.groupBy("key").transformWithStateInPandas(
        FirstSeen(), "key string, order_ts long, order_id long", outputMode="append", timeMode="EventTime"
    )


def pair_by_time(leader: DataFrame, follower: DataFrame, tolerance: str = "20 milliseconds") -> DataFrame:
    """Leader and follower rows of the same robot and joint at most `tolerance` apart.

    The join key holds a time bucket as wide as the tolerance: a leader row is in its own, a follower row in its
    own and both next to it, so each pair meets once, and the rows of one robot and joint spread over all
    tasks. Both sides carry a watermark, so a stream-stream join can drop old rows.
    """
    width = F.greatest(F.lit(1), F.expr(f"unix_micros(timestamp_micros(0) + INTERVAL {tolerance})"))

    def bucket(ts: str) -> Column:
        return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / width).cast("long")

    a = leader.select("robot", "joint", F.col("ts").alias("leader_ts"), F.col("value").alias("leader_value"), bucket("ts").alias("_bucket"))
    b = follower.select(
        F.col("robot").alias("_robot"),
        F.col("joint").alias("_joint"),
        F.col("ts").alias("follower_ts"),
        F.col("value").alias("follower_value"),
        F.explode(F.sequence(bucket("ts") - 1, bucket("ts") + 1)).alias("_near"),
    )
    near = F.expr(
        f"robot = _robot AND joint = _joint AND _bucket = _near AND follower_ts >= leader_ts - INTERVAL {tolerance}"
        f" AND follower_ts <= leader_ts + INTERVAL {tolerance}"
    )
    return a.join(b, near).drop("_robot", "_joint", "_bucket", "_near")


def rename_joints(df: DataFrame, source: str = "physical", target: str = "simulated", col: str = "joint") -> DataFrame:
    """Joint names of one scheme in another, by position."""
    pairs = zip(JOINT_SCHEMES[source], JOINT_SCHEMES[target], strict=True)
    table = F.create_map(*[F.lit(v) for pair in pairs for v in pair])
    return df.withColumn(col, F.try_element_at(table, F.col(col)))


def flush_blocks(df: DataFrame, every: int = 100, pos: str = "t") -> DataFrame:
    """Flush block of each sample: floor(position / every)."""
    return df.withColumn("flush_block", F.floor(F.col(pos) / every).cast("long"))


def flush_stream(df: DataFrame, path: str, checkpoint: str, every: int = 100, pos: str = "t"):
    """Samples with their flush block, one folder per micro-batch.

    A micro-batch that runs again after a failure overwrites its own folder, so no row is
    written twice.
    """

    def flush(batch: DataFrame, epoch: int) -> None:
        flush_blocks(batch, every, pos).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    writer = df.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state of the processors above lives in RocksDB on the executors, not on their heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def write_stream(
    df: DataFrame,
    path: str,
    checkpoint: str,
    partition_by: Sequence[str] = (),
    available_now: bool = True,
    trigger: str = "1 second",
    output_mode: str = "append",
):
    """File sink that resumes from its checkpoint without writing a row twice."""
    writer = df.writeStream.format("parquet").outputMode(output_mode).option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger)
    return writer.start(path)

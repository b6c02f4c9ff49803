"""Dataset documents (JSON text, one row per dataset) and file layout.

Documents are parsed to VARIANT maps, so fields this module does not know keep their
value and type. Nothing is changed in place: patched documents are new rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from armature.schema import (
    CAMERA_FIRST_PATH,
    CHUNK_EPISODES,
    CHUNK_FIRST_PATH,
    EPISODE_DATA_PATH,
    FPS,
    JOINTS,
    MODALITY,
    V3,
    V3_ONLY_FIELDS,
    V21,
)

VARIANTS = "map<string,variant>"


def _dealt(docs: DataFrame) -> DataFrame:
    """The documents dealt evenly to some tasks for each core.

    A document takes some thousand times as long to patch as to read, and very many fit in one partition of a file.
    """
    return docs.repartition(4 * docs.sparkSession.sparkContext.defaultParallelism)


def _object(v: Column) -> Column:
    """Fields of a JSON object; null for other values."""
    return F.try_variant_get(v, "$", VARIANTS)


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _json(text: str) -> Column:
    return F.parse_json(F.lit(text))


def _field(m: Column, key: str) -> Column:
    return F.try_element_at(m, F.lit(key))


def _with(m: Column, fields: Sequence[tuple[str, Column, Column]]) -> Column:
    """The map with (key, condition, value) set where the condition holds."""
    changed = [k for k, _, _ in fields]
    conditions = F.array(*[F.struct(F.lit(k).alias("k"), c.alias("c"), v.alias("v")) for k, c, v in fields])
    new = F.map_from_entries(
        F.transform(F.filter(conditions, lambda e: e["c"]), lambda e: F.struct(e["k"].alias("key"), e["v"].alias("value")))
    )
    old = F.map_filter(m, lambda k, _: ~(k.isin(*changed) & F.map_contains_key(new, k)))
    return F.map_concat(old, new)


def patch_info(docs: DataFrame, doc: str = "info", keys: Sequence[str] = ("dataset",), video_shape: bool = True) -> DataFrame:
    """Info documents of version 3.0 turned into 2.1, with a log of (field, old, new).

    Version and video path change only on an exact match; missing totals are added (one
    chunk, whatever the data holds); video codec h264 becomes avc1; height, width and channels
    come from a shape of three or more, unless `video_shape` is off; two fields of version
    3.0 are dropped. A video feature without an info object gets one.
    """
    no_fields = F.create_map().cast(VARIANTS)
    no_features = F.create_map().cast(f"map<string,{VARIANTS}>")
    t = F.col("_top")
    has = lambda k: F.map_contains_key(t, k)
    yes = lambda c: F.coalesce(c, F.lit(False))

    def video(e: Column) -> Column:
        """Key, fields, info and shape of one feature entry."""
        shape = F.try_variant_get(_field(e["value"], "shape"), "$", "array<variant>")
        return F.struct(
            e["key"].alias("key"),
            e["value"].alias("fields"),
            F.coalesce(_object(_field(e["value"], "info")), no_fields).alias("info"),
            F.coalesce(shape, F.array().cast("array<variant>")).alias("shape"),
        )

    def edits(v: Column) -> Column:
        """The same feature with its changes: (field, old, new, value)."""
        coded = yes(_text(_field(v["info"], "video.codec")) == "h264")
        found = [F.when(coded, _change("video.codec", F.lit("h264"), F.lit("avc1"), _json('"avc1"')))]
        for i, name in enumerate(("height", "width", "channels") if video_shape else ()):
            value = F.get(v["shape"], F.lit(i))
            missing = (F.size(v["shape"]) >= 3) & ~F.map_contains_key(v["info"], f"video.{name}")
            found.append(F.when(missing, _change(f"video.{name}", F.lit("missing"), F.to_json(value), value)))
        return F.struct(v["key"], v["fields"], v["info"], F.array_compact(F.array(*found)).alias("edits"))

    def edited(v: Column) -> Column:
        """Feature entry with its info object rewritten."""
        changed = F.map_from_entries(F.transform(v["edits"], lambda e: F.struct(e["field"], e["value"])))
        info = F.map_concat(F.map_filter(v["info"], lambda k, _: ~F.map_contains_key(changed, k)), changed)
        kept = F.map_filter(v["fields"], lambda k, _: k != "info")
        return F.struct(v["key"], F.map_concat(kept, F.create_map(F.lit("info"), F.to_variant_object(info))))

    is_video = lambda e: yes(_text(_field(e["value"], "dtype")) == "video")
    parsed = _dealt(docs).withColumn("_top", _object(F.parse_json(F.col(doc))))
    features = F.transform_values(_object(_field(t, "features")), lambda _, v: _object(v))
    listed = parsed.withColumn("_features", F.coalesce(features, no_features)).withColumn(
        "_videos", F.transform(F.filter(F.map_entries("_features"), is_video), video)
    )
    episodes = F.coalesce(F.try_variant_get(_field(t, "total_episodes"), "$", "bigint"), F.lit(0))
    rows = listed.withColumns(
        {"_edits": F.transform("_videos", edits), "_total_videos": (episodes * F.size("_videos")).cast("string")}
    )

    path_matches = yes(_text(_field(t, "video_path")) == CAMERA_FIRST_PATH)
    tops = F.array_compact(
        F.array(
            F.when(
                yes(_text(_field(t, "codebase_version")) == V3),
                _change("codebase_version", F.lit(V3), F.lit(V21), _json(f'"{V21}"')),
            ),
            F.when(
                path_matches,
                _change("video_path", F.lit("v3.0 format"), F.lit("v2.1 format"), _json(f'"{CHUNK_FIRST_PATH}"')),
            ),
            F.when(
                ~has("total_videos"),
                _change("total_videos", F.lit("missing"), F.col("_total_videos"), F.parse_json("_total_videos")),
            ),
            F.when(~has("total_chunks"), _change("total_chunks", F.lit("missing"), F.lit("1"), _json("1"))),
        )
    )
    dropped = F.array_compact(
        F.array(*[F.when(has(k), _logged(F.lit(k), F.lit("present"), F.lit("removed"))) for k in V3_ONLY_FIELDS])
    )
    touched = F.filter("_edits", lambda v: F.size(v["edits"]) > 0)
    log = F.concat(
        F.transform("_tops", lambda e: _logged(e["field"], e["old"], e["new"])),
        F.flatten(
            F.transform(
                "_edits",
                lambda v: F.transform(
                    v["edits"], lambda e: _logged(F.concat(v["key"], F.lit("."), e["field"]), e["old"], e["new"])
                ),
            )
        ),
        dropped,
    )
    new_features = F.map_concat(
        F.map_filter("_features", lambda k, _: ~F.array_contains(F.transform("_touched", lambda v: v["key"]), k)),
        F.map_from_entries(F.transform("_touched", edited)),
    )
    top_changes = F.map_from_entries(F.transform("_tops", lambda e: F.struct(e["field"], e["value"])))
    all_changes = F.when(
        has("features"),
        F.map_concat(top_changes, F.create_map(F.lit("features"), F.to_variant_object(new_features))),
    ).otherwise(top_changes)
    kept = F.map_filter(t, lambda k, _: ~k.isin(*V3_ONLY_FIELDS) & ~F.map_contains_key(F.col("_changes"), k))
    return (
        rows.withColumns({"_tops": tops, "_touched": touched})
        .withColumns({"_changes": all_changes, "changes": log})
        .select(*keys, "changes", F.to_json(F.to_variant_object(F.map_concat(kept, "_changes"))).alias(doc))
    )


def _change(field: str, old: Column, new: Column, value: Column) -> Column:
    return F.struct(F.lit(field).alias("field"), old.alias("old"), new.alias("new"), value.alias("value"))


def _logged(field: Column, old: Column, new: Column) -> Column:
    return F.struct(field.alias("field"), old.alias("old"), new.alias("new"))


def info_document(totals: DataFrame, features: DataFrame, fps: int = FPS, robot_type: str = "") -> DataFrame:
    """Info documents of version 2.1 from dataset totals and (dataset, features) JSON text."""
    joined = totals.join(features, "dataset")
    parsed = F.parse_json("features")
    counts = [F.col(c) for c in ("total_episodes", "total_frames", "total_tasks", "total_videos", "total_chunks")]
    fields = F.struct(
        F.lit(V21).alias("codebase_version"),
        F.lit(robot_type).alias("robot_type"),
        F.lit(fps).alias("fps"),
        *counts,
        F.lit(CHUNK_EPISODES).alias("chunks_size"),
        F.lit(EPISODE_DATA_PATH).alias("data_path"),
        F.lit(CHUNK_FIRST_PATH).alias("video_path"),
        parsed.alias("features"),
    )
    return joined.select("dataset", F.to_json(fields).alias("info"))


def video_feature_count(features: Column | str) -> Column:
    """Number of features of type video in a JSON feature map."""
    text = F.col(features) if isinstance(features, str) else features
    entries = F.transform_values(_object(F.parse_json(text)), lambda _, v: _text(_field(_object(v), "dtype")))
    return F.size(F.map_filter(entries, lambda _, kind: F.coalesce(kind == "video", F.lit(False))))


def set_episode_paths(docs: DataFrame, doc: str = "info") -> DataFrame:
    """Data and video paths of the layout with one file per episode."""
    top = _object(F.parse_json(F.col(doc)))
    paths = [
        ("data_path", F.lit(True), _json(f'"{EPISODE_DATA_PATH}"')),
        ("video_path", F.lit(True), _json(f'"{CAMERA_FIRST_PATH}"')),
    ]
    return docs.withColumn("_top", top).withColumn(
        doc, F.to_json(F.to_variant_object(_with(F.col("_top"), paths)))
    ).drop("_top")


def set_codec(docs: DataFrame, codec: str = "h264", doc: str = "info") -> DataFrame:
    """Set the codec of video features that have an info object; others are left alone."""
    features = F.transform_values(_object(_field(F.col("_top"), "features")), lambda _, v: _object(v))
    rows = _dealt(docs).withColumn("_top", _object(F.parse_json(F.col(doc)))).withColumn("_features", features)

    def coded(f: Column) -> Column:
        info = _object(_field(f, "info"))
        new = F.to_variant_object(_with(info, [("video.codec", F.lit(True), _json(f'"{codec}"'))]))
        video = F.coalesce(_text(_field(f, "dtype")) == "video", F.lit(False))
        return F.when(video & info.isNotNull(), _with(f, [("info", F.lit(True), new)])).otherwise(f)

    new_features = F.to_variant_object(F.transform_values("_features", lambda _, f: coded(f)))
    top = _with(F.col("_top"), [("features", F.col("_features").isNotNull(), new_features)])
    return rows.withColumn(doc, F.to_json(F.to_variant_object(top))).drop("_top", "_features")


def modality_rows(docs: DataFrame, doc: str = "modality", keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """Rows (kind, name, start, end, original_key) of modality documents."""
    schema = "map<string,map<string,struct<start:bigint,end:bigint,original_key:string>>>"
    kinds = docs.select(*keys, F.explode(F.from_json(doc, schema)).alias("kind", "_names"))
    return kinds.select(*keys, "kind", F.explode("_names").alias("name", "_slice")).select(
        *keys, "kind", "name", "_slice.*"
    )


def modality_document(rows: DataFrame, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """One JSON document per dataset from modality rows."""
    entry = F.struct("start", "end", "original_key")
    named = rows.groupBy(*keys, "kind").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", entry.alias("slice"))))).alias("_names")
    )
    whole = F.map_from_entries(F.collect_list(F.struct("kind", "_names")))
    return named.groupBy(*keys).agg(F.to_json(whole).alias("modality"))


def modality_issues(rows: DataFrame, dims: DataFrame, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """Overlapping slices, slices past the width, and joints no slice covers.

    `dims` has (keys, kind, dim). One window over the few slices of a dataset and kind.
    """
    vector = rows.filter(F.col("start").isNotNull()).join(dims, [*keys, "kind"])
    order = Window.partitionBy(*keys, "kind").orderBy("start", "end", "name")
    reached = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    following = F.lead("start", 1).over(order)
    end = F.greatest(F.col("_reached"), F.col("end"))
    checked = vector.withColumns({"_reached": reached, "_next": following}).withColumn(
        "issue",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("start") < F.col("_reached"), "overlap"),
                    F.when(F.col("end") > F.col("dim"), "past the end"),
                    F.when(F.col("start") > F.col("_reached"), "joints missing before"),
                    F.when(F.col("_next").isNull() & (end < F.col("dim")), "joints missing after"),
                )
            )
        ),
    )
    return checked.select(*keys, "kind", "name", "start", "end", "issue")


def default_modality(datasets: DataFrame) -> DataFrame:
    """Modality rows of a single arm with two cameras, for each dataset."""
    slices = [(kind, name, a, b, None) for kind in ("state", "action") for name, (a, b) in MODALITY.items()]
    videos = [("video", name, None, None, f"observation.images.{name}") for name in ("scene", "wrist")]
    task = [("annotation", "human.task_description", None, None, "task_index")]
    rows = F.array(
        *[
            F.struct(
                F.lit(k).alias("kind"),
                F.lit(n).alias("name"),
                F.lit(a).cast("long").alias("start"),
                F.lit(b).cast("long").alias("end"),
                F.lit(o).cast("string").alias("original_key"),
            )
            for k, n, a, b, o in [*slices, *videos, *task]
        ]
    )
    return datasets.select("dataset", F.inline(rows))


def parse_video_paths(files: DataFrame, path: str = "path") -> DataFrame:
    """Camera, chunk and episode of paths in either layout.

    Only chunk folders count, and hidden folders are skipped.
    """
    camera_first = r"videos/([^/.][^/]*)/(chunk-[^/]*)/([^/]+\.mp4)$"
    chunk_first = r"videos/(chunk-[^/]*)/([^/.][^/]*)/([^/]+\.mp4)$"
    p = F.col(path)
    first = F.regexp_extract(p, camera_first, 2) != ""
    second = ~first & (F.regexp_extract(p, chunk_first, 1) != "")
    pick = lambda a, b: F.when(first, F.regexp_extract(p, camera_first, a)).when(
        second, F.regexp_extract(p, chunk_first, b)
    )
    episode = F.regexp_extract(p, r"episode_(\d+)\.mp4$", 1)
    return (
        files.withColumns({"camera": pick(1, 2), "chunk": pick(2, 1), "file": pick(3, 3)})
        .withColumn("camera_first", first)
        .withColumn("episode_index", F.when(episode != "", episode).cast("long"))
        .filter(F.col("camera").isNotNull())
    )


def video_moves(files: DataFrame, path: str = "path") -> DataFrame:
    """Manifest (source, target) from videos/camera/chunk to videos/chunk/camera.

    Lists episode files only; nothing is moved. A camera missing in a chunk has no rows.
    """
    parsed = parse_video_paths(files, path).filter(F.col("camera_first") & F.col("episode_index").isNotNull())
    target = F.regexp_replace(F.col(path), r"videos/([^/]+)/(chunk-[^/]*)/", "videos/$2/$1/")
    return parsed.select(F.col(path).alias("source"), target.alias("target"), "chunk", "camera", "episode_index")


def video_counts(moves: DataFrame, by: Sequence[str] = ("chunk", "camera")) -> DataFrame:
    return moves.groupBy(*by).agg(F.count(F.lit(1)).alias("videos"))


def episode_names(df: DataFrame, col: str = "episode_index") -> DataFrame:
    return df.withColumn("episode_name", F.format_string("episode_%06d", col))


def joint_coverage(names: DataFrame, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """Joints of the arm a dataset does not name."""
    wanted = names.select(*keys).distinct().withColumn("joint", F.explode(F.array(*[F.lit(j) for j in JOINTS])))
    return wanted.join(names.select(*keys, "joint"), [*keys, "joint"], "left_anti")

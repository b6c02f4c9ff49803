"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from armature.catalog import QUERIES  # noqa: E402
from armature.session import local_session  # noqa: E402

HEADLINE = (
    "feature_stats",
    "episode_summary",
    "normalize_minmax",
    "remap_joints",
    "frames_with_task",
    "action_chunks",
    "history",
    "latch",
    "segments",
    "frames_in_segments",
    "renumber",
    "episode_sampler",
    "smooth_medium",
    "smoothed_health",
    "diagnose_chunks",
    "execute_chunks",
    "masked_mse",
    "histogram",
    "task_done",
    "grasped",
    "merge_datasets",
    "mixture_weights",
    "patch_info",
    "nearest_segments",
    "stitch",
    "accept",
    "training_samples",
    "asof_tracking",
    "stream_rate",
    "stream_smooth",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus=cpus, shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    for name in ("episode_summary", "ema"):  # start the JVM compiler and the Python workers
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    spark.stop()
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": float(sf)}))


if __name__ == "__main__":
    main()

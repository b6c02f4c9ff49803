"""Session helpers: a local session for tests and benches, and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, memory: str = "16g") -> SparkSession:
    """A single-machine session. On a cluster the session comes from spark-submit instead."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("armature")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send the package to the executors' Python, once per application.

    Functions of the package that run in Python workers are pickled by name, so the workers must be able to
    import it wherever they were started.
    """
    context = spark.sparkContext
    if getattr(context, "_armature_sent", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="armature-"), "armature.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(package)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    # Workers that the driver itself starts, as for the set-up of stateful streams, don't see files that were added.
    context.environment["PYTHONPATH"] = os.pathsep.join(x for x in (archive, context.environment.get("PYTHONPATH")) if x)
    context._armature_sent = True


#: Says that a path without a scheme, or a file: path, is one mount that all machines share.
MOUNTED = "spark.armature.sharedFolderIsMounted"

#: The fallback folders of local sessions, by application.
_fallbacks: dict[str, str] = {}

#: Whether a folder was found to be shared, by application and folder.
_proven: dict[tuple[str, str], bool] = {}


def _is_shared(spark: SparkSession, folder: str) -> bool:
    """Whether the driver and all executors see the same files below a folder.

    A path on a file system of its own scheme is, and so is what the setting MOUNTED vouches for. Any other may be one
    mount, or one machine that runs the whole cluster: tasks on all executors then write rows there, and each must come back.
    """
    if "://" in folder.replace("file:", "") or spark.conf.get(MOUNTED, "false") == "true":
        return True
    try:
        context = spark.sparkContext
        key = (context.applicationId, folder)
        if key not in _proven:
            tasks = 4 * max(1, context.defaultParallelism)
            path = os.path.join(folder, f"probe-{uuid.uuid4().hex}")
            spark.range(0, tasks, 1, tasks).write.parquet(path)
            _proven[key] = spark.read.schema("id long").parquet(path).agg(F.sum("id")).first()[0] == tasks * (tasks - 1) // 2
        return _proven[key]
    except Exception:  # what cannot be tried is not proven
        return False


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, for written tables and streaming checkpoints.

    It is the one the cluster names in spark.checkpoint.dir or by setCheckpointDir, else one below the warehouse. Only a session in one
    process may fall back on a temporary folder: executors elsewhere would not see it.
    """
    context = spark.sparkContext
    alone = context.master.startswith("local") and not context.master.startswith("local-cluster")
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if alone:
        return named or _fallbacks.setdefault(context.applicationId, tempfile.mkdtemp(prefix="armature-"))
    if named and _is_shared(spark, named):
        return named
    tables = spark.conf.get("spark.sql.warehouse.dir", None)
    if tables and _is_shared(spark, tables):
        return os.path.join(tables, "armature-work")
    if named:
        raise ValueError(f"{named} is a path on each machine's own disk; if it is a shared mount, set {MOUNTED}=true")
    raise ValueError("spark.checkpoint.dir must name a folder that all executors share")


def new_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing is ever overwritten."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")

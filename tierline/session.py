"""Session helpers: scale-aware defaults and the shared checkpoint folder.

Nothing here hides Spark: ``build_session`` is a plain builder with the
settings a 1000-executor job wants (AQE with partition coalescing and skew
splitting, a bounded file split size), ``checkpoint_dir`` resolves the
shared folder named by ``spark.checkpoint.dir``, and ``small_tasks`` bounds what a
task of a build holds in memory and what a write leaves on disk.  Where the
checkpoint setting is absent, one local JVM uses a folder of its own; anything
else is an error.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import SparkSession

SCALE_DEFAULTS: dict[str, str] = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    # checkpoint files of collected plans are removed, so a long-lived
    # session does not fill the shared folder
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # the build submits the independent models of a level as concurrent
    # jobs; FAIR lets small ones run beside a large one instead of queueing
    "spark.scheduler.mode": "FAIR",
}

#: Most bytes that a task reads from files or shuffles while a table is stored: in memory
#: its rows take 10 to 20 times that.
TASK_BYTES = 32 << 20
_TASK_SIZES = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
#: Partition folders that a task writes side by side; only a task with more sorts its rows by folder.
OPEN_FOLDERS = 16
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
#: The shuffle files of a write go when it ends, not when the driver next collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Stored Parquet is written with zstd where the session says nothing but Spark's default.
_CODEC = "spark.sql.parquet.compression.codec"
_small: WeakKeyDictionary[SparkSession, tuple[int, dict[str, str]]] = WeakKeyDictionary()
_small_lock = threading.Lock()


@contextmanager
def small_tasks(spark: SparkSession) -> Iterator[None]:
    """Keep the memory of a task small in the jobs started inside, however large
    the tables are: less input for each task, and no sort of all its rows before
    they go to partition folders.  A session with tighter settings keeps them.
    Of a write, nothing but its compressed output stays on disk.
    Threads may overlap; the last to leave restores the session's settings."""
    with _small_lock:
        users, before = _small.get(spark, (0, {}))
        if not users:
            before = {key: spark.conf.get(key) for key in (*_TASK_SIZES, _WRITERS, _CODEC)}
            before[_CLEANUP] = spark.conf.get(_CLEANUP, "false")  # Spark before 4.1 has no such setting
            size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
            for key in _TASK_SIZES:
                spark.conf.set(key, str(min(size(before[key]), TASK_BYTES)))
            spark.conf.set(_WRITERS, str(int(before[_WRITERS]) or OPEN_FOLDERS))
            spark.conf.set(_CLEANUP, "true")
            spark.conf.set(_CODEC, "zstd" if before[_CODEC] == "snappy" else before[_CODEC])
        _small[spark] = users + 1, before
    try:
        yield
    finally:
        with _small_lock:
            users, before = _small[spark]
            _small[spark] = users - 1, before
            if users == 1:
                for key, value in before.items():
                    spark.conf.set(key, value)


def partitions_for(input_bytes: int, target_bytes: int = 256 << 20, minimum: int = 200, maximum: int = 100_000) -> int:
    """Shuffle partitions so one partition of a shuffle as large as the input
    holds about ``target_bytes`` (fits executor memory without spilling), at
    most ``maximum`` (the driver tracks every map x reduce pair; partitions of
    1 GB at 100 TB still spill in order).  AQE coalesces the smaller shuffles
    from there."""
    return min(maximum, max(minimum, -(-int(input_bytes) // int(target_bytes))))


def build_session(
    master: str | None = None,
    app_name: str = "tierline",
    shuffle_partitions: int | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """Return a session with AQE and skew handling switched on.

    ``shuffle_partitions`` is the *upper* bound AQE coalesces from; take it
    from ``partitions_for``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(SCALE_DEFAULTS)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Resolve (and register) the shared checkpoint folder of this session."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not configured:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a shared folder "
                "(HDFS/object store) before running jobs that cut lineage"
            )
        configured = f"{tempfile.gettempdir()}/tierline-{sc.applicationId}"
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh location under the shared checkpoint folder (never reused)."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"

"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job relies on: UTC wall-clock semantics for period labels,
# adaptive execution for runtime broadcast decisions, partition coalescing and
# skew-join splitting of hot keys.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.ui.enabled": "false",
}


def build_session(
    master: str | None = None,
    *,
    app_name: str = "yieldspark",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the settings the library assumes.

    ``master`` is only set when given; on a cluster the launcher decides it.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    return spark


RUNTIME_DEFAULTS = {
    key: value
    for key, value in SESSION_DEFAULTS.items()
    if key.startswith("spark.sql.") and key != "spark.sql.parquet.compression.codec"
}


def prepare_session(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings the library relies on to an existing session.

    Used when the session was built elsewhere: period labels assume a UTC
    session time zone, and hot keys rely on adaptive skew-join splitting.
    """
    for key, value in RUNTIME_DEFAULTS.items():
        spark.conf.set(key, value)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    The cluster names it in ``spark.checkpoint.dir``.  Only in local mode may
    that setting be absent; a private folder is created and set then.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir names no folder that the executors share; set it when starting the session")
    local = tempfile.mkdtemp(prefix="yieldspark-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, unique folder under the shared checkpoint directory."""
    root = ensure_checkpoint_dir(spark)
    if "://" not in root:
        root = os.path.abspath(root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


@contextmanager
def small_reads(spark: SparkSession, size: str = "32m") -> Iterator[None]:
    """Deal files in pieces that a task can sort without spilling; stored rows are several times smaller than sorted ones."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_CLEANUP_LOCK = threading.Lock()
_CLEANUP_USERS: dict[SparkSession, tuple[int, str]] = {}


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Jobs begun inside remove their shuffle files when they end, not when the driver's garbage is next collected.

    For frames that are written or reduced to a few rows once, as nothing reads their
    shuffles again.  Threads may be inside side by side; the last one out restores the setting.
    """
    with _CLEANUP_LOCK:
        users, before = _CLEANUP_USERS.get(spark, (0, ""))
        if not users:
            before = spark.conf.get(SHUFFLE_CLEANUP, "false")
            spark.conf.set(SHUFFLE_CLEANUP, "true")
        _CLEANUP_USERS[spark] = (users + 1, before)
    try:
        yield
    finally:
        with _CLEANUP_LOCK:
            users, before = _CLEANUP_USERS.pop(spark)
            if users > 1:
                _CLEANUP_USERS[spark] = (users - 1, before)
            else:
                spark.conf.set(SHUFFLE_CLEANUP, before)

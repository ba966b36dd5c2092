"""Session construction and the shared working folder.

Everything a job writes between steps (topic logs, stream checkpoints,
file drops, sink tables) goes below ``spark.checkpoint.dir``: on a cluster
that is the shared folder the platform names; only when it is unset (local
tests) do we create one.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "shardline", extra: dict | None = None, *,
                  large_state: bool = False, max_partition_mb: int | None = None,
                  event_log_dir: str | None = None) -> SparkSession:
    """A session tuned for these jobs; on a cluster pass the cluster's master
    and a shuffle partition count sized to the data (about 128-256 MB each).

    ``large_state`` keeps streaming state in RocksDB (off the JVM heap, with
    changelog checkpoints) instead of in memory: the choice for long
    sessions and many keys on a cluster; for small state it is slower.
    ``max_partition_mb`` sets the scan split size. ``event_log_dir`` turns
    on Spark's event log there (stage and task times without the web UI,
    which stays off)."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    )
    if large_state:
        builder = (builder
                   .config("spark.sql.streaming.stateStore.providerClass",
                           "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
                   .config("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true"))
    if event_log_dir:
        builder = builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", event_log_dir)
    if max_partition_mb:
        builder = builder.config("spark.sql.files.maxPartitionBytes", f"{int(max_partition_mb)}m")
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; created only when unset."""
    root = spark.sparkContext.getCheckpointDir()
    if not root:
        conf_dir = spark.conf.get("spark.checkpoint.dir", None)
        if conf_dir:
            spark.sparkContext.setCheckpointDir(conf_dir)
        else:
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shardline-ckpt-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def hadoop_path(spark: SparkSession, path: str):
    """(path, file system) of a folder, through Hadoop's file system API."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = hadoop_path(spark, path)
    return fs.exists(p)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet into the shared folder and read it back.

    Cuts lineage without executor-local copies: a lost executor costs the tasks
    it ran, never a result already staged. The folder goes when the JVM ends;
    ``drop_staged`` removes it earlier."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    p, fs = hadoop_path(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def drop_staged(*frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in frames:
        p, fs = hadoop_path(df.sparkSession, df.staged_at)
        fs.delete(p, True)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Within it, the shuffle files of a step go when the step is done. Spark otherwise keeps
    them until the driver's garbage collection finds them unused, so that those of many
    steps lie on the disks at once. Holds for the frames that are made and run within."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def ship_package(spark: SparkSession) -> None:
    """Send this package's modules to the Python workers, once per application,
    so that they need no installed copy and no particular working folder."""
    sc = spark.sparkContext
    if getattr(sc, "_shardline_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="shardline-modules-"), "shardline_modules.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(archive)
    sc._shardline_shipped = True

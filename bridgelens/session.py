"""Session and scratch-space helpers."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "bridgelens") -> SparkSession:
    """A local session for tests and the benchmark (never used on a cluster)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a fresh temporary
    folder (as in tests); on a cluster a missing setting is an error, because
    a machine-local folder would not survive the loss of an executor.
    """
    conf = spark.conf.get(CHECKPOINT_CONF, None)
    try:
        sc = spark.sparkContext
    except Exception:  # client-only session: the setting must come from the conf
        sc = None
    if not conf and sc is not None:
        conf = sc.getCheckpointDir()
    if conf:
        return conf.rstrip("/")
    master = spark.conf.get("spark.master", "") or (sc.master if sc is not None else "")
    if sc is None or not master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a shared folder before materialising tables")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="bridgelens-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of ``path`` and the path in its form."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a stored table's folder, if it is there."""
    fs, where = file_system(spark, path)
    fs.delete(where, True)


@contextmanager
def job_description(spark: SparkSession, text: str):
    """Name the Spark jobs started inside the block (event log / UI), then
    restore the previous description.  A no-op where no SparkContext exists."""
    try:
        sc = spark.sparkContext
        old = sc.getLocalProperty("spark.job.description")
    except Exception:  # e.g. a client-only session
        yield
        return
    sc.setJobDescription(text)
    try:
        yield
    finally:
        sc.setLocalProperty("spark.job.description", old)

"""Session helpers: building a session and resolving the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "carescope",
              shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Return the active session or build one with the settings every operator assumes.

    UTC session time zone (the fixture timestamps are zone-less), AQE on, UI off.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        # checkpoint files of lineage cuts are removed once their DataFrame is garbage collected
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf)
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Read from the session (``spark.checkpoint.dir`` or the context's checkpoint dir).
    Only when nothing is configured and the master is local (tests, single machine)
    is a private temporary folder created; on a cluster an unset value is an error,
    because a machine-local folder would not survive the loss of an executor.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # a remote (Connect) session: the server owns the checkpoint folder
        conf_dir = spark.conf.get("spark.checkpoint.dir", None)
        if not conf_dir:
            raise RuntimeError("spark.checkpoint.dir is not set on the server session") from None
        return conf_dir
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; configure a shared folder for the cluster")
    path = tempfile.mkdtemp(prefix="carescope-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete an intermediate folder on whatever file system it lies."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def cut_lineage(df):
    """Reliable checkpoint into the shared checkpoint folder (never localCheckpoint).

    The input is persisted for the duration of the checkpoint so that the eager action and the
    checkpoint write share one computation instead of running the plan twice.
    """
    from pyspark import StorageLevel
    checkpoint_dir(df.sparkSession)
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return held.checkpoint(eager=True)
    finally:
        held.unpersist()


@contextmanager
def small_methods(spark: SparkSession) -> Iterator[None]:
    """For actions over wide projections: the JVM interprets a method of more than 8000 bytes for ever, so stages whose
    code is longer are run operator by operator. The caller's setting is put back at the end."""
    name, limit = "spark.sql.codegen.hugeMethodLimit", 8000
    before = spark.conf.get(name, str(65_535))
    spark.conf.set(name, str(min(limit, int(before))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def kept_table(df, kind: str):
    """A narrow table that several passes read: Parquet beside the checkpoints, where it stays until that folder is cleared.

    Columns of few distinct values take a byte or so a row, and a pass decodes only the columns that it names.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    with small_methods(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

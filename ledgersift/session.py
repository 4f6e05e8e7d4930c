"""Session settings for local runs, and the folder for data shared between jobs."""

from __future__ import annotations

import logging
import os
import tempfile

from pyspark.sql import SparkSession

logger = logging.getLogger(__name__)

CHECKPOINT_DIR = "spark.checkpoint.dir"
LOCAL_DIR = "spark.ledgersift.local.dir"


def local_session(cpus: int | str = "*", name: str = "ledgersift", **confs: str) -> SparkSession:
    """A local session for tests and the bench; a cluster supplies its own."""
    shuffles = str(os.cpu_count() if cpus == "*" else cpus)
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName(name)
               .config("spark.ui.enabled", "false")
               .config("spark.sql.shuffle.partitions", shuffles)
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.python.sql.dataFrameDebugging.enabled", "false")
               .config("spark.driver.memory", "8g"))
    for key, value in confs.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read, named by the cluster in ``spark.checkpoint.dir``.

    Where the setting is absent, a temporary folder serves a local session only.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None) or spark.conf.get(LOCAL_DIR, None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="ledgersift-")
    spark.conf.set(LOCAL_DIR, folder)
    return folder


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Removes a folder of this library's own making; what cannot be removed is only logged."""
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception as error:  # noqa: BLE001 - results do not depend on it
        logger.warning("%s is still there: %s", folder, error)

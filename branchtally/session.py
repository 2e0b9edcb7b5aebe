"""Session defaults for local runs and tests.

On a cluster the session is created by the submitter; the library only reads from it.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, app: str = "branchtally") -> SparkSession:
    """A local session with one shuffle partition per core."""
    parts = str(os.cpu_count() or 8) if cores == "*" else str(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", parts)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BRANCHTALLY_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def has_checkpoint_dir(spark: SparkSession) -> bool:
    """Whether a checkpoint folder is set or named by the session's configuration."""
    return bool(spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only where none is configured.

    A cluster names a shared folder in ``spark.checkpoint.dir``. A machine-local folder
    is acceptable only for a local master, so anything else without a setting is refused.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        configured = tempfile.mkdtemp(prefix="branchtally-ckpt-")
    spark.sparkContext.setCheckpointDir(configured)
    return configured

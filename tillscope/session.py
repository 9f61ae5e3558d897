"""Session helpers: local sessions for tests/bench and the shared folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session configured like a small cluster (AQE on, UI off, UTC)."""
    parts = shuffle_partitions or (int(cores) if str(cores).isdigit() else 8)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tillscope")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``), read from the session.

    A folder of this machine is made only for a ``local`` master, where the
    driver and all tasks see the same disk. On any other master an unset
    folder is an error: executors would each write to a disk of their own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors share (master {master!r})")
    sc = spark.sparkContext
    path = sc.getCheckpointDir()
    if not path:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tillscope-ckpt-"))
        path = sc.getCheckpointDir()
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-folder of the shared folder for one job's output."""
    base = shared_dir(spark)
    return os.path.join(base, "tillscope", f"{name}-{uuid.uuid4().hex[:12]}")

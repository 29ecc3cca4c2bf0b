"""Session helpers: a local session for tests/bench and a shared scratch root.

Library code never creates a session; it takes the caller's. Intermediate
files (CSV round trips, model saves, lineage cuts) go under the folder the
cluster names in ``spark.checkpoint.dir``. Only a local master without that
setting (tests, a smoke run) gets a folder of its own; they are deleted when
the application ends.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "murmur") -> SparkSession:
    """Local session with AQE on and the UI off (tests, bench)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("MURMUR_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def spark_context(spark: SparkSession):
    """The SparkContext, or None on a Spark Connect session."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - Connect sessions have no SparkContext
        return None


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for intermediate data, as the session names it.

    ``spark.checkpoint.dir`` (or the context's checkpoint folder) wins. Only
    a local master without either gets a folder of its own; on a cluster a
    machine-local folder would lose data, so there the setting is required.
    """
    sc = spark_context(spark)
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and sc is not None:
        root = sc.getCheckpointDir()
    if not root and sc is not None and sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        root = tempfile.mkdtemp(prefix="murmur-ckpt-")
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path in this application's folder under the checkpoint
    root; the file system deletes that folder when the application ends."""
    root = checkpoint_root(spark).rstrip("/")
    sc = spark_context(spark)
    if sc is None:
        return f"{root}/murmur-{name}-{uuid.uuid4().hex[:12]}"
    own = f"{root}/murmur-{sc.applicationId}"
    folder = sc._jvm.org.apache.hadoop.fs.Path(own)
    fs = folder.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        fs.mkdirs(folder)
        fs.deleteOnExit(folder)
    return f"{own}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder.

    Survives executor loss (unlike cached or locally checkpointed blocks).
    Used where an iterative job would otherwise re-run a long lineage.
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)

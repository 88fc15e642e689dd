"""Session helpers: a local session for tests/bench and a reliable checkpoint dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "tablelens", driver_memory: str = "16g") -> SparkSession:
    """Session for tests and the local bench. On a cluster, build your own."""
    return (
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
        .config("spark.driver.memory", driver_memory)
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint dir of the session.

    Uses ``spark.checkpoint.dir`` (the shared folder the cluster names) when it
    is set. When it is unset, a local master gets a fresh temp folder; on any
    other master that would be a folder of one machine, so it is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tablelens-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def stable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a parquet table in the checkpoint dir and read it back.

    Cuts lineage and survives executor loss: later steps see exactly the rows
    written once (e.g. partition ids of a range-partitioned table), and the
    plan is computed a single time (``checkpoint()`` would compute it twice).
    """
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark)
    path = f"{root.rstrip('/')}/tablelens-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return spark.read.parquet(path)


def scratch(spark: SparkSession, name: str = "files") -> str:
    """A fresh path in the checkpoint dir, for files that a later step reads again."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tablelens-{name}-{uuid.uuid4().hex}"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))

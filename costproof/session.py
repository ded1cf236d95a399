"""Session defaults and durable materialisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "costproof", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and timestamps pinned to UTC.

    Broadcasts are left to Spark: the optimiser compares a side's size with
    ``spark.sql.autoBroadcastJoinThreshold`` (and AQE with the size it measured), so a
    dimension that grows past it falls back to a sort-merge join with skew splitting.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``; without one, fail.

    The engine never chooses a folder: a machine-local one would be lost with its executor.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    sc.setCheckpointDir(configured)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and cut its lineage there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()

"""Session settings and shared folders."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

# Splitting a hot join key at run time is what keeps record-keyed joins healthy, so it is forced
# even where it costs the plan one more exchange.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}
# Small partitions are merged up to this size, and hot ones split to it. It counts compressed bytes, and tables of narrow
# rows take many times that in a task's sorts and hash tables, so it is an eighth of Spark's own. A session's value stays.
DEFAULT_SETTINGS = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m"}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings the operators were designed for; leaves partition counts to the cluster."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    for key, value in DEFAULT_SETTINGS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def local_session(app: str, cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # A local run has few, small partitions; keep them all busy instead of merging them.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "32k")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder that driver and executors share: below ``spark.checkpoint.dir``, else in the warehouse.

    A warehouse on the driver's own disk is no such place for a cluster and is refused there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        base = spark.conf.get("spark.sql.warehouse.dir")
        on_disk = base.startswith(("file:", "/")) and "://" not in base.removeprefix("file://")
        if on_disk and not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"

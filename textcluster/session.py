"""Spark session helpers.

The library never creates machine-local scratch space on a cluster: intermediate tables go to the
shared folder named by ``spark.checkpoint.dir``. Only when that setting is absent (local tests) do we
create one under the system temp folder and record it in the session.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def get_spark(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "textcluster") -> SparkSession:
    """Session for local runs and tests. On a cluster, use the session spark-submit gives you."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TEXTCLUSTER_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; set a local one only where none is configured."""
    sc = spark.sparkContext
    path = spark.conf.get(CHECKPOINT_CONF, None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="textcluster-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for a written intermediate table."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def deal_small(df, bytes_per_core: int = 64 << 20):
    """Deal the rows of a table round-robin over the cores when the whole table is smaller than
    ``bytes_per_core`` times the cores, for which a file's row groups are too few to fill them. The size comes
    from the plan's file statistics, so no job runs; a larger table is read by its own splits."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < bytes_per_core * cores else df


def deal_evenly(df, tasks_per_core: int = 3):
    """Deal rows round-robin, for passes whose time is that of the task with most rows: at least
    ``tasks_per_core`` tasks a core, and no core with a task more than the others."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    waves = max(tasks_per_core, -(-df.rdd.getNumPartitions() // cores))
    return df.repartition(waves * cores)


def materialize(df, how: str = "checkpoint"):
    """Cut lineage before iterative passes. ``checkpoint`` writes the rows to the shared checkpoint
    folder and keeps them in executor memory/disk too: passes read the cache, and an executor lost
    mid-way recomputes its blocks from the written rows, not from the source. ``persist`` only
    caches (a loss recomputes from the source)."""
    from pyspark import StorageLevel

    if how == "checkpoint":
        ensure_checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True).persist(StorageLevel.MEMORY_AND_DISK)
    if how == "persist":
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    raise ValueError("how must be 'checkpoint' or 'persist'")


def cluster_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings for a cluster run sized from the input volume: input splits and shuffle partitions of
    about ``target_partition_bytes`` (so a task's data fits executor memory), at least 3 tasks per
    core, AQE coalescing and skew splitting on, and broadcasts capped at 64 MB (only the bounded
    tables - vocabulary, centroids - are broadcast explicitly)."""
    shuffle_parts = max(3 * total_cores, -(-int(input_bytes) // target_partition_bytes))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(shuffle_parts),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    }

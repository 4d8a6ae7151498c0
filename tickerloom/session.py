"""Session helpers: a local session for tests, and shared scratch tables."""

from __future__ import annotations

import math
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_SCRATCH: dict[str, str] = {}


def local_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tickerloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TICKERLOOM_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


# Stored bytes of the largest input for each shuffle partition, shuffled bytes that one task takes, and stored bytes that one task scans.
PARTITION_BYTES = 2 << 20
TASK_BYTES = 16 << 20
SCAN_BYTES = 32 << 20


def spread_for(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES) -> int:
    """Shuffle partitions in proportion to the files at ``path``, never fewer than set; returns their number.

    A fixed number would let the rows of a task grow with the input.  Adaptive execution joins small partitions up to
    ``TASK_BYTES``, and a scan gives a task ``SCAN_BYTES`` or one row group.  The files are listed, not opened.
    """
    names = ("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    now = int(spark.conf.get(names[0], None) or spark.conf.get("spark.sql.shuffle.partitions"))
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    wanted = math.ceil((listed.agg(F.sum("length")).first()[0] or 0) / partition_bytes)
    if wanted <= now:
        return now
    spark.conf.set(names[0], str(wanted))
    spark.conf.set(names[1], str(TASK_BYTES))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(SCAN_BYTES))
    return wanted


SMALL_FILE_BYTES = 256 << 10


def expect_small_files(spark: SparkSession) -> None:
    """Let a task of this session take many small files; Spark counts each as 4 MB, so that a tree of them makes a task of a few."""
    name = "spark.sql.files.openCostInBytes"
    if spark.conf.get(name) in ("4MB", "4194304", "4194304b"):
        spark.conf.set(name, str(SMALL_FILE_BYTES))


def scratch_root(spark: SparkSession) -> str:
    """Shared folder of the cluster (``spark.checkpoint.dir``), or a temporary one on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = context.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="tickerloom-")
    return _LOCAL_SCRATCH[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the scratch root; nothing is ever overwritten."""
    return f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def pin(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as parquet in the shared scratch folder and read it back.

    Cuts the lineage in a way that survives lost executors, fixes values that depend on physical
    partitioning, and keeps column pruning for later reads (a row checkpoint would not).  Nothing reads the shuffles of the
    write again, so Spark is told to delete their files at its end; else they stay until the driver collects its garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(_FREE_SHUFFLES, "false")
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)

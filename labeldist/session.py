"""Session helpers: building a local session for tests/bench and finding the
shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings that make plans scale: AQE re-plans joins and coalesces / splits
# skewed shuffle partitions at run time.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def cluster_conf(input_bytes: float, executors: int, cores_per_executor: int = 4,
                 target_partition_bytes: float = 256 * 1024 ** 2) -> dict[str, str]:
    """Starting values for a cluster job over ``input_bytes`` of Parquet.

    Scan splits and shuffle partitions of about ``target_partition_bytes``
    keep every task's data well inside executor memory; the shuffle
    partition count stays between the number of task slots and 20 waves of
    them (map-side aggregation makes most shuffles far smaller than the
    input), and AQE coalesces small partitions and splits skewed ones at
    run time."""
    slots = executors * cores_per_executor
    shuffle = min(max(slots, int(input_bytes / target_partition_bytes)), 20 * slots)
    return {
        **SCALE_CONF,
        "spark.sql.files.maxPartitionBytes": str(int(target_partition_bytes)),
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(int(target_partition_bytes)),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    }


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "labeldist") -> SparkSession:
    """A ``local[cores]`` session for tests and the bench (UI off)."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", "16g")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for k, v in SCALE_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must come from the cluster configuration.  Only a
    local-mode session without the setting (tests, bench) gets a fresh private
    folder under the system temp dir.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):   # local-cluster has executors of its own
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        d = tempfile.mkdtemp(prefix="labeldist-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint (written to the shared folder, survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


#: For rows of up to some megabytes.  A writer holds a row group, and a reader decodes up to 4,096 rows of one at once, so
#: groups are small and looked at from the first row on.
SMALL_GROUPS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1"}


def written(df: DataFrame, large_rows: bool = False) -> DataFrame:
    """The frame as a table in the shared folder: computed once (a checkpoint computes twice), and safe from lost executors.

    ``large_rows``: see :data:`SMALL_GROUPS`."""
    path = scratch_path(df.sparkSession, "table")
    df.write.options(**SMALL_GROUPS if large_rows else {}).parquet(path)
    return df.sparkSession.read.parquet(path)


def text_batches(spark: SparkSession, size: str = "4m") -> None:
    """Hand rows to Python in batches of about ``size``: rows hold whole texts or sets, and a batch is held several times
    over, by the executor and its worker.  (A session setting, since it counts when a plan runs.)"""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries built and run inside leave no shuffle files: many small steps would pile them up until the driver's next
    garbage collection."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)

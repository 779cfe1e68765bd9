"""Session set-up, lineage cuts and work spreading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a table that one task works on where they become wide: pages, their observations and vectors.
ROWS_PER_TASK = 50_000


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ruleweave")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names, or a private one in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="ruleweave-"))
    return context.getCheckpointDir()


def scratch_table(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table inside the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settle(frame: DataFrame) -> DataFrame:
    """Compute once and cut lineage with a reliable checkpoint.

    Used for the small grouped tables every later step starts from, so the
    source is read once and a lost executor costs no second pass over it.
    """
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = shared_folder(frame.sparkSession)
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(folder)
    return frame.checkpoint(eager=True)


def parts_for(spark: SparkSession, rows: int, rows_per_task: int = ROWS_PER_TASK) -> int:
    """Tasks for so many rows: one for each core, and more as the rows grow."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // rows_per_task))


def spread(frame: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Use all cores for work on a stored table, and tasks of bounded rows.

    A packed file has few splits, whatever its rows grow to when they are worked
    on, so the number of tasks follows the number of rows (known from the footers).
    """
    parts = parts_for(frame.sparkSession, frame.count(), rows_per_task)
    if frame.rdd.getNumPartitions() >= parts:
        return frame
    return frame.repartition(parts)


"""Where intermediate tables and checkpoints live.

A cluster names a shared folder in ``spark.checkpoint.dir``. Only a local session without that
setting falls back to a temporary folder of its own.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tabloom.errors import DataError

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise DataError(
            "Set spark.checkpoint.dir to a folder all executors share; intermediate tables go there."
        )
    if "path" not in _local:
        _local["path"] = tempfile.mkdtemp(prefix="tabloom-")
        atexit.register(shutil.rmtree, _local["path"], ignore_errors=True)
    return _local["path"]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; nothing is created there yet."""
    return f"{shared_folder(spark)}/tabloom-{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str = "stage", *, parts: str | None = None) -> DataFrame:
    """Write a frame once and read it back.

    Used where several scans follow a shuffle. A written table survives lost executors, is not
    held in memory, and later scans read only the columns they need. ``parts`` names the last
    column, of few values, by which later scans pick rows: each value gets a folder. ``remove`` deletes
    the table of the frame given back.
    """
    path = scratch_path(df.sparkSession, label)
    writer = df.write.partitionBy(parts) if parts else df.write
    writer.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._staged_path = path
    return stored


#: Most rows that one task of ``spread`` holds, so that what a task reads stays the same as tables grow.
MOST_ROWS_PER_TASK = 250_000


def spread(df: DataFrame, rows: int, *, per_task: int = 20_000) -> DataFrame:
    """Fit the number of tasks to costly or repeated work on ``rows`` rows.

    A frame read in fewer tasks than there are cores is spread over them, and a tiny one is
    gathered so that an iteration does not start a task per file. A large table gets at least one task
    for every ``MOST_ROWS_PER_TASK`` rows. Only for frames without a shuffle of their own: asking for
    the number of tasks must not run anything.
    """
    have = df.rdd.getNumPartitions()
    want = max(1, rows // per_task)
    cores = df.sparkSession.sparkContext.defaultParallelism
    least = max(min(want, cores), -(-rows // MOST_ROWS_PER_TASK))
    if have < least:
        return df.repartition(least)
    return df.coalesce(want) if want < have else df


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Give iterative estimators a checkpoint folder unless the session has one."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def remove(*frames: DataFrame) -> None:
    """Delete the tables of frames that ``staged`` gave, once nothing reads them any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

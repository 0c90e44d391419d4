"""Tables written between jobs, and size-checked broadcasts.

Staged tables live under ``spark.checkpoint.dir``, a folder every executor can
reach, so a lost executor costs a re-read, never a different result.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 64 << 20

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for staged tables; a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app = context.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="trialquota-")
    return _local_dirs[app]


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet and return a DataFrame that reads it back."""
    return stage_counted(df, label)[0]


def stage_counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """As ``stage``, with the row count observed while writing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    seen = Observation()
    observed = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    observed.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get["rows"]


def drop_staged(spark: SparkSession) -> None:
    """Delete every table this application has staged."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{context.applicationId}")
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def planned_bytes(df: DataFrame) -> int:
    """The planner's estimate of the size of ``df``; for written tables it follows the files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast only when its row count and its size are known to be small.

    ``df`` should be staged or cheap to count.  Beyond the limit it is returned
    as it is and the join shuffles, with adaptive skew handling.
    """
    count = df.limit(limit + 1).count() if rows is None else rows
    return F.broadcast(df) if count <= limit and planned_bytes(df) <= BROADCAST_BYTES else df

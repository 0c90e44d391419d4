"""The prepared table: Parquet partitioned by split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from trialquota.spec import SPLITS

ROW_GROUP_ROWS = 500_000


def write_prepared(
    df: DataFrame, path: str, row_group_rows: int = ROW_GROUP_ROWS, rebalance: bool = False
) -> None:
    """Write once, partitioned by ``split``; an existing table is an error unless its job broke off.

    Without ``rebalance`` tasks write where they read: no shuffle, one file per
    task and split.  With it, rows are exchanged to even file sizes, and large
    splits are cut by the adaptive planner rather than sent to one task.
    """
    rows = df.hint("rebalance", "split") if rebalance else df
    (
        rows.write.partitionBy("split")
        .option("compression", "zstd")
        .option("parquet.block.row.count.limit", row_group_rows)
        .mode("errorifexists" if is_prepared(df.sparkSession, path) else "overwrite")
        .parquet(path)
    )


def is_prepared(spark: SparkSession, path: str) -> bool:
    """Whether a finished prepared table is there; a job that broke off leaves no mark."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def read_prepared(
    spark: SparkSession, path: str, splits: Sequence[str] = SPLITS, columns: Sequence[str] | None = None,
    ordered_by: str | None = None,
) -> DataFrame:
    """Read chosen splits (partition pruning) and columns (column pruning).

    Sorting is a full shuffle, so rows come unordered unless ``ordered_by`` asks.
    """
    unknown = set(splits) - set(SPLITS)
    if unknown or not splits:
        raise ValueError(f"invalid split selection: {sorted(unknown)}")
    table = spark.read.parquet(path)
    absent = set(columns or ()) - set(table.columns)
    if absent:
        raise ValueError(f"unknown columns: {sorted(absent)}")
    chosen = table.where(F.col("split").isin(*splits))
    if columns is not None:
        chosen = chosen.select(*columns)
    return chosen.orderBy(ordered_by) if ordered_by else chosen

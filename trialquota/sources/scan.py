"""Typed source scans, header checks and source-order row ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from trialquota.sources.staging import broadcast_if_small, stage
from trialquota.spec import ExperimentSpec


def source_schema(spec: ExperimentSpec, text_features: Sequence[str] = ()) -> T.StructType:
    """Declared column types in source order: double features, short 0/1 flags."""
    kinds = {c: T.ShortType() for c in spec.binary_columns}
    kinds |= {c: T.StringType() if c in text_features else T.DoubleType() for c in spec.features}
    return T.StructType([T.StructField(c, kinds[c]) for c in spec.source_columns])


def check_header(spark: SparkSession, path: str, spec: ExperimentSpec) -> tuple[str, ...]:
    """Compare the header line with the declared columns, names and order."""
    header = tuple(spark.read.option("header", True).csv(path).columns)
    if header != spec.source_columns:
        raise ValueError(f"unexpected source header: {header}")
    return header


def scan_csv(
    spark: SparkSession, path: str, spec: ExperimentSpec, text_features: Sequence[str] = (), partitions: int | None = None
) -> DataFrame:
    """Scan CSV (plain or compressed) with the declared types and a zero-based row id.

    A malformed value, or a file whose header differs, fails the job: every
    column is read while the rows are written, so each file's header is checked.
    Whole-gzip files cannot be split; pass ``partitions`` to spread their rows
    before further work.
    """
    check_header(spark, path, spec)
    scan = (
        spark.read.schema(source_schema(spec, text_features))
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(path)
    )
    numbered = with_source_ordinal(scan, spec.row_id).select(spec.row_id, *spec.source_columns)
    return numbered.repartition(partitions) if partitions else numbered


def with_source_ordinal(df: DataFrame, out: str = "row_id") -> DataFrame:
    """Number rows from 0 in source order (file path, then position in the file).

    ``df`` must read files directly.  The rows are written once with their
    position, so ids don't depend on how a later job would pack the files into
    tasks, and compressed files are read once.  Each file split gets its row
    count; running totals over splits give every split its first number.
    """
    tagged = stage(
        df.select(
            "*",
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_at"),
        ),
        "source-rows",
    )
    counts = tagged.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    # One row per file split, whatever the number of rows.
    order = Window.partitionBy(F.lit(1)).orderBy("_file", "_start")
    shifts = stage(
        counts.select("_file", "_start", (F.sum("_n").over(order) - F.col("_n") - F.col("_first")).alias("_shift")),
        "ordinals",
    )
    unknown = F.raise_error(F.lit("source files changed between the two passes")).cast("bigint")
    joined = tagged.join(broadcast_if_small(shifts), ["_file", "_start"], "left")
    return joined.withColumn(out, F.coalesce(F.col("_at") + F.col("_shift"), unknown)).drop(
        "_file", "_start", "_at", "_shift"
    )


def with_parquet_ordinal(df: DataFrame, out: str = "row_id") -> DataFrame:
    """Number Parquet rows from 0 by file path and the row index stored with each file."""
    tagged = df.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_index")
    )
    counts = tagged.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(F.lit(1)).orderBy("_file")  # one row per file
    shifts = stage(counts.select("_file", (F.sum("_n").over(order) - F.col("_n")).alias("_shift")), "ordinals")
    unknown = F.raise_error(F.lit("source files changed between the two passes")).cast("bigint")
    joined = tagged.join(broadcast_if_small(shifts), "_file", "left")
    return joined.withColumn(out, F.coalesce(F.col("_index") + F.col("_shift"), unknown)).drop(
        "_file", "_index", "_shift"
    )

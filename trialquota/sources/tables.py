"""Small tidy result tables: sinks, sources and views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

# Column types of the result tables, as written and read back.
_POLICY = (
    "outcome string, capacity double, estimand_type string, name string, estimate double, "
    "bootstrap_standard_error double, ci_lower double, ci_upper double, bootstrap_replicates int, "
    "selected_rows bigint, selected_fraction_exact double, sample_scope string, unit string, "
    "test_cohort_incremental_count_estimate double, test_cohort_incremental_count_ci_lower double, "
    "test_cohort_incremental_count_ci_upper double, count_unit string, quantity_type string"
)
SCHEMAS = {
    "data_audit": "metric string, value double, quantity_type string, unit string, sample_scope string",
    "balance": "feature string, metric_type string, absolute_value double, value double, sample_scope string, unit string",
    "sample_summary": "metric string, `group` string, value double, quantity_type string, unit string, sample_scope string",
    "average_treatment_effects": "outcome string, estimate double, standard_error double, ci_lower double, ci_upper double, "
    "n_treated bigint, n_control bigint, quantity_type string, unit string, sample_scope string",
    "policy_values": _POLICY,
    "policy_contrasts": _POLICY,
    "qini_coefficients": "policy string, coefficient double, quantity_type string, unit string, sample_scope string",
    "qini_curves": "policy string, fraction double, cumulative_gain double, centered_qini double, unit string, sample_scope string",
}


def write_result(df: DataFrame, directory: str, name: str, fmt: str = "parquet") -> str:
    """Write one result table; these have at most a few thousand rows."""
    if name not in SCHEMAS:
        raise ValueError(f"unknown result table: {name}")
    path = f"{directory.rstrip('/')}/{name}"
    writer = df.coalesce(1).write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)
    return path


def read_result(spark: SparkSession, directory: str, name: str, fmt: str = "parquet") -> DataFrame:
    if name not in SCHEMAS:
        raise ValueError(f"unknown result table: {name}")
    path = f"{directory.rstrip('/')}/{name}"
    if fmt == "csv":
        return spark.read.schema(SCHEMAS[name]).option("header", True).option("mode", "FAILFAST").csv(path)
    return spark.read.parquet(path)


def register_results(
    spark: SparkSession, directory: str, fmt: str = "parquet", names: Sequence[str] = tuple(SCHEMAS)
) -> list[str]:
    """Expose the result tables ``names`` in ``directory`` as temporary views; a missing one is an error."""
    for name in names:
        read_result(spark, directory, name, fmt).createOrReplaceTempView(name)
    return list(names)

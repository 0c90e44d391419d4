"""Source checks, reconciliation and leakage guards."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from trialquota.functions.scores import is_finite
from trialquota.spec import ExperimentSpec

CHECKS = (
    "features_finite",
    "binary_domains_valid",
    "control_has_no_exposure",
    "conversion_implies_visit",
)


def finite_features(df: DataFrame, spec: ExperimentSpec) -> Column:
    """Numeric features finite, other features present."""
    numeric = {name for name, kind in df.dtypes if kind not in ("string", "boolean", "date", "timestamp")}
    parts = [is_finite(F.col(f)) if f in numeric else F.col(f).isNotNull() for f in spec.features]
    return reduce(and_, parts)


def binary_domains(columns: Sequence[str]) -> Column:
    return reduce(and_, [F.col(c).isNotNull() & F.col(c).isin(0, 1) for c in columns])


def control_unexposed(spec: ExperimentSpec) -> Column:
    return (F.col(spec.treatment) == 1) | (F.col(spec.exposure) == 0)


def outcome_implications(spec: ExperimentSpec) -> Column:
    pairs = [(F.col(a) == 0) | (F.col(b) == 1) for a, b in spec.implications]
    return reduce(and_, pairs) if pairs else F.lit(True)


def integrity_row(df: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """Row count and the four checks in one pass; an empty source fails them."""
    every = lambda c: F.coalesce(F.bool_and(c), F.lit(False))
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        every(finite_features(df, spec)).alias("features_finite"),
        every(binary_domains(spec.binary_columns)).alias("binary_domains_valid"),
        every(control_unexposed(spec)).alias("control_has_no_exposure"),
        every(outcome_implications(spec)).alias("conversion_implies_visit"),
    )


def integrity_report(df: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """Tidy ``(metric, value)`` rows; booleans are 1.0 / 0.0."""
    names = ("row_count", *CHECKS)
    cells = F.explode(
        F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names])
    )
    return integrity_row(df, spec).select(cells.alias("c")).select("c.metric", "c.value")


def validate_source(df: DataFrame, spec: ExperimentSpec, expected_rows: int | None = None) -> dict:
    """Run every check and raise naming the failed ones."""
    check_columns(df, spec)
    found = integrity_row(df, spec).first().asDict()
    failed = [name for name in CHECKS if not found[name]]
    if expected_rows is not None and found["row_count"] != expected_rows:
        failed.append("row_count")
    if failed:
        raise ValueError(f"source validation failed: {', '.join(failed)}")
    return {"header_matches": True, **found}


def check_columns(df: DataFrame, spec: ExperimentSpec) -> None:
    """Source columns present in the declared order (the row id may come first)."""
    found = tuple(c for c in df.columns if c != spec.row_id)
    if found != spec.source_columns:
        raise ValueError(f"unexpected source columns: {found}")


def row_count_check(df: DataFrame, expected_rows: int) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count",
        F.lit(expected_rows).cast("bigint").alias("expected_rows"),
        (F.col("row_count") == expected_rows).alias("matches"),
    )


def reconcile_splits(counts: DataFrame, source_rows: int | Column) -> DataFrame:
    """Compare the sum of the split counts with the validated source count."""
    expected = F.lit(source_rows).cast("bigint") if isinstance(source_rows, int) else source_rows
    total = counts.agg(F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("split_rows"))
    return total.select("split_rows", expected.alias("source_rows"), (F.col("split_rows") == expected).alias("matches"))


def require_development_rows(df: DataFrame) -> None:
    """Diagnostics may not see held-out rows."""
    if "split" in df.columns and df.where(F.col("split") == "test").limit(1).count():
        raise ValueError("development diagnostics are restricted to train and validation rows")


def require_train_rows(df: DataFrame) -> None:
    if "split" in df.columns and df.where(~F.col("split").eqNullSafe("train")).limit(1).count():
        raise ValueError("category levels must be fitted from train rows only")


def require_train_and_validation(df: DataFrame) -> None:
    found = df.agg(
        F.bool_or(F.col("split") == "train").alias("train"),
        F.bool_or(F.col("split") == "validation").alias("validation"),
        F.bool_and(F.coalesce(F.col("split").isin("train", "validation"), F.lit(False))).alias("only"),
    ).first()
    if not (found.train and found.validation and found.only):
        raise ValueError("development data must contain only train and validation rows, and both of them")


def require_pre_treatment(columns: Sequence[str], spec: ExperimentSpec) -> None:
    if spec.not_features.intersection(columns):
        raise ValueError("diagnostic features must be pre-treatment covariates only")


def require_feature_only(df: DataFrame, spec: ExperimentSpec) -> None:
    """Scoring input may not carry treatment, outcomes or exposure."""
    leaked = set(spec.binary_columns).intersection(df.columns)
    if leaked:
        raise ValueError(f"scoring input contains post-assignment columns: {sorted(leaked)}")


def alignment(left: DataFrame, right: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Counts of ids on both sides, and of ids only one side has."""
    sides = (
        left.select(F.col(row_id).alias("id"), F.lit(1).alias("l"), F.lit(0).alias("r"))
        .unionByName(right.select(F.col(row_id).alias("id"), F.lit(0).alias("l"), F.lit(1).alias("r")))
        .groupBy("id")
        .agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    )
    return sides.agg(
        F.count(F.when((F.col("l") == 1) & (F.col("r") == 1), 1)).alias("aligned"),
        F.count(F.when(F.col("r") == 0, 1)).alias("left_only"),
        F.count(F.when(F.col("l") == 0, 1)).alias("right_only"),
        F.count(F.when((F.col("l") > 1) | (F.col("r") > 1), 1)).alias("repeated"),
    )


def require_aligned(left: DataFrame, right: DataFrame, row_id: str = "row_id") -> None:
    found = alignment(left, right, row_id).first()
    if found.left_only or found.right_only or found.repeated:
        raise RuntimeError("feature and outcome rows are not aligned")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; empty for a valid result table."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    clash = duplicate_keys(df, keys).limit(1).collect()
    if clash:
        raise ValueError(f"duplicate result row: {clash[0].asDict()}")
    return df


def sample_scopes(df: DataFrame) -> DataFrame:
    return df.groupBy("sample_scope").agg(F.count(F.lit(1)).alias("rows"))


def require_scope(df: DataFrame, scope: str) -> DataFrame:
    if df.where(~F.col("sample_scope").eqNullSafe(scope)).limit(1).count():
        raise ValueError(f"result table must use the {scope} sample")
    return df

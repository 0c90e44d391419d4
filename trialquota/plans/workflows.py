"""The three jobs: prepare a source, train on development rows, evaluate held-out rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from trialquota.operators.bootstrap import paired_bootstrap
from trialquota.operators.boosting import BoostingParams, ModelBundle, fit_bundle, load_bundle, save_bundle, treatment_auc
from trialquota.operators.diagnostics import audit_table, balance_table, effect_table, sample_summary
from trialquota.operators.encoding import apply_category_levels, fit_category_levels
from trialquota.operators.integrity import integrity_report, reconcile_splits, require_aligned, validate_source
from trialquota.operators.policy import check_full_capacity, policy_value_grid, with_aipw
from trialquota.operators.qini import qini_tables
from trialquota.operators.ranking import rank_policies
from trialquota.operators.splits import assign_split, split_counts
from trialquota.functions.scores import transformed_outcome
from trialquota.plans.reports import policy_tables
from trialquota.sources.prepared import is_prepared, read_prepared, write_prepared
from trialquota.sources.staging import stage
from trialquota.sources.tables import write_result
from trialquota.spec import CAPACITIES, SCORE_POLICIES, SPLITS, ExperimentSpec

BOOTSTRAP_SEED = 20260805


@dataclass(frozen=True)
class Paths:
    """Folders shared by the three jobs."""

    prepared: str
    models: str
    results: str


def run_prepare(
    source: DataFrame, spec: ExperimentSpec, paths: Paths, auc_params: BoostingParams, expected_rows: int | None = None,
    fmt: str = "parquet",
) -> DataFrame:
    """Check, split and write the source; report balance and the data audit.

    A prepared table that is already finished is used again, so the job can be
    repeated after a later step failed.
    """
    spark = source.sparkSession
    ordered = source.select(spec.row_id, *spec.source_columns)
    checked = validate_source(ordered, spec, expected_rows)
    if not is_prepared(spark, paths.prepared):
        write_prepared(assign_split(ordered, spec), paths.prepared)

    counts = stage(split_counts(read_prepared(spark, paths.prepared, columns=["split"])), "split-counts")
    if not reconcile_splits(counts, checked["row_count"]).first().matches:
        raise RuntimeError("split row counts do not match the validated source")
    train = read_prepared(spark, paths.prepared, ["train"])
    levels = fit_category_levels(train.select(*spec.categorical, "split"), spec.categorical)
    levels.write.mode("overwrite").parquet(f"{paths.models}/category_levels")

    columns = [spec.row_id, *spec.features, spec.treatment, "split"]
    development = read_prepared(spark, paths.prepared, ["train", "validation"], columns)
    balance = stage(balance_table(development, spec), "balance")
    encoded = apply_category_levels(development, levels, spec.categorical)
    auc = treatment_auc(
        encoded.where("split = 'train'"), encoded.where("split = 'validation'"), spec, levels, auc_params
    )
    report = spark.createDataFrame(
        [(name, float(value)) for name, value in checked.items() if name != "header_matches"],
        "metric string, value double",
    )
    audit = audit_table(report, counts, balance, auc)
    write_result(audit, paths.results, "data_audit", fmt)
    write_result(balance, paths.results, "balance", fmt)
    return audit


def run_train(spark: SparkSession, spec: ExperimentSpec, paths: Paths, params: BoostingParams) -> ModelBundle:
    """Fit and save all models from development rows; exposure is never read."""
    columns = [spec.row_id, *spec.features, spec.treatment, *spec.outcomes, "split"]
    development = read_prepared(spark, paths.prepared, ["train", "validation"], columns)
    levels = spark.read.parquet(f"{paths.models}/category_levels")
    encoded = apply_category_levels(development, levels, spec.categorical)
    bundle = fit_bundle(encoded, levels, spec, params)
    save_bundle(bundle, paths.models)
    return bundle


def evaluate_scored(
    scored: DataFrame,
    spec: ExperimentSpec,
    capacities: Sequence[float] = CAPACITIES,
    replicates: int = 1000,
    seed: int = BOOTSTRAP_SEED,
    mode: str = "blocked",
) -> dict[str, DataFrame]:
    """Policy, contrast and Qini tables of scored held-out rows, from one ranking."""
    primary = spec.outcomes[0]
    psi = [f"psi_{y}" for y in spec.outcomes]
    scored = scored.withColumn("z", transformed_outcome(F.col(primary), F.col(spec.treatment), spec.propensity))
    ranking = rank_policies(scored, SCORE_POLICIES, [*psi, "z"], spec.seed, spec.row_id)
    check_full_capacity(policy_value_grid(ranking, spec.outcomes, capacities))
    summary, _ = paired_bootstrap(
        scored, spec.outcomes, capacities, replicates=replicates, seed=seed, tie_seed=spec.seed, mode=mode,
        row_id=spec.row_id, ranking=ranking,
    )
    values, contrasts = policy_tables(summary, ranking.n_rows)
    coefficients, curves = qini_tables(ranking)
    return {
        "policy_values": values,
        "policy_contrasts": contrasts,
        "qini_coefficients": coefficients,
        "qini_curves": curves,
    }


def run_evaluate(
    spark: SparkSession,
    spec: ExperimentSpec,
    paths: Paths,
    params: BoostingParams,
    capacities: Sequence[float] = CAPACITIES,
    replicates: int = 1000,
    fmt: str = "parquet",
) -> dict[str, DataFrame]:
    """Score held-out rows from covariates, then join outcomes and report.

    Scores are written before any held-out outcome is read.
    """
    bundle = load_bundle(spark, paths.models, spec, params)
    features = read_prepared(spark, paths.prepared, ["test"], [spec.row_id, *spec.features])
    encoded = apply_category_levels(features, bundle.levels, spec.categorical)
    predictions = stage(bundle.score(encoded, spec).drop(*spec.features), "predictions")

    outcomes = read_prepared(spark, paths.prepared, ["test"], [spec.row_id, spec.treatment, *spec.outcomes])
    require_aligned(predictions, outcomes, spec.row_id)
    joined = predictions.join(outcomes, spec.row_id)
    scored = stage(with_aipw(joined, spec.outcomes, spec.treatment, spec.propensity), "scored")

    complete = read_prepared(spark, paths.prepared, SPLITS, [spec.treatment, *spec.outcomes])
    tables = {
        "sample_summary": sample_summary(outcomes, spec),
        "average_treatment_effects": effect_table(complete, spec),
        **evaluate_scored(scored, spec, capacities, replicates),
    }
    for name, table in tables.items():
        write_result(table, paths.results, name, fmt)
    return tables

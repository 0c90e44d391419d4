"""Report queries over the tidy result tables.

Inputs have one row per outcome, capacity and policy, so everything here is
small; it stays in DataFrames so that one job can report on many experiments.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from trialquota.operators.integrity import require_scope, require_unique
from trialquota.spec import CAPACITIES

# Display labels, in display order.
POLICY_LABELS = {
    "random": "Expected random allocation",
    "response": "Response targeting",
    "t_learner": "T-learner uplift targeting",
    "dr_learner": "Doubly robust uplift targeting",
}
CONTRAST_LABELS = {
    "response_minus_random": "Response targeting minus random",
    "t_learner_minus_random": "T-learner minus random",
    "dr_learner_minus_random": "Doubly robust learner minus random",
    "t_learner_minus_response": "T-learner minus response targeting",
    "dr_learner_minus_response": "Doubly robust learner minus response targeting",
}
ALL_TIE = "All rules tie"
PER = 100_000.0
TOLERANCE_ABSOLUTE = 1e-8
TOLERANCE_RELATIVE = 1e-5


def close_to(value: Column, target: Column) -> Column:
    return F.abs(value - target) <= F.lit(TOLERANCE_ABSOLUTE) + F.lit(TOLERANCE_RELATIVE) * F.abs(target)


def _pick(name: Column, labels: dict[str, str]) -> Column:
    chosen = None
    for key, text in labels.items():
        chosen = F.when(name == key, F.lit(text)) if chosen is None else chosen.when(name == key, F.lit(text))
    return chosen


def _order(name: Column, labels: dict[str, str]) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in labels]), name)


def _range_text(low: Column, high: Column) -> Column:
    return F.format_string("%,.1f to %,.1f", low * F.lit(PER), high * F.lit(PER))


def cell_text(estimate: Column, low: Column, high: Column, scale: float, digits: int = 1) -> Column:
    """``estimate [low, high]`` after scaling; values that would print as zero print as 0."""
    clean = lambda v: F.when(F.abs(v * scale) < 0.5 * 10.0 ** (-digits), F.lit(0.0)).otherwise(v * scale)
    spot = f"%.{digits}f"
    return F.format_string(f"{spot} [{spot}, {spot}]", clean(estimate), clean(low), clean(high))


def policy_tables(summary: DataFrame, n_rows: int) -> tuple[DataFrame, DataFrame]:
    """Value and contrast tables with selected rows and whole-cohort counts."""
    n = F.lit(float(n_rows))
    selected = F.floor(F.col("capacity") * n).cast("bigint")
    full = summary.select(
        "*",
        selected.alias("selected_rows"),
        (selected / n).alias("selected_fraction_exact"),
        F.lit("held_out_test").alias("sample_scope"),
        F.lit("incremental_outcomes_per_test_row").alias("unit"),
        (F.col("estimate") * n).alias("test_cohort_incremental_count_estimate"),
        (F.col("ci_lower") * n).alias("test_cohort_incremental_count_ci_lower"),
        (F.col("ci_upper") * n).alias("test_cohort_incremental_count_ci_upper"),
        F.lit("expected_incremental_outcomes_in_test_cohort").alias("count_unit"),
    )
    values = full.where("estimand_type = 'policy_value'").withColumn("quantity_type", F.lit("held_out_policy_value"))
    contrasts = full.where("estimand_type = 'contrast'").withColumn(
        "quantity_type", F.lit("paired_policy_value_difference")
    )
    return values, contrasts


def rows_at_capacity(table: DataFrame, outcome: str, capacity: float) -> DataFrame:
    return table.where((F.col("outcome") == outcome) & close_to(F.col("capacity"), F.lit(float(capacity))))


def policy_view(values: DataFrame, outcome: str, capacity: float) -> DataFrame:
    """Reader-facing policy values at one capacity, in fixed policy order."""
    rows = rows_at_capacity(values, outcome, capacity)
    return rows.select(
        _order(F.col("name"), POLICY_LABELS).alias("position"),
        _pick(F.col("name"), POLICY_LABELS).alias("allocation_rule"),
        F.format_number("selected_rows", 0).alias("selected_users"),
        (F.col("estimate") * F.lit(PER)).alias("outcomes_per_100k"),
        _range_text(F.col("ci_lower"), F.col("ci_upper")).alias("interval_per_100k"),
    ).orderBy("position")


def contrast_view(contrasts: DataFrame, outcome: str, capacity: float) -> DataFrame:
    rows = rows_at_capacity(contrasts, outcome, capacity)
    return rows.select(
        _order(F.col("name"), CONTRAST_LABELS).alias("position"),
        _pick(F.col("name"), CONTRAST_LABELS).alias("comparison"),
        (F.col("estimate") * F.lit(PER)).alias("difference_per_100k"),
        _range_text(F.col("ci_lower"), F.col("ci_upper")).alias("interval_per_100k"),
    ).orderBy("position")


def best_rules(values: DataFrame) -> DataFrame:
    """Highest estimate per outcome and capacity; a label for all-way ties."""
    first = F.struct(F.col("estimate").alias("e"), (-_order(F.col("name"), POLICY_LABELS)).alias("o"))
    best = values.groupBy("outcome", "capacity").agg(
        F.max_by(F.struct("name", "estimate", "selected_rows"), first).alias("top"),
        F.collect_list("estimate").alias("all"),  # one entry per policy
    )
    highest = F.col("top.estimate")
    tied = F.size(F.filter("all", lambda e: close_to(e, highest))) == F.size("all")
    return best.select(
        "outcome",
        "capacity",
        F.col("top.selected_rows").alias("treatment_slots"),
        F.when(tied, F.lit(ALL_TIE)).otherwise(_pick(F.col("top.name"), POLICY_LABELS)).alias("highest"),
        (highest * F.lit(PER)).alias("outcomes_per_100k"),
    )


def sample_table(summary: DataFrame, outcomes: Sequence[str]) -> DataFrame:
    """One row per arm with rows, events and rates as columns."""
    metrics = ["rows"] + [f"{y}_{kind}" for y in outcomes for kind in ("events", "rate")]
    wide = (
        require_unique(summary, ["metric", "group"])
        .where(F.col("group") != "all")
        .groupBy("group")
        .pivot("metric", metrics)
        .agg(F.first("value"))
    )
    percent = [(F.lit(100.0) * F.col(f"{y}_rate")).alias(f"{y}_rate_percent") for y in outcomes]
    return wide.select("group", "rows", *[f"{y}_events" for y in outcomes], *percent)


def effect_percentage_points(effects: DataFrame) -> DataFrame:
    require_scope(effects, "complete_source")
    point = lambda c: (F.lit(100.0) * F.col(c)).alias(f"{c}_pp")
    return effects.select(
        F.initcap("outcome").alias("outcome"),
        point("estimate"),
        point("standard_error"),
        point("ci_lower"),
        point("ci_upper"),
        "n_treated",
        "n_control",
    )


def estimator_scopes(effects: DataFrame, difference: DataFrame, values: DataFrame, outcome: str) -> DataFrame:
    """Whole-source effect, raw held-out difference and full-capacity value, per 100,000."""
    row = lambda quantity, sample, text, value: (
        F.lit(quantity).alias("quantity"), F.lit(sample).alias("sample_and_estimator"), text.alias("text"), value.alias("per_100k"),
    )
    interval = cell_text(F.col("estimate"), F.col("ci_lower"), F.col("ci_upper"), PER)
    scaled = F.col("estimate") * F.lit(PER)
    full = rows_at_capacity(values, outcome, 1.0).where("name = 'response'")
    raw = F.col("difference") * F.lit(PER)
    return (
        effects.where(F.col("outcome") == outcome)
        .select(*row("Average treatment effect", "Complete source, difference in means", interval, scaled))
        .unionByName(
            difference.where(F.col("outcome") == outcome).select(
                *row("Raw assignment difference", "Held-out test, difference in means",
                     F.format_string("%.1f (no interval reported)", raw), raw)
            )
        )
        .unionByName(full.select(*row("All-treatment policy value", "Held-out test, AIPW", interval, scaled)))
    )


def policy_value_pivot(values: DataFrame, outcome: str, capacities: Sequence[float] = CAPACITIES) -> DataFrame:
    """Capacities by policies, each cell ``value [low, high]`` per 100,000."""
    require_scope(values, "held_out_test")
    require_unique(values, ["outcome", "capacity", "name"])
    cells = values.where((F.col("outcome") == outcome) & F.col("capacity").isin(*[float(q) for q in capacities])).select(
        F.round(F.col("capacity") * F.lit(100.0), 6).alias("capacity_percent"),
        "name",
        cell_text(F.col("estimate"), F.col("ci_lower"), F.col("ci_upper"), PER).alias("cell"),
    )
    return cells.groupBy("capacity_percent").pivot("name", list(POLICY_LABELS)).agg(F.first("cell"))


def reversed_contrast(contrasts: DataFrame) -> DataFrame:
    """Swap the two sides: negate the estimate and exchange the interval ends."""
    return contrasts.select(
        "outcome",
        "capacity",
        F.concat_ws("_minus_", F.element_at(F.split("name", "_minus_"), 2), F.element_at(F.split("name", "_minus_"), 1)).alias("name"),
        (-F.col("estimate")).alias("estimate"),
        (-F.col("ci_upper")).alias("ci_lower"),
        (-F.col("ci_lower")).alias("ci_upper"),
    )


def response_contrast_pivot(contrasts: DataFrame, outcome: str) -> DataFrame:
    """Response targeting against random and both learners, per 100,000."""
    require_unique(contrasts, ["outcome", "capacity", "name"])
    kept = contrasts.where(F.col("outcome") == outcome)
    straight = kept.where("name = 'response_minus_random'").select(
        "outcome", "capacity", "name", "estimate", "ci_lower", "ci_upper"
    )
    turned = reversed_contrast(kept.where("name in ('t_learner_minus_response', 'dr_learner_minus_response')"))
    columns = ["response_minus_random", "response_minus_t_learner", "response_minus_dr_learner"]
    cells = straight.unionByName(turned).select(
        F.round(F.col("capacity") * F.lit(100.0), 6).alias("capacity_percent"),
        "name",
        cell_text(F.col("estimate"), F.col("ci_lower"), F.col("ci_upper"), PER).alias("cell"),
    )
    return cells.groupBy("capacity_percent").pivot("name", columns).agg(F.first("cell"))


def qini_report(coefficients: DataFrame, scale: float = 10_000.0) -> DataFrame:
    require_unique(coefficients, ["policy"])
    return coefficients.select(
        _order(F.col("policy"), POLICY_LABELS).alias("position"),
        "policy",
        (F.col("coefficient") * F.lit(scale)).alias("coefficient_scaled"),
    ).orderBy("position")


def model_report(metadata: DataFrame) -> DataFrame:
    """Selected rounds and validation loss of every model."""
    return metadata.select("model", "selected_rounds", F.round("validation_loss", 6).alias("validation_loss"))

"""Sample summaries, treatment effects, covariate balance and ROC area."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from trialquota.functions.scores import level_family, level_value, is_finite, nan_to_null, normal_quantile, standardized
from trialquota.operators.integrity import require_development_rows
from trialquota.operators.ranking import rank_rows
from trialquota.sources.staging import stage
from trialquota.spec import ExperimentSpec


def _tall(df: DataFrame, cells: list) -> DataFrame:
    return df.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def sample_summary(df: DataFrame, spec: ExperimentSpec, scope: str = "held_out_test") -> DataFrame:
    """Rows, events and event rate by arm and outcome, in one pass."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for arm in (0, 1):
        hit = F.col(spec.treatment) == arm
        aggs.append(F.count(F.when(hit, 1)).alias(f"n_{arm}"))
        aggs += [F.sum(F.when(hit, F.col(y).cast("bigint"))).alias(f"{y}_{arm}") for y in spec.outcomes]

    def cell(metric, group, value, quantity, unit):
        return F.struct(
            F.lit(metric).alias("metric"),
            F.lit(group).alias("group"),
            value.cast("double").alias("value"),
            F.lit(quantity).alias("quantity_type"),
            F.lit(unit).alias("unit"),
            F.lit(scope).alias("sample_scope"),
        )

    cells = [cell("test_rows", "all", F.col("n"), "sample_count", "rows")]
    for arm, group in ((0, "control"), (1, "treated")):
        cells.append(cell("rows", group, F.col(f"n_{arm}"), "sample_count", "rows"))
        for y in spec.outcomes:
            events = F.coalesce(F.col(f"{y}_{arm}"), F.lit(0))
            cells.append(cell(f"{y}_events", group, events, "sample_count", "events"))
            rate = F.try_divide(F.col(f"{y}_{arm}").cast("double"), F.col(f"n_{arm}").cast("double"))
            cells.append(cell(f"{y}_rate", group, rate, "sample_rate", "proportion"))
    return _tall(df.agg(*aggs), cells)


def raw_rate_difference(summary: DataFrame, outcome: str) -> DataFrame:
    """Treated minus control event rate from a sample summary."""
    rate = lambda group: F.max(F.when(F.col("group") == group, F.col("value")))
    return (
        summary.where(F.col("metric") == f"{outcome}_rate")
        .agg((rate("treated") - rate("control")).alias("difference"))
        .select(F.lit(outcome).alias("outcome"), "difference")
    )


def treatment_effects(
    df: DataFrame, outcomes: Sequence[str], treatment: str, confidence: float = 0.95
) -> DataFrame:
    """Difference in means with unpooled standard error for all outcomes, one pass.

    Arms and outcomes must be binary and each arm needs two rows; a violation
    raises when the result is computed.
    """
    z = normal_quantile(confidence)
    t = F.col(treatment)
    aggs = [F.count(F.when(t == 1, 1)).alias("n1"), F.count(F.when(t == 0, 1)).alias("n0")]
    binary = F.coalesce(t.isin(0, 1), F.lit(False))
    for y in outcomes:
        binary = binary & F.coalesce(F.col(y).isin(0, 1), F.lit(False))
        for arm in (0, 1):
            value = F.when(t == arm, F.col(y).cast("double"))
            aggs += [F.avg(value).alias(f"m{arm}_{y}"), F.var_samp(value).alias(f"v{arm}_{y}")]
    stats = df.agg(*aggs, F.coalesce(F.bool_and(binary), F.lit(False)).alias("binary"))
    usable = (F.col("n1") >= 2) & (F.col("n0") >= 2)
    problem = F.when(usable & ~F.col("binary"), F.lit("only 0 and 1 are allowed in outcome and treatment")).otherwise(
        F.lit("an arm with fewer than two rows has no variance")
    )

    def cell(y):
        estimate = F.col(f"m1_{y}") - F.col(f"m0_{y}")
        error = F.sqrt(F.col(f"v1_{y}") / F.col("n1") + F.col(f"v0_{y}") / F.col("n0"))
        checked = F.when(usable & F.col("binary"), estimate).otherwise(F.raise_error(problem).cast("double"))
        return F.struct(
            F.lit(y).alias("outcome"),
            checked.alias("estimate"),
            error.alias("standard_error"),
            (estimate - F.lit(z) * error).alias("ci_lower"),
            (estimate + F.lit(z) * error).alias("ci_upper"),
            F.col("n1").alias("n_treated"),
            F.col("n0").alias("n_control"),
        )

    # Guard the divisions too: with an empty arm the error must be the message above.
    safe = stats.withColumns({c: F.when(F.col(c) > 0, F.col(c)) for c in ("n1", "n0")})
    usable = F.coalesce(usable, F.lit(False))
    return _tall(safe, [cell(y) for y in outcomes])


def effect_table(df: DataFrame, spec: ExperimentSpec, confidence: float = 0.95) -> DataFrame:
    return treatment_effects(df, spec.outcomes, spec.treatment, confidence).select(
        "*",
        F.lit("average_treatment_effect").alias("quantity_type"),
        F.lit("probability_difference").alias("unit"),
        F.lit("complete_source").alias("sample_scope"),
    )


def continuous_balance(df: DataFrame, features: Sequence[str], treatment: str) -> DataFrame:
    """Mean difference over the pooled standard deviation, all features in one pass."""
    treated = F.col(treatment).eqNullSafe(1)
    aggs = []
    for f in features:
        for arm, hit in ((1, treated), (0, ~treated)):
            value = F.when(hit, nan_to_null(F.col(f)))
            aggs += [F.avg(value).alias(f"m{arm}_{f}"), F.var_samp(value).alias(f"v{arm}_{f}")]
    cells = []
    for f in features:
        scale = F.sqrt((F.col(f"v1_{f}") + F.col(f"v0_{f}")) / F.lit(2.0))
        cells.append(
            F.struct(
                F.lit(f).alias("feature"),
                F.lit("pooled_smd").alias("metric_type"),
                standardized(F.col(f"m1_{f}") - F.col(f"m0_{f}"), scale).alias("value"),
            )
        )
    return _tall(df.agg(*aggs), cells)


def level_balance(df: DataFrame, features: Sequence[str], treatment: str) -> DataFrame:
    """Arm shares and one-vs-rest difference of every category level.

    Levels are counted with a map-side combine; a level missing in an arm has
    share 0 there.  NULL and NaN are not levels.
    """
    kinds = dict(df.dtypes)
    families = {level_family(kinds[f]) for f in features}
    shown = families.pop() if len(families) == 1 else "string"
    level = lambda f: level_value(F.col(f), kinds[f]).cast(shown)
    counted = (
        df.select(F.col(treatment).eqNullSafe(1).alias("_t"), *[level(f).alias(f) for f in features])
        .unpivot(["_t"], list(features), "feature", "level")
        .where(F.col("level").isNotNull())
        .groupBy("feature", "level")
        .agg(F.count(F.when(F.col("_t"), 1)).alias("n1"), F.count(F.when(~F.col("_t"), 1)).alias("n0"))
    )
    counts = stage(counted, "level-counts")  # written so that rows are scanned once
    totals = counts.groupBy("feature").agg(F.sum("n1").alias("t1"), F.sum("n0").alias("t0"))
    # One row per feature name: bounded by the width of the table.
    shares = counts.join(F.broadcast(totals), "feature").select(
        "feature",
        "level",
        F.coalesce(F.try_divide("n1", "t1"), F.lit(0.0)).alias("p1"),
        F.coalesce(F.try_divide("n0", "t0"), F.lit(0.0)).alias("p0"),
    )
    p1, p0 = F.col("p1"), F.col("p0")
    scale = F.sqrt((p1 * (1.0 - p1) + p0 * (1.0 - p0)) / F.lit(2.0))
    return shares.withColumn("smd", standardized(p1 - p0, scale))


def categorical_balance(df: DataFrame, features: Sequence[str], treatment: str) -> DataFrame:
    """Largest absolute one-vs-rest difference over the levels of each feature."""
    return (
        level_balance(df, features, treatment)
        .groupBy("feature")
        .agg(F.max(F.abs("smd")).alias("value"))
        .select("feature", F.lit("max_abs_one_vs_rest_smd").alias("metric_type"), "value")
    )


def balance_table(development: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """One balance statistic per covariate, with absolute value, scope and unit."""
    require_development_rows(development)
    parts = []
    if spec.continuous:
        parts.append(continuous_balance(development, spec.continuous, spec.treatment))
    if spec.categorical:
        parts.append(categorical_balance(development, spec.categorical, spec.treatment))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.select(
        "feature",
        "metric_type",
        F.abs("value").alias("absolute_value"),
        "value",
        F.lit("train_and_validation").alias("sample_scope"),
        F.lit("standardized_mean_difference").alias("unit"),
    )


def roc_auc(df: DataFrame, score: str, label: str, tie_id: str = "row_id") -> DataFrame:
    """Exact area under the ROC curve; tied scores share their average rank.

    Ranks come from the distributed sort.  Tied rows sit next to each other in
    it, so most of each tie group combines before the shuffle, and the group
    carries only its smallest and largest rank.  Range partitioning reads its
    input twice, so costly scores should be staged first.
    """
    value = F.col(score).cast("double")
    checked = F.when(is_finite(value), value + F.lit(0.0)).otherwise(
        F.raise_error(F.lit("scores must be finite")).cast("double")
    )
    rows = df.select(F.col(tie_id).alias("_id"), checked.alias("_score"), F.col(label).cast("int").alias("_y"))
    ranked = rank_rows(rows, [], [F.col("_score").asc(), F.col("_id").asc()], label="roc").rows
    ties = ranked.groupBy("_score").agg(
        F.sum("_y").alias("_pos"),
        F.count(F.lit(1)).alias("_n"),
        F.min("rank").alias("_low"),
        F.max("rank").alias("_high"),
    )
    sums = ties.agg(
        F.sum(F.col("_pos") * (F.col("_low") + F.col("_high")) / F.lit(2.0)).alias("_ranks"),
        F.sum("_pos").cast("double").alias("positives"),
        F.sum(F.col("_n") - F.col("_pos")).cast("double").alias("negatives"),
    )
    pos, neg = F.col("positives"), F.col("negatives")
    return sums.select(
        F.try_divide(F.col("_ranks") - pos * (pos + 1.0) / F.lit(2.0), pos * neg).alias("auc"),
        pos.cast("bigint").alias("positives"),
        neg.cast("bigint").alias("negatives"),
    )


def audit_table(
    report: DataFrame, counts: DataFrame, balance: DataFrame, treatment_auc: DataFrame | None = None
) -> DataFrame:
    """Integrity checks, split sizes and randomization diagnostics, one row each."""
    text = F.lit
    is_count = F.col("metric") == "row_count"
    header = report.where(is_count).select(
        text("header_matches").alias("metric"), F.lit(1.0).alias("value"),
        text("integrity_check").alias("quantity_type"), text("boolean").alias("unit"),
        text("complete_source").alias("sample_scope"),
    )
    checks = report.select(
        "metric",
        "value",
        F.when(is_count, text("sample_count")).otherwise(text("integrity_check")).alias("quantity_type"),
        F.when(is_count, text("rows")).otherwise(text("boolean")).alias("unit"),
        text("complete_source").alias("sample_scope"),
    )
    splits = counts.select(
        F.concat("split", text("_rows")).alias("metric"),
        F.col("rows").cast("double").alias("value"),
        text("sample_count").alias("quantity_type"),
        text("rows").alias("unit"),
        F.col("split").alias("sample_scope"),
    )
    diagnostic = text("descriptive_randomization_diagnostic").alias("quantity_type")
    largest = balance.agg(F.max("absolute_value").alias("value")).select(
        text("maximum_absolute_smd").alias("metric"), "value", diagnostic,
        text("standardized_mean_difference").alias("unit"), text("train_and_validation").alias("sample_scope"),
    )
    table = header.unionByName(checks).unionByName(splits).unionByName(largest)
    if treatment_auc is not None:
        table = table.unionByName(
            treatment_auc.select(
                text("treatment_classifier_auc").alias("metric"), F.col("auc").alias("value"), diagnostic,
                text("auc").alias("unit"), text("train_to_validation").alias("sample_scope"),
            )
        )
    return table

"""Registered queries: every operator over the whole given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from checks import fixture as fx
from checks.fixture import EVENTS, FOLD_SEED, FOLDS, NUISANCE_STRATA, ORDERS
from trialquota.functions.hashing import derive_seed, with_splitmix64
from trialquota.functions.scores import transformed_outcome
from trialquota.operators import boosting, bootstrap, diagnostics, encoding, integrity, policy, qini, ranking
from trialquota.operators.nuisance import cross_fitted_scores, fit_cell_means
from trialquota.operators.splits import DRAW_PURPOSE, assign_fold, assign_split, select_rows, split_counts
from trialquota.plans import reports, workflows
from trialquota.sources import prepared, scan, tables
from trialquota.sources.staging import shared_dir, stage
from trialquota.spec import CAPACITIES, SCORE_POLICIES

BOOTSTRAP_SEED = 20260805
REPLICATES = 20
BLOCKED_REPLICATES = 1000
CONFIDENCE = 0.95
PSI = ["psi_conversion", "psi_visit"]
# Small trees, with enough rounds for the budget to double before patience ends the search.
SMALL_TREES = boosting.BoostingParams(max_rounds=16, patience=2, step=0.1, depth=3, min_rows=50, max_bins=32)
ORDER_STRATA = ("c_mktsegment", "o_orderpriority")


class Run:
    """Inputs several queries share, staged once per session and data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def folder(self, label: str) -> str:
        app = self.spark.sparkContext.applicationId
        return f"{shared_dir(self.spark)}/{app}/{label}-{uuid.uuid4().hex}"

    @cached_property
    def events(self) -> DataFrame:
        return fx.events_experiment(self.spark, self.sf_dir)

    @cached_property
    def split_events(self) -> DataFrame:
        return fx.split_events(self.spark, self.sf_dir)

    @cached_property
    def development(self) -> DataFrame:
        return fx.development(self.split_events)

    @cached_property
    def test(self) -> DataFrame:
        return fx.held_out(self.split_events)

    @cached_property
    def orders(self) -> DataFrame:
        return fx.orders_experiment(self.spark, self.sf_dir)

    @cached_property
    def split_orders(self) -> DataFrame:
        return assign_split(self.orders, ORDERS)

    @cached_property
    def scored(self) -> DataFrame:
        scored = fx.scored_events(self.spark, self.sf_dir)
        z = transformed_outcome(F.col("conversion"), F.col("treatment"), EVENTS.propensity)
        return stage(scored.withColumn("z", z), "scored")

    @cached_property
    def ranking(self) -> ranking.Ranking:
        return ranking.rank_policies(self.scored, SCORE_POLICIES, [*PSI, "z"], EVENTS.seed)

    @cached_property
    def values(self) -> DataFrame:
        return policy.policy_value_grid(self.ranking, EVENTS.outcomes, CAPACITIES)

    @cached_property
    def hashed(self) -> tuple[DataFrame, DataFrame]:
        summary, replicated = bootstrap.paired_bootstrap(
            self.scored, EVENTS.outcomes, CAPACITIES, replicates=REPLICATES, seed=BOOTSTRAP_SEED,
            tie_seed=EVENTS.seed, mode="hash",
        )
        return stage(summary, "summary"), replicated

    @cached_property
    def policy_tables(self) -> tuple[DataFrame, DataFrame]:
        return reports.policy_tables(self.hashed[0], self.ranking.n_rows)

    @cached_property
    def levels(self) -> DataFrame:
        return encoding.fit_category_levels(
            self.split_events.where("split = 'train'").select(*EVENTS.categorical, "split"), EVENTS.categorical
        )

    @cached_property
    def encoded_development(self) -> DataFrame:
        return encoding.apply_category_levels(self.development, self.levels, EVENTS.categorical)

    @cached_property
    def encoded_test(self) -> DataFrame:
        return encoding.apply_category_levels(
            self.test.select("row_id", *EVENTS.features), self.levels, EVENTS.categorical
        )

    @cached_property
    def bundle(self) -> boosting.ModelBundle:
        return boosting.fit_bundle(self.encoded_development, self.levels, EVENTS, SMALL_TREES)

    @cached_property
    def development_features(self) -> DataFrame:
        return boosting.feature_frame(self.encoded_development, self.levels, EVENTS, SMALL_TREES)

    @cached_property
    def training_features(self) -> DataFrame:
        rows = self.encoded_development
        return boosting.training_frame(rows, rows.where("split = 'train'"), self.levels, EVENTS, SMALL_TREES)

    @cached_property
    def paths(self) -> workflows.Paths:
        root = self.folder("jobs")
        return workflows.Paths(f"{root}/prepared", f"{root}/models", f"{root}/results")

    @cached_property
    def job_audit(self) -> DataFrame:
        return workflows.run_prepare(self.events, EVENTS, self.paths, SMALL_TREES)

    @cached_property
    def job_bundle(self) -> boosting.ModelBundle:
        self.job_audit
        return workflows.run_train(self.spark, EVENTS, self.paths, SMALL_TREES)

    @cached_property
    def job_tables(self) -> dict[str, DataFrame]:
        self.job_bundle
        return workflows.run_evaluate(self.spark, EVENTS, self.paths, SMALL_TREES, replicates=BLOCKED_REPLICATES)


_runs: dict[tuple[str, str], Run] = {}


def shared_run(spark: SparkSession, sf_dir: str) -> Run:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _runs:
        _runs[key] = Run(spark, sf_dir)
    return _runs[key]


def forget_runs() -> None:
    _runs.clear()


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Round every double, and turn negative zero into zero."""
    return df.select(
        *[(F.round(c, digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes]
    )


def as_long(df: DataFrame) -> DataFrame:
    """Widen integer columns so both engines report the same type."""
    small = {"tinyint", "smallint", "int"}
    return df.select(*[F.col(c).cast("bigint").alias(c) if kind in small else F.col(c) for c, kind in df.dtypes])


def share(column: str) -> Column:
    """Whether a probability lies strictly between zero and one."""
    return ((F.col(column) > 0) & (F.col(column) < 1)).alias(f"{column}_in_range")


def selected(metadata: DataFrame) -> DataFrame:
    """Model metadata with the fitted numbers replaced by whether they can be right."""
    return metadata.withColumns(
        {
            "selected_rounds": F.col("selected_rounds").between(1, SMALL_TREES.max_rounds),
            "validation_loss": F.col("validation_loss") > 0,
        }
    ).withColumnsRenamed({"selected_rounds": "rounds_in_range", "validation_loss": "loss_positive"})


# ---------------------------------------------------------------- sources


def s1_csv_scan(run: Run) -> DataFrame:
    path = run.folder("source-csv")
    ordered = run.events.orderBy("row_id").select(*EVENTS.source_columns)
    ordered.write.option("header", True).option("compression", "gzip").csv(path)
    return scan.scan_csv(run.spark, path, EVENTS)


def s2_csv_ordinal(run: Run) -> DataFrame:
    """Row ids over several plain CSV files written in row order."""
    path = run.folder("source-files")
    ordered = run.events.repartitionByRange(6, "row_id").sortWithinPartitions("row_id")
    ordered.select(*EVENTS.source_columns).write.option("header", True).csv(path)
    return scan.scan_csv(run.spark, path, EVENTS)


def s2_source_ordinal(run: Run) -> DataFrame:
    return scan.with_parquet_ordinal(fx.table(run.spark, run.sf_dir, "events")).select("row_id", "event_id")


def s3_prepared_write(run: Run) -> DataFrame:
    path = run.folder("prepared")
    prepared.write_prepared(run.split_events, path)
    return prepared.read_prepared(run.spark, path).select("row_id", *EVENTS.source_columns, "split")


def s4_prepared_read(run: Run) -> DataFrame:
    path = run.folder("prepared")
    prepared.write_prepared(run.split_events, path)
    columns = ["row_id", "f0", "treatment", "split"]
    return prepared.read_prepared(run.spark, path, ["train", "validation"], columns, ordered_by="row_id")


def s5_result_sink(run: Run) -> DataFrame:
    path = run.folder("results")
    tables.write_result(diagnostics.sample_summary(run.test, EVENTS), path, "sample_summary", "csv")
    return tables.read_result(run.spark, path, "sample_summary", "csv")


def s6_result_source(run: Run) -> DataFrame:
    path = run.folder("results")
    tables.write_result(diagnostics.sample_summary(run.test, EVENTS), path, "sample_summary")
    tables.write_result(diagnostics.effect_table(run.events, EVENTS), path, "average_treatment_effects")
    tables.register_results(run.spark, path, names=("sample_summary", "average_treatment_effects"))
    return run.spark.sql(
        "SELECT e.outcome, e.estimate, s.value AS treated_rate FROM average_treatment_effects e "
        "JOIN sample_summary s ON s.metric = concat(e.outcome, '_rate') AND s.`group` = 'treated'"
    )


# ------------------------------------------------------------- validation


def v1_header(run: Run) -> DataFrame:
    path = run.folder("source-csv")
    run.events.select(*EVENTS.source_columns).write.option("header", True).csv(path)
    header = scan.check_header(run.spark, path, EVENTS)
    scanned = run.spark.read.option("header", True).csv(path)
    names = F.array(*[F.lit(c) for c in header])
    counts = scanned.agg(*[F.count(c).alias(c) for c in header])
    filled = F.array(*[F.col(c) for c in header])
    return counts.select(F.posexplode(F.arrays_zip(names.alias("n"), filled.alias("v"))).alias("position", "c")).select(
        "position", F.col("c.n").alias("name"), F.col("c.v").alias("filled_rows")
    )


def v2_features_finite(run: Run) -> DataFrame:
    return integrity.integrity_report(run.events, EVENTS).where("metric = 'features_finite'")


def v3_binary_domains(run: Run) -> DataFrame:
    return integrity.integrity_report(run.events, EVENTS).where("metric = 'binary_domains_valid'")


def v4_control_unexposed(run: Run) -> DataFrame:
    return integrity.integrity_report(run.events, EVENTS).where("metric = 'control_has_no_exposure'")


def v5_conversion_implies_visit(run: Run) -> DataFrame:
    return integrity.integrity_report(run.events, EVENTS).where("metric = 'conversion_implies_visit'")


def v6_integrity(run: Run) -> DataFrame:
    return integrity.integrity_report(run.events, EVENTS)


def v6_integrity_orders(run: Run) -> DataFrame:
    return integrity.integrity_report(run.orders, ORDERS)


def v7_row_count(run: Run) -> DataFrame:
    events = fx.table(run.spark, run.sf_dir, "events")
    expected = events.agg((F.max("event_id") + 1).alias("n")).first().n
    return integrity.row_count_check(events, expected)


def v8_reconcile(run: Run) -> DataFrame:
    return integrity.reconcile_splits(split_counts(run.split_events), run.events.count())


def v9_leakage_guards(run: Run) -> DataFrame:
    """Each guard is asked to accept clean rows and to refuse rows that leak."""
    attempts = [
        ("development_rows", lambda: integrity.require_development_rows(run.development), False),
        ("development_rows", lambda: integrity.require_development_rows(run.split_events), True),
        ("train_levels", lambda: integrity.require_train_rows(run.split_events.where("split = 'train'")), False),
        ("train_levels", lambda: integrity.require_train_rows(run.development), True),
        ("model_rows", lambda: integrity.require_train_and_validation(run.development), False),
        ("model_rows", lambda: integrity.require_train_and_validation(run.split_events), True),
        ("feature_only", lambda: integrity.require_feature_only(run.test.select("row_id", *EVENTS.features), EVENTS), False),
        ("feature_only", lambda: integrity.require_feature_only(run.test, EVENTS), True),
    ]
    outcome = []
    for guard, attempt, leaks in attempts:
        try:
            attempt()
            raised = False
        except ValueError:
            raised = True
        outcome.append((guard, leaks, raised))
    return run.spark.createDataFrame(outcome, "guard string, input_leaks boolean, refused boolean")


def v10_alignment(run: Run) -> DataFrame:
    return integrity.alignment(run.test.select("row_id"), run.split_events.where("visit = 1").select("row_id"))


def v11_duplicate_keys(run: Run) -> DataFrame:
    lines = fx.table(run.spark, run.sf_dir, "lineitem")
    return integrity.duplicate_keys(lines, ["l_orderkey", "l_linenumber"])


def v12_sample_scopes(run: Run) -> DataFrame:
    summary = diagnostics.sample_summary(run.test, EVENTS).select("sample_scope")
    return integrity.sample_scopes(summary.unionByName(diagnostics.effect_table(run.events, EVENTS).select("sample_scope")))


# --------------------------------------------------------- hashing, splits


def h1_split(run: Run) -> DataFrame:
    return run.split_events.select("row_id", "split")


def h2_tie_key(run: Run) -> DataFrame:
    keyed = with_splitmix64(run.events.select("row_id"), "key", "row_id", EVENTS.seed)
    return keyed.select(
        "row_id",
        F.shiftrightunsigned("key", 32).alias("key_high"),
        F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).alias("key_low"),
    )


def h3_fold(run: Run) -> DataFrame:
    return assign_fold(run.orders.select("row_id"), "row_id", FOLDS, FOLD_SEED)


def h4_row_selection(run: Run) -> DataFrame:
    folded = assign_fold(run.split_events, "row_id", FOLDS, FOLD_SEED)
    parts = [
        select_rows(folded, ["train"], arm, fold, hold_out=True).agg(
            F.lit(arm).alias("arm"), F.lit(fold).alias("fold"), F.count(F.lit(1)).alias("rows"),
            F.sum("conversion").alias("conversions"),
        )
        for arm in (0, 1)
        for fold in range(FOLDS)
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


# ------------------------------------------------------------ categorical


def e1_category_levels(run: Run) -> DataFrame:
    return run.levels


def e1_category_levels_orders(run: Run) -> DataFrame:
    train = run.split_orders.where("split = 'train'").select(*ORDERS.categorical, "split")
    return encoding.fit_category_levels(train, ORDERS.categorical)


def e2_encode(run: Run) -> DataFrame:
    """Levels of all train rows; held-out rows also hold users that train has never seen."""
    events = fx.table(run.spark, run.sf_dir, "events").select(F.col("event_id").alias("row_id"), "user_id")
    users = assign_split(events, EVENTS)
    levels = encoding.fit_category_levels(users.where("split = 'train'").select("user_id", "split"), ["user_id"])
    return encoding.apply_category_levels(users.where("split = 'test'").select("row_id", "user_id"), levels, ["user_id"])


def e3_cardinality(run: Run) -> DataFrame:
    return encoding.level_counts(run.levels)


def e4_feature_vector(run: Run) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    parts = vector_to_array("features")
    return run.development_features.select("row_id", *[parts[i].alias(f"x{i}") for i in range(len(EVENTS.features))])


# ------------------------------------------------------------ diagnostics


def a1_split_counts(run: Run) -> DataFrame:
    return split_counts(run.split_events)


def a2_sample_summary(run: Run) -> DataFrame:
    return diagnostics.sample_summary(run.test, EVENTS)


def a3_treatment_effect(run: Run) -> DataFrame:
    return diagnostics.treatment_effects(run.orders, ORDERS.outcomes[:1], ORDERS.treatment, 0.9)


def a4_effect_table(run: Run) -> DataFrame:
    return diagnostics.effect_table(run.events, EVENTS)


def a5_continuous_balance(run: Run) -> DataFrame:
    return diagnostics.continuous_balance(fx.development(run.split_orders), ORDERS.continuous, ORDERS.treatment)


def a6_categorical_balance(run: Run) -> DataFrame:
    return diagnostics.categorical_balance(fx.development(run.split_orders), ORDERS.categorical, ORDERS.treatment)


def a6_level_balance(run: Run) -> DataFrame:
    return diagnostics.level_balance(fx.development(run.split_orders), ORDERS.categorical, ORDERS.treatment)


def a7_standardized_difference(run: Run) -> DataFrame:
    """Conversion difference over its deviation per level of f1, with zero scales and differences put in by level."""
    from trialquota.functions.scores import standardized

    stats = run.events.groupBy("f1").agg(
        F.avg(F.when(F.col("treatment") == 1, F.col("conversion").cast("double"))).alias("m1"),
        F.avg(F.when(F.col("treatment") == 0, F.col("conversion").cast("double"))).alias("m0"),
        F.var_samp(F.when(F.col("treatment") == 1, F.col("conversion").cast("double"))).alias("v1"),
    )
    scale = F.when(F.col("f1") % 3 == 0, F.lit(0.0)).otherwise(F.sqrt("v1"))
    difference = F.when(F.col("f1") % 6 == 0, F.lit(0.0)).otherwise(F.col("m1") - F.col("m0"))
    value = standardized(difference, scale)
    kind = F.when(value == float("inf"), "positive_infinity").when(value == float("-inf"), "negative_infinity")
    finite = F.when(F.abs(value) < float("inf"), value)
    return stats.select("f1", kind.alias("kind"), finite.alias("smd"))


def a8_balance_table(run: Run) -> DataFrame:
    return diagnostics.balance_table(run.development, EVENTS)


def a9_treatment_auc(run: Run) -> DataFrame:
    rows = run.encoded_development
    area = boosting.treatment_auc(
        rows.where("split = 'train'"), rows.where("split = 'validation'"), EVENTS, run.levels, SMALL_TREES
    )
    return area.select("positives", "negatives", share("auc"))


def a10_roc_auc(run: Run) -> DataFrame:
    return diagnostics.roc_auc(run.scored, "response", "conversion")


def a10_roc_auc_continuous(run: Run) -> DataFrame:
    return diagnostics.roc_auc(run.orders, "o_totalprice", "conversion")


def a11_audit_table(run: Run) -> DataFrame:
    return diagnostics.audit_table(
        integrity.integrity_report(run.events, EVENTS),
        split_counts(run.split_events),
        diagnostics.balance_table(run.development, EVENTS),
    )


def a12_raw_difference(run: Run) -> DataFrame:
    return diagnostics.raw_rate_difference(diagnostics.sample_summary(run.test, EVENTS), "conversion")


# ----------------------------------------------------------------- models


def m1_select_rounds(run: Run) -> DataFrame:
    rows = run.training_features
    arm = rows.where("treatment = 1")
    rounds, loss = boosting.select_rounds(
        arm.where("split = 'train'"), arm.where("split = 'validation'"), "conversion", "classifier", SMALL_TREES
    )
    found = run.spark.createDataFrame([("conversion_m1", rounds, loss)], "model string, selected_rounds int, validation_loss double")
    return selected(found)


def m2_fixed_rounds(run: Run) -> DataFrame:
    rows = run.training_features
    model = boosting.fit_rounds(rows.where("treatment = 1"), "conversion", "classifier", 3, SMALL_TREES)
    scored = boosting.predict(model, rows, "mu1").select(share("mu1"))
    return scored.agg(
        F.lit(model.getNumTrees).alias("trees"), F.count(F.lit(1)).alias("rows"), F.bool_and("mu1_in_range").alias("all_in_range")
    )


def m3_predict(run: Run) -> DataFrame:
    features = boosting.feature_frame(run.encoded_test, run.levels, EVENTS, SMALL_TREES)
    return boosting.predict(run.bundle.models["visit_m1"], features, "mu1_visit").select("row_id", share("mu1_visit"))


def m4_response_surfaces(run: Run) -> DataFrame:
    return selected(run.bundle.metadata.where("model <> 'dr_learner'").select("model", "selected_rounds", "validation_loss"))


def m5_cross_fit(run: Run) -> DataFrame:
    scored = cross_fitted_scores(
        run.development, NUISANCE_STRATA, "conversion", "treatment", EVENTS.propensity, FOLDS, FOLD_SEED
    )
    return scored.select("row_id", "fold", "pseudo")


def m5_cross_fit_trees(run: Run) -> DataFrame:
    rounds = {"conversion_m0": 2, "conversion_m1": 2}
    rows = run.training_features.select("row_id", "features", "treatment", "conversion")
    scored = boosting.cross_fitted_pseudo(rows, "conversion", "treatment", EVENTS.propensity, rounds, SMALL_TREES)
    # |psi| is at most 1 + 1 / (1 - propensity) for predictions and outcomes within [0, 1].
    bound = 1.0 + 1.0 / (1.0 - EVENTS.propensity)
    return scored.select("row_id", "fold", (F.abs("pseudo") <= bound).alias("pseudo_in_range"))


def m6_second_stage(run: Run) -> DataFrame:
    return selected(run.bundle.metadata.where("model = 'dr_learner'").select("model", "selected_rounds", "validation_loss"))


def m7_final_refit(run: Run) -> DataFrame:
    rows = [(name, model.getNumTrees) for name, model in run.bundle.models.items()]
    fitted = run.spark.createDataFrame(rows, "model string, trees int")
    joined = fitted.join(run.bundle.metadata, "model")
    return joined.select("model", (F.col("trees") == F.col("selected_rounds")).alias("trees_match"), "development_rows")


def m8_nuisance_prediction(run: Run) -> DataFrame:
    features = boosting.feature_frame(run.encoded_test, run.levels, EVENTS, SMALL_TREES)
    return run.bundle.predict_nuisance(features, "visit").select("row_id", share("mu0_visit"), share("mu1_visit"))


def m9_policy_scores(run: Run) -> DataFrame:
    return run.scored.select("row_id", *SCORE_POLICIES)


def m9_policy_scores_trees(run: Run) -> DataFrame:
    scored = run.bundle.score(run.encoded_test, EVENTS)
    gap = F.abs(F.col("t_learner") - (F.col("mu1_conversion") - F.col("mu0_conversion")))
    return scored.select("row_id", share("response"), (gap < 1e-12).alias("t_learner_is_difference"), F.col("dr_learner").isNotNull().alias("dr_scored"))


def m10_bundle_metadata(run: Run) -> DataFrame:
    return selected(run.bundle.metadata)


def m11_cell_means(run: Run) -> DataFrame:
    return fit_cell_means(run.development, NUISANCE_STRATA, EVENTS.outcomes).cells


def m11_cell_predictions(run: Run) -> DataFrame:
    dev = fx.development(run.split_orders)
    model = fit_cell_means(dev, ORDER_STRATA, ORDERS.outcomes)
    return model.transform(fx.held_out(run.split_orders)).select(
        "row_id", "mu0_conversion", "mu1_conversion", "mu0_visit", "mu1_visit"
    )


def s7_bundle_round_trip(run: Run) -> DataFrame:
    path = run.folder("bundle")
    boosting.save_bundle(run.bundle, path)
    loaded = boosting.load_bundle(run.spark, path, EVENTS, SMALL_TREES)
    before = run.bundle.score(run.encoded_test, EVENTS).select("row_id", F.col("dr_learner").alias("saved"))
    after = loaded.score(run.encoded_test, EVENTS).select("row_id", F.col("dr_learner").alias("loaded"))
    return before.join(after, "row_id").agg(
        F.count(F.lit(1)).alias("rows"), F.max(F.abs(F.col("saved") - F.col("loaded"))).alias("largest_gap")
    )


# ----------------------------------------------------------------- policy


def p1_aipw(run: Run) -> DataFrame:
    return run.scored.select("row_id", "psi_conversion")


def p2_aipw_outcomes(run: Run) -> DataFrame:
    return run.scored.select("row_id", *PSI)


def p3_policy_order(run: Run) -> DataFrame:
    return run.ranking.rows.select("policy", "row_id", "rank")


def p4_capacity_count(run: Run) -> DataFrame:
    return policy.capacity_table(run.test, CAPACITIES)


def p5_membership(run: Run) -> DataFrame:
    return policy.top_k_membership(run.ranking, 0.2).where("selected").select("policy", "row_id")


def p6_policy_value(run: Run) -> DataFrame:
    return run.values.where("policy <> 'random' AND outcome = 'conversion'")


def p7_random_value(run: Run) -> DataFrame:
    return policy.expected_random_values(run.scored, EVENTS.outcomes, CAPACITIES, run.ranking.n_rows)


def p8_contrasts(run: Run) -> DataFrame:
    return policy.policy_contrasts(run.values)


def p9_full_capacity(run: Run) -> DataFrame:
    return policy.full_capacity_gap(run.values)


def p10_value_grid(run: Run) -> DataFrame:
    return run.values


# ------------------------------------------------------------------- Qini


def q1_transformed_outcome(run: Run) -> DataFrame:
    z = transformed_outcome(F.col("conversion"), F.col("treatment"), EVENTS.propensity)
    return run.events.select("row_id", z.alias("z"))


def q2_gain_curve(run: Run) -> DataFrame:
    return qini.qini_curve(run.ranking).select("policy", "position", "fraction", "cumulative_gain")


def q3_centered_curve(run: Run) -> DataFrame:
    return qini.qini_curve(run.ranking).select("policy", "position", "centered_qini")


def q4_coefficient(run: Run) -> DataFrame:
    return qini.qini_coefficients(run.ranking)


def q5_display_curve(run: Run) -> DataFrame:
    return qini.qini_display(run.ranking)


def q6_coefficient_table(run: Run) -> DataFrame:
    return qini.qini_tables(run.ranking)[0]


def q6_curve_table(run: Run) -> DataFrame:
    return qini.qini_tables(run.ranking)[1]


# -------------------------------------------------------------- bootstrap


def b1_draw_counts(run: Run) -> DataFrame:
    seed = derive_seed(BOOTSTRAP_SEED, DRAW_PURPOSE)
    return bootstrap.hash_draw_counts(run.spark, run.test.count(), REPLICATES, seed)


def b2_weighted_top_k(run: Run) -> DataFrame:
    """Order lines as copies of their order, ranked by price."""
    orders = fx.table(run.spark, run.sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    lines = fx.table(run.spark, run.sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("copies"))
    ranked = ranking.rank_rows(
        orders, ["o_orderstatus"], [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()], label="orders"
    )
    weighted = ranked.rows.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn(
        "copies", F.coalesce("copies", F.lit(0))
    )
    width = bootstrap.block_width(ranked.sizes.agg(F.max("n_rows")).first()[0])
    top, _ = bootstrap.weighted_top_k(weighted, ["o_orderstatus"], ["o_totalprice"], [0, 1, 10, 100, 500], width)
    return top.select("o_orderstatus", "k", F.round("top_o_totalprice", 2).alias("top_price"))


def b3_replicate_values(run: Run) -> DataFrame:
    return run.hashed[1]


#: The blocked standard error must lie within this factor of the hash run's (20 replicates vary by about 16%).
ERROR_FACTOR = 3.0


def b3_blocked_bootstrap(run: Run) -> DataFrame:
    summary, _ = bootstrap.paired_bootstrap(
        run.scored, EVENTS.outcomes, CAPACITIES, replicates=BLOCKED_REPLICATES, seed=BOOTSTRAP_SEED,
        tie_seed=EVENTS.seed, ranking=run.ranking,
    )
    keys = ["outcome", "capacity", "estimand_type", "name"]
    hashed = run.hashed[0].select(*keys, F.col("bootstrap_standard_error").alias("_hash_error"))
    error, reference = F.col("bootstrap_standard_error"), F.col("_hash_error")
    # Where two policies choose the same rows in every hash replicate the contrast never varies:
    # its error is zero in both runs.  Elsewhere both estimate one spread.
    same_rows = F.abs(reference) < 1e-9
    near = (error * ERROR_FACTOR >= reference) & (error <= reference * ERROR_FACTOR)
    return summary.join(hashed, keys).select(
        "outcome", "capacity", "estimand_type", "name", "estimate", "bootstrap_replicates",
        (F.col("ci_lower") <= F.col("ci_upper")).alias("interval_ordered"),
        F.when(same_rows, F.abs(error) < 1e-9).otherwise(near).alias("error_plausible"),
    )


def b4_replicate_contrasts(run: Run) -> DataFrame:
    return policy.policy_contrasts(run.hashed[1], ["replicate", "outcome", "capacity"])


def b5_standard_errors(run: Run) -> DataFrame:
    values = run.hashed[0].where("estimand_type = 'policy_value'")
    return values.select("outcome", "capacity", F.col("name").alias("policy"), "bootstrap_standard_error")


def b6_percentile_interval(run: Run) -> DataFrame:
    return bootstrap.percentile_interval(run.hashed[1], ["outcome", "capacity", "policy"], CONFIDENCE)


def b7_summary(run: Run) -> DataFrame:
    return run.hashed[0]


def b8_replicate_table(run: Run) -> DataFrame:
    return stage(run.hashed[1], "kept-replicates")


# ---------------------------------------------------------------- reports


def r1_policy_values(run: Run) -> DataFrame:
    return run.policy_tables[0]


def r1_policy_contrasts(run: Run) -> DataFrame:
    return run.policy_tables[1]


def r2_rows_at_capacity(run: Run) -> DataFrame:
    return reports.rows_at_capacity(run.policy_tables[0], "visit", 0.2).select("name", "capacity", "estimate")


def r3_policy_view(run: Run) -> DataFrame:
    return reports.policy_view(run.policy_tables[0], "conversion", 0.1)


def r4_contrast_view(run: Run) -> DataFrame:
    return reports.contrast_view(run.policy_tables[1], "conversion", 0.1)


def r5_best_rules(run: Run) -> DataFrame:
    return reports.best_rules(run.policy_tables[0])


def r6_sample_table(run: Run) -> DataFrame:
    return reports.sample_table(diagnostics.sample_summary(run.test, EVENTS), EVENTS.outcomes)


def r7_effect_points(run: Run) -> DataFrame:
    return reports.effect_percentage_points(diagnostics.effect_table(run.events, EVENTS))


def r8_estimator_scopes(run: Run) -> DataFrame:
    difference = diagnostics.raw_rate_difference(diagnostics.sample_summary(run.test, EVENTS), "conversion")
    return reports.estimator_scopes(
        diagnostics.effect_table(run.events, EVENTS), difference, run.policy_tables[0], "conversion"
    )


def r9_policy_pivot(run: Run) -> DataFrame:
    return reports.policy_value_pivot(run.policy_tables[0], "conversion")


def r10_reversed_contrasts(run: Run) -> DataFrame:
    return reports.reversed_contrast(run.policy_tables[1])


def r10_response_pivot(run: Run) -> DataFrame:
    return reports.response_contrast_pivot(run.policy_tables[1], "visit")


def r11_qini_report(run: Run) -> DataFrame:
    return reports.qini_report(qini.qini_coefficients(run.ranking))


def r12_model_report(run: Run) -> DataFrame:
    return selected(reports.model_report(run.bundle.metadata))


# -------------------------------------------------------------- workflows


def w1_prepare(run: Run) -> DataFrame:
    """The audit; the area under the curve of the fitted classifier is shown as whether it can be right."""
    area = F.col("metric") == "treatment_classifier_auc"
    value = F.when(area, F.col("value").between(0, 1).cast("double")).otherwise(F.col("value"))
    return run.job_audit.withColumn("value", value)


def w2_train(run: Run) -> DataFrame:
    return selected(run.job_bundle.metadata)


def w3_evaluate(run: Run) -> DataFrame:
    """All six tables: values where no fitted tree is involved, else the number of numbers under each key."""
    tables = run.job_tables
    exact = {
        "sample_summary": (["metric", "group"], "value"),
        "average_treatment_effects": (["outcome"], "estimate"),
    }
    counted = {
        "policy_values": (["outcome", "name"], "estimate"),
        "policy_contrasts": (["outcome", "name"], "estimate"),
        "qini_coefficients": (["policy"], "coefficient"),
        "qini_curves": (["policy"], "centered_qini"),
    }
    parts = [
        tables[name].select(F.lit(name).alias("table"), F.concat_ws("|", *keys).alias("key"), F.col(value).cast("double").alias("value"))
        for name, (keys, value) in exact.items()
    ] + [
        tables[name].groupBy(*keys).agg(F.count(value).cast("double").alias("value"))
        .select(F.lit(name).alias("table"), F.concat_ws("|", *keys).alias("key"), "value")
        for name, (keys, value) in counted.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


QUERIES: tuple[Callable[[Run], DataFrame], ...] = (
    s1_csv_scan, s2_csv_ordinal, s2_source_ordinal, s3_prepared_write, s4_prepared_read, s5_result_sink, s6_result_source,
    s7_bundle_round_trip,
    v1_header, v2_features_finite, v3_binary_domains, v4_control_unexposed, v5_conversion_implies_visit,
    v6_integrity, v6_integrity_orders, v7_row_count, v8_reconcile, v9_leakage_guards, v10_alignment,
    v11_duplicate_keys, v12_sample_scopes,
    h1_split, h2_tie_key, h3_fold, h4_row_selection,
    e1_category_levels, e1_category_levels_orders, e2_encode, e3_cardinality, e4_feature_vector,
    a1_split_counts, a2_sample_summary, a3_treatment_effect, a4_effect_table, a5_continuous_balance,
    a6_categorical_balance, a6_level_balance, a7_standardized_difference, a8_balance_table, a9_treatment_auc,
    a10_roc_auc, a10_roc_auc_continuous, a11_audit_table, a12_raw_difference,
    m1_select_rounds, m2_fixed_rounds, m3_predict, m4_response_surfaces, m5_cross_fit, m5_cross_fit_trees,
    m6_second_stage, m7_final_refit, m8_nuisance_prediction, m9_policy_scores, m9_policy_scores_trees,
    m10_bundle_metadata, m11_cell_means, m11_cell_predictions,
    p1_aipw, p2_aipw_outcomes, p3_policy_order, p4_capacity_count, p5_membership, p6_policy_value, p7_random_value,
    p8_contrasts, p9_full_capacity, p10_value_grid,
    q1_transformed_outcome, q2_gain_curve, q3_centered_curve, q4_coefficient, q5_display_curve,
    q6_coefficient_table, q6_curve_table,
    b1_draw_counts, b2_weighted_top_k, b3_replicate_values, b3_blocked_bootstrap, b4_replicate_contrasts,
    b5_standard_errors, b6_percentile_interval, b7_summary, b8_replicate_table,
    r1_policy_values, r1_policy_contrasts, r2_rows_at_capacity, r3_policy_view, r4_contrast_view, r5_best_rules,
    r6_sample_table, r7_effect_points, r8_estimator_scopes, r9_policy_pivot, r10_reversed_contrasts,
    r10_response_pivot, r11_qini_report, r12_model_report,
    w1_prepare, w2_train, w3_evaluate,
)


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(query: Callable[[Run], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: rounded(as_long(query(shared_run(spark, sf_dir))))

    return {query.__name__: bind(query) for query in QUERIES}

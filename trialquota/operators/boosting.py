"""Boosted-tree outcome models and the cross-fitted doubly robust learner.

Trees come from Spark ML, so every fit is a distributed job.  Independent fits
are submitted from a few driver threads so that small arms do not leave the
cluster idle.

A tree learner sees a row only through its bins and its label, and reads all
rows again at every level of every round.  Rows are therefore binned once and
each fit first counts its rows per cell (binned features and label): the passes
run over weighted cells, whose number the bins bound, not over rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, replace
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F

from trialquota.functions.scores import aipw_score, is_finite
from trialquota.operators.diagnostics import roc_auc
from trialquota.operators.encoding import feature_vector, level_counts, nominal_values
from trialquota.operators.integrity import (
    require_development_rows,
    require_feature_only,
    require_pre_treatment,
    require_train_and_validation,
)
from trialquota.operators.policy import with_policy_scores
from trialquota.operators.splits import assign_fold
from trialquota.sources.staging import stage
from trialquota.spec import ExperimentSpec

CELLS_PER_TASK = 50_000


@dataclass(frozen=True)
class BoostingParams:
    """Tree settings; the defaults suit a cluster, tests pass smaller ones."""

    max_rounds: int = 2000
    patience: int = 50
    step: float = 0.05
    depth: int = 5
    min_rows: int = 1000
    max_bins: int = 255
    seed: int = 20260803
    folds: int = 3
    fold_seed: int = 20260804
    parallelism: int = 4


def feature_frame(df: DataFrame, levels: DataFrame, spec: ExperimentSpec, params: BoostingParams) -> DataFrame:
    """Add ``features`` to encoded rows, in declared feature order."""
    sizes = {row.feature: row.cardinality for row in level_counts(levels).collect()}
    return feature_vector(df, spec.continuous, spec.categorical, sizes)


def bin_values(df: DataFrame, continuous: Sequence[str], bins: int) -> dict[str, list[float]]:
    """Up to ``bins`` values (quantiles) of each feature that has more distinct values than that."""
    shares = [i / (bins - 1) for i in range(bins)] if bins > 1 else [0.5]
    if not continuous:
        return {}
    aggs = []
    for f in continuous:
        value = F.col(f).cast("double")
        value = F.when(is_finite(value), value + F.lit(0.0))
        aggs.append(F.approx_count_distinct(value, 0.01).alias(f"n_{f}"))
        aggs.append(F.percentile_approx(value, shares, max(10_000, 100 * bins)).alias(f"q_{f}"))
    found = df.agg(*aggs).first()
    chosen = {}
    for f in continuous:
        if found[f"n_{f}"] <= bins:
            continue
        values, edge = [], -math.inf
        for value in found[f"q_{f}"]:
            middle = (values[-1] + value) / 2.0 if values else -math.inf
            if not values or (edge < middle < value and values[-1] <= middle):
                values.append(value)
                edge = middle
        chosen[f] = values
    return chosen


def binned(df: DataFrame, values: dict[str, list[float]]) -> DataFrame:
    """Replace each feature by the nearest of its values, the lower one halfway.

    A tree learner splits halfway between values it sees, so a tree fitted on
    binned rows sends an unbinned row where its binned form went.
    """
    for f, known in values.items():
        # Buckets are closed below; negated, closed above, as "at most the threshold" is.
        edges = [-(a + b) / 2.0 for a, b in zip(known, known[1:])][::-1]
        value = F.col(f).cast("double")
        cut = Bucketizer(splits=[-math.inf, *edges, math.inf], inputCol="_negated", outputCol="_bin", handleInvalid="keep")
        placed = cut.transform(df.withColumn("_negated", -value)) if edges else df.withColumns({"_negated": -value, "_bin": F.lit(0)})
        nearest = F.get(F.array(*[F.lit(v) for v in known[::-1]]), F.col("_bin").cast("int"))
        df = placed.withColumn(f, F.when(is_finite(value), nearest).otherwise(value)).drop("_negated", "_bin")
    return df


def training_frame(
    df: DataFrame, train: DataFrame, levels: DataFrame, spec: ExperimentSpec, params: BoostingParams
) -> DataFrame:
    """``feature_frame`` of rows binned at the quantiles of the training rows."""
    return feature_frame(binned(df, bin_values(train, spec.continuous, params.max_bins)), levels, spec, params)


def cells(df: DataFrame, label: str) -> DataFrame:
    """Rows counted per feature vector and label: ``features``, the label and ``_weight``."""
    value = F.col(label).cast("double").alias(label)
    return df.groupBy("features", value).agg(F.count(F.lit(1)).cast("double").alias("_weight"))


def _learner(kind: str, label: str, rounds: int, params: BoostingParams, bins: int, rows: float):
    # Spark ML counts cells for its minimum of instances, so the minimum of rows is one of weight, a share below a half.
    halves = bool(rows) and 2 * params.min_rows <= rows
    smallest = (params.min_rows - 0.5) / rows if halves else 0.0
    shared = dict(
        featuresCol="features", labelCol=label, weightCol="_weight", maxIter=rounds, stepSize=params.step,
        maxDepth=params.depth, minInstancesPerNode=1 if halves else (1 << 31) - 1,
        minWeightFractionPerNode=max(smallest, 0.0), maxBins=bins,
        subsamplingRate=1.0, featureSubsetStrategy="all", seed=params.seed,
    )
    return GBTClassifier(lossType="logistic", **shared) if kind == "classifier" else GBTRegressor(lossType="squared", **shared)


def best_round(losses: Sequence[float], patience: int) -> int:
    """Round of the lowest loss before ``patience`` rounds pass without a new low."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def _fit_cells(counted: DataFrame, label: str, kind: str, rounds: int, params: BoostingParams):
    """Fit on persisted cells."""
    bins = max(params.max_bins, nominal_values(counted))
    size = counted.agg(F.count(F.lit(1)).alias("cells"), F.sum("_weight").alias("rows")).first()
    if 0 < size.cells < bins <= (size.rows or 0):
        # Spark ML allows no more bins than instances: share each cell out over several.
        copies = math.ceil(bins / size.cells)
        counted = counted.withColumn("_weight", F.explode(F.array_repeat(F.col("_weight") / copies, copies)))
    # A round is several short jobs: few cells in many tasks would mostly start tasks.
    counted = counted.coalesce(math.ceil(size.cells / CELLS_PER_TASK) or 1)
    return _learner(kind, label, rounds, params, bins, size.rows).fit(counted)


def fit_rounds(df: DataFrame, label: str, kind: str, rounds: int, params: BoostingParams):
    """Fit exactly ``rounds`` trees, with a bin for every category."""
    counted = cells(df, label).persist()
    model = _fit_cells(counted, label, kind, rounds, params)
    counted.unpersist()
    return model


def select_rounds(
    train: DataFrame, validation: DataFrame, label: str, kind: str, params: BoostingParams
) -> tuple[int, float]:
    """Rounds and validation loss (log loss, or mean squared error) chosen by early stopping."""
    return _select(train, validation, label, kind, params, refit=False)[:2]


def _select(
    train: DataFrame, validation: DataFrame, label: str, kind: str, params: BoostingParams, refit: bool = True
) -> tuple:
    """Rounds, loss, and (with ``refit``) the model of just these rounds on the training rows.

    Rounds grow by doubling, so a learner that stops early never pays for the
    full budget; refitting with the same seed repeats the same first trees.
    """
    held = cells(validation, label).persist()
    counted = cells(train, label).persist()
    rounds = min(params.max_rounds, max(2 * params.patience, 8))
    while True:
        model = _fit_cells(counted, label, kind, rounds, params)
        losses = list(model.evaluateEachIteration(held, *([] if kind == "classifier" else ["squared"])))
        chosen = best_round(losses, params.patience)
        if rounds >= params.max_rounds or chosen + params.patience <= rounds:
            break
        rounds = min(params.max_rounds, 2 * rounds)
    if refit and chosen < rounds:
        model = _fit_cells(counted, label, kind, chosen, params)
    counted.unpersist()
    held.unpersist()
    # The classifier reports twice the log loss.
    return chosen, losses[chosen - 1] / (2.0 if kind == "classifier" else 1.0), model


def predict(model, df: DataFrame, out: str) -> DataFrame:
    """Add the event probability or the regression prediction as ``out``."""
    kept = df.columns
    scored = model.transform(df)
    if "probability" in scored.columns:
        return scored.select(*kept, vector_to_array("probability")[1].alias(out))
    return scored.select(*kept, F.col("prediction").alias(out))


def _parallel(spark: SparkSession, tasks: Sequence, width: int) -> list:
    if not tasks:
        return []
    with ThreadPool(max(1, min(width, len(tasks)))) as pool:
        return pool.map(lambda task: task(), [inheritable_thread_target(spark)(task) for task in tasks])


def cross_fitted_pseudo(
    df: DataFrame, outcome: str, treatment: str, propensity: float, rounds: dict[str, int], params: BoostingParams,
    row_id: str = "row_id", out: str = "pseudo",
) -> DataFrame:
    """Doubly robust pseudo-outcomes; each fold is scored by models fitted on the others."""
    folded = assign_fold(df, row_id, params.folds, params.fold_seed).persist()

    def fit(fold: int, arm: int):
        rows = folded.where((F.col("fold") != fold) & (F.col(treatment) == arm))
        return lambda: fit_rounds(rows, outcome, "classifier", rounds[f"{outcome}_m{arm}"], params)

    tasks = [fit(fold, arm) for fold in range(params.folds) for arm in (0, 1)]
    models = _parallel(df.sparkSession, tasks, params.parallelism)
    parts = None
    for fold in range(params.folds):
        own = folded.where(F.col("fold") == fold)
        for arm in (0, 1):
            own = predict(models[2 * fold + arm], own, f"_mu{arm}")
        parts = own if parts is None else parts.unionByName(own)
    psi = aipw_score(F.col(outcome), F.col(treatment), F.col("_mu0"), F.col("_mu1"), propensity)
    result = stage(parts.withColumn(out, psi).drop("_mu0", "_mu1"), "pseudo")
    folded.unpersist()
    return result


@dataclass(frozen=True)
class ModelBundle:
    """Two models per outcome, the second stage, and what was selected."""

    models: dict
    outcomes: tuple[str, ...]
    metadata: DataFrame
    levels: DataFrame
    params: BoostingParams
    contract: dict

    def predict_nuisance(self, df: DataFrame, outcome: str) -> DataFrame:
        for arm in (0, 1):
            df = predict(self.models[f"{outcome}_m{arm}"], df, f"mu{arm}_{outcome}")
        return df

    def predict_policy_scores(self, df: DataFrame) -> DataFrame:
        """Add nuisance predictions of the first outcome and the three scores."""
        scored = predict(self.models["dr_learner"], self.predict_nuisance(df, self.outcomes[0]), "dr_score")
        return with_policy_scores(scored, self.outcomes[0]).drop("dr_score")

    def score(self, df: DataFrame, spec: ExperimentSpec) -> DataFrame:
        """Scores and nuisance predictions of encoded rows that carry covariates only."""
        require_feature_only(df, spec)
        scored = self.predict_policy_scores(feature_frame(df, self.levels, spec, self.params))
        for outcome in self.outcomes[1:]:
            scored = self.predict_nuisance(scored, outcome)
        return scored.drop("features")


def fit_bundle(
    development: DataFrame, levels: DataFrame, spec: ExperimentSpec, params: BoostingParams
) -> ModelBundle:
    """Select rounds on train/validation, then refit everything on both.

    ``development`` holds encoded features.  Order matters: nuisance rounds,
    train pseudo-outcomes, second-stage rounds, development pseudo-outcomes.
    """
    require_train_and_validation(development)
    primary, treatment = spec.outcomes[0], spec.treatment
    columns = [spec.row_id, *spec.features, treatment, *spec.outcomes, "split"]
    known = development.select(*columns)
    rows = training_frame(known, known.where("split = 'train'"), levels, spec, params)
    rows = rows.select(spec.row_id, "features", treatment, *spec.outcomes, "split").persist()
    spark = rows.sparkSession
    train, validation = rows.where("split = 'train'"), rows.where("split = 'validation'")
    arms = [(y, arm) for y in spec.outcomes for arm in (0, 1)]

    def choose(y: str, arm: int):
        hit = F.col(treatment) == arm
        return lambda: _select(train.where(hit), validation.where(hit), y, "classifier", params, refit=y == primary)

    chosen = _parallel(spark, [choose(y, arm) for y, arm in arms], params.parallelism)
    rounds = {f"{y}_m{arm}": found[0] for (y, arm), found in zip(arms, chosen)}
    losses = {f"{y}_m{arm}": found[1] for (y, arm), found in zip(arms, chosen)}

    def refit(source: DataFrame, y: str, arm: int):
        hit = source.where(F.col(treatment) == arm)
        return lambda: fit_rounds(hit, y, "classifier", rounds[f"{y}_m{arm}"], params)

    train_pseudo = cross_fitted_pseudo(train, primary, treatment, spec.propensity, rounds, params, spec.row_id)
    selection = [found[2] for (y, _), found in zip(arms, chosen) if y == primary]
    scored = predict(selection[1], predict(selection[0], validation, "_mu0"), "_mu1")
    validation_pseudo = scored.withColumn(
        "pseudo", aipw_score(F.col(primary), F.col(treatment), F.col("_mu0"), F.col("_mu1"), spec.propensity)
    )
    rounds["dr_learner"], losses["dr_learner"] = select_rounds(
        train_pseudo, validation_pseudo, "pseudo", "regressor", params
    )

    pseudo = cross_fitted_pseudo(rows, primary, treatment, spec.propensity, rounds, params, spec.row_id)
    tasks = [refit(rows, y, arm) for y, arm in arms]
    tasks.append(lambda: fit_rounds(pseudo, "pseudo", "regressor", rounds["dr_learner"], params))
    fitted = _parallel(spark, tasks, params.parallelism)
    models = {f"{y}_m{arm}": model for (y, arm), model in zip(arms, fitted)} | {"dr_learner": fitted[-1]}

    sizes = {r.split: r.n for r in rows.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows.unpersist()
    metadata = spark.createDataFrame(
        [
            (name, rounds[name], losses[name], sizes["train"], sizes["validation"], sizes["train"] + sizes["validation"],
             spec.propensity, params.folds, params.seed, params.fold_seed)
            for name in models
        ],
        "model string, selected_rounds int, validation_loss double, train_rows long, validation_rows long, "
        "development_rows long, propensity double, folds int, model_seed long, fold_seed long",
    )
    return ModelBundle(models, spec.outcomes, metadata, levels, params, feature_contract(spec, params))


def feature_contract(spec: ExperimentSpec, params: BoostingParams) -> dict:
    """What a saved bundle was fitted on; scoring under anything else would be silently wrong."""
    return {
        "continuous": list(spec.continuous), "categorical": list(spec.categorical), "outcomes": list(spec.outcomes),
        "treatment": spec.treatment, "propensity": spec.propensity, "split_seed": str(spec.seed),
        "folds": params.folds, "model_seed": params.seed, "fold_seed": params.fold_seed,
    }


def save_bundle(bundle: ModelBundle, path: str) -> None:
    for name, model in bundle.models.items():
        model.write().overwrite().save(f"{path}/models/{name}")
    bundle.metadata.coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")
    bundle.levels.write.mode("overwrite").parquet(f"{path}/levels")
    lines = bundle.metadata.sparkSession.createDataFrame([(json.dumps(bundle.contract),)], "value string")
    lines.coalesce(1).write.mode("overwrite").text(f"{path}/contract")


def load_bundle(spark: SparkSession, path: str, spec: ExperimentSpec, params: BoostingParams) -> ModelBundle:
    metadata = spark.read.parquet(f"{path}/metadata")
    names = [row.model for row in metadata.select("model").collect()]
    wanted = {f"{y}_m{arm}" for y in spec.outcomes for arm in (0, 1)} | {"dr_learner"}
    if set(names) != wanted:
        raise ValueError("saved models do not match the experiment")
    if metadata.where(F.col("propensity") != spec.propensity).limit(1).count():
        raise ValueError("saved propensity does not match the experiment")
    contract, wanted = json.loads(spark.read.text(f"{path}/contract").first().value), feature_contract(spec, params)
    differing = sorted(k for k in wanted if contract.get(k) != wanted[k])
    if differing:
        raise ValueError(f"saved models were fitted under another contract: {differing}")
    reader = lambda name: GBTRegressionModel if name == "dr_learner" else GBTClassificationModel
    models = {name: reader(name).load(f"{path}/models/{name}") for name in names}
    return ModelBundle(models, spec.outcomes, metadata, spark.read.parquet(f"{path}/levels"), params, contract)


def treatment_auc(
    train: DataFrame, validation: DataFrame, spec: ExperimentSpec, levels: DataFrame, params: BoostingParams,
    features: Sequence[str] | None = None,
) -> DataFrame:
    """Validation AUC of a treatment classifier that sees covariates only.

    Rounds are the ones with the best validation log loss within the patience
    window; the area itself is exact.
    """
    require_development_rows(train)
    require_development_rows(validation)
    names = tuple(features or spec.features)
    require_pre_treatment(names, spec)
    used = replace(
        spec,
        continuous=tuple(f for f in spec.continuous if f in names),
        categorical=tuple(f for f in spec.categorical if f in names),
        source_order=(),
    )
    columns = [spec.row_id, *names, spec.treatment]
    known = train.select(*columns)
    values = bin_values(known, used.continuous, params.max_bins)
    fit_on = feature_frame(binned(known, values), levels, used, params).persist()
    held = feature_frame(binned(validation.select(*columns), values), levels, used, params).persist()
    _, _, model = _select(fit_on, held, spec.treatment, "classifier", params)
    scored = stage(predict(model, held, "score").select(spec.row_id, spec.treatment, "score"), "treatment-scores")
    area = stage(roc_auc(scored, "score", spec.treatment, spec.row_id), "treatment-auc")
    fit_on.unpersist()
    held.unpersist()
    return area

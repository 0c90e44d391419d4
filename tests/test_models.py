import random
from dataclasses import replace

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from trialquota.operators import boosting, encoding, nuisance
from trialquota.operators.splits import assign_split
from trialquota.plans import workflows
from trialquota.spec import ExperimentSpec

SPEC = ExperimentSpec(continuous=("x",), categorical=("g",))
TREES = boosting.BoostingParams(max_rounds=4, patience=2, step=0.3, depth=2, min_rows=5, max_bins=16)


def experiment(spark, n=1500):
    """Conversions depend on g and, for treated rows, on x."""
    rng = random.Random(1)
    rows = []
    for i in range(n):
        x, g, t = rng.random(), float(rng.randrange(4)), int(rng.random() < 0.85)
        y = int(rng.random() < 0.2 + 0.1 * g + 0.3 * t * (x > 0.5))
        v = int(y or rng.random() < 0.4)
        rows.append((i, x, g, t, y, v, int(t and x > 0.7)))
    return spark.createDataFrame(rows, "row_id long, x double, g double, treatment int, conversion int, visit int, exposure int")


def test_cell_means_and_fallback(spark):
    rows = [("a", 1, 1), ("a", 1, 0), ("a", 0, 0), ("b", 1, 1)]
    df = spark.createDataFrame(rows, "s string, treatment int, conversion int")
    model = nuisance.fit_cell_means(df, ["s"], ["conversion"])
    probe = spark.createDataFrame([("a",), ("b",), ("new",)], "s string")
    found = {r.s: (r.mu0_conversion, r.mu1_conversion) for r in model.transform(probe).collect()}
    assert found == {"a": (0.0, 0.5), "b": (0.0, 1.0), "new": (0.0, pytest.approx(2 / 3))}
    with pytest.raises(ValueError, match="each treatment arm"):
        nuisance.fit_cell_means(df.where("treatment = 1"), ["s"], ["conversion"])


def test_cross_fit_never_uses_the_own_fold(spark):
    df = experiment(spark, 600)
    scored = nuisance.cross_fitted_scores(df, ["g"], "conversion", "treatment", 0.85, 3, 20260804).collect()
    for row in scored[::37]:
        mean = {}
        for arm in (0, 1):
            peers = [r.conversion for r in scored if r.fold != row.fold and r.g == row.g and r.treatment == arm]
            mean[arm] = sum(peers) / len(peers)
        t, y = row.treatment, row.conversion
        expected = mean[1] - mean[0] + t * (y - mean[1]) / 0.85 - (1 - t) * (y - mean[0]) / (1 - 0.85)
        assert row.pseudo == pytest.approx(expected)


def test_second_stage_average(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "s string, pseudo double")
    model = nuisance.fit_cell_average(df, ["s"], "pseudo")
    probe = spark.createDataFrame([("a",), ("z",)], "s string")
    assert {r.s: r.dr_score for r in model.transform(probe).collect()} == {"a": 2.0, "z": 3.0}


def test_best_round_waits_for_patience():
    assert boosting.best_round([3, 2, 1, 2, 2, 2, 0], 3) == 3
    assert boosting.best_round([3, 2, 1, 2, 2, 0.5], 3) == 6
    assert boosting.best_round([1.0], 5) == 1
    assert boosting.best_round([1.0, 1.0, 1.0], 2) == 1


def test_treatment_auc_on_separable_rows(spark):
    rng = random.Random(7)
    rows = [(i, rng.gauss(0, 1)) for i in range(600)]
    df = spark.createDataFrame(rows, "row_id long, x double").withColumn("treatment", (F.col("x") > 0).cast("int"))
    spec = ExperimentSpec(continuous=("x",), categorical=())
    levels = spark.createDataFrame([], "feature string, level double, code int")
    train, held = df.where("row_id < 400"), df.where("row_id >= 400")
    assert boosting.treatment_auc(train, held, spec, levels, TREES).first().auc > 0.98
    with pytest.raises(ValueError, match="pre-treatment"):
        boosting.treatment_auc(train, held, spec, levels, TREES, features=["treatment"])
    with pytest.raises(ValueError, match="train and validation"):
        boosting.treatment_auc(train.withColumn("split", F.lit("test")), held, spec, levels, TREES)


def test_jobs_end_to_end(spark, tmp_path):
    source = experiment(spark)
    paths = workflows.Paths(str(tmp_path / "prepared"), str(tmp_path / "models"), str(tmp_path / "results"))
    audit = {r.metric: r.value for r in workflows.run_prepare(source, SPEC, paths, TREES, 1500).collect()}
    assert audit["row_count"] == 1500
    assert audit["train_rows"] + audit["validation_rows"] + audit["test_rows"] == 1500
    assert 0.3 < audit["treatment_classifier_auc"] < 0.7
    assert {"header_matches", "features_finite", "maximum_absolute_smd"} <= set(audit)
    again = {r.metric: r.value for r in workflows.run_prepare(source, SPEC, paths, TREES).collect()}
    assert again == audit

    bundle = workflows.run_train(spark, SPEC, paths, TREES)
    assert set(bundle.models) == {"conversion_m0", "conversion_m1", "visit_m0", "visit_m1", "dr_learner"}
    rounds = {r.model: r.selected_rounds for r in bundle.metadata.collect()}
    assert all(1 <= n <= TREES.max_rounds for n in rounds.values())
    assert {name: model.getNumTrees for name, model in bundle.models.items()} == rounds

    tables = workflows.run_evaluate(spark, SPEC, paths, TREES, capacities=(0.2, 1.0), replicates=30)
    n = int(audit["test_rows"])
    values = tables["policy_values"].collect()
    assert len(values) == 2 * 2 * 4
    assert {r.selected_rows for r in values if r.capacity == 0.2} == {int(0.2 * n)}
    assert tables["policy_contrasts"].count() == 2 * 2 * 5
    assert tables["qini_coefficients"].count() == 3
    assert tables["qini_curves"].count() == 3 * 101
    assert tables["average_treatment_effects"].first().n_treated > 0
    written = spark.read.parquet(f"{paths.results}/policy_values")
    assert written.count() == 16

    loaded = boosting.load_bundle(spark, paths.models, SPEC, TREES)
    features = assign_split(source, SPEC).where("split = 'test'")
    encoded = encoding.apply_category_levels(features.select("row_id", "x", "g"), bundle.levels, SPEC.categorical)
    one = bundle.score(encoded, SPEC).orderBy("row_id").select("response", "t_learner", "dr_learner", "mu0_visit").collect()
    two = loaded.score(encoded, SPEC).orderBy("row_id").select("response", "t_learner", "dr_learner", "mu0_visit").collect()
    assert one == two and all(0 <= r.response <= 1 and 0 <= r.mu0_visit <= 1 for r in one)
    with pytest.raises(ValueError, match="post-assignment"):
        bundle.score(features, SPEC)
    with pytest.raises(ValueError, match="only train and validation"):
        boosting.fit_bundle(features, bundle.levels, SPEC, TREES)
    with pytest.raises(ValueError, match="propensity"):
        other = ExperimentSpec(continuous=("x",), categorical=("g",), propensity=0.5)
        boosting.load_bundle(spark, paths.models, other, TREES)
    with pytest.raises(ValueError, match="contract.*categorical.*continuous"):
        boosting.load_bundle(spark, paths.models, ExperimentSpec(continuous=("g",), categorical=("x",)), TREES)


def test_categories_beyond_the_bins_stay_nominal(spark):
    rows = [(i, float(i % 7), i % 40, float(i % 40 in (3, 17, 31))) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id long, x double, g int, y double")
    framed = encoding.feature_vector(df, ["x"], ["g"], {"g": 40})
    assert encoding.nominal_values(framed) == 41 > TREES.max_bins
    model = boosting.fit_rounds(framed, "y", "classifier", 2, TREES)
    # One nominal split tells the three scattered codes apart; an ordered one of this depth can't.
    scored = boosting.predict(model, framed, "p").groupBy("y").agg(F.min("p").alias("low"), F.max("p").alias("high")).collect()
    low, high = sorted(scored, key=lambda r: r.y)
    assert low.high < high.low


def test_a_fit_reads_cells_and_predicts_as_a_fit_on_rows(spark):
    # 2,400 rows, 24 feature vectors, 48 cells: before, every pass read all rows.
    rows = [(i, float(i % 6), i // 6 % 4, float((i * 7919) % 10 < 2 + i % 6 + 2 * (i // 6 % 4 == 2))) for i in range(2400)]
    df = spark.createDataFrame(rows, "row_id long, x double, g int, y double")
    framed = encoding.feature_vector(df, ["x"], ["g"], {"g": 4})
    counted = boosting.cells(framed, "y")
    assert counted.count() <= 48 and counted.agg(F.sum("_weight")).first()[0] == 2400
    assert encoding.nominal_values(counted) == 5
    plain = GBTClassifier(
        featuresCol="features", labelCol="y", maxIter=4, stepSize=0.3, maxDepth=2, minInstancesPerNode=5, maxBins=16, seed=TREES.seed
    ).fit(framed)
    model = boosting.fit_rounds(framed, "y", "classifier", 4, TREES)
    both = boosting.predict(model, boosting.predict(plain, framed, "a"), "b")
    assert both.agg(F.max(F.abs(F.col("a") - F.col("b")))).first()[0] < 1e-9
    assert model.evaluateEachIteration(counted) == pytest.approx(plain.evaluateEachIteration(framed))
    # The minimum counts rows, not cells: 1,201 rows a side can't be had.
    stump = boosting.fit_rounds(framed, "y", "classifier", 1, replace(TREES, min_rows=1201))
    assert stump.totalNumNodes == 1
    squared = GBTRegressor(
        featuresCol="features", labelCol="y", maxIter=4, stepSize=0.3, maxDepth=2, minInstancesPerNode=5, maxBins=16, seed=TREES.seed
    ).fit(framed)
    model = boosting.fit_rounds(framed, "y", "regressor", 4, TREES)
    both = boosting.predict(model, boosting.predict(squared, framed, "a"), "b")
    assert both.agg(F.max(F.abs(F.col("a") - F.col("b")))).first()[0] < 1e-9


def test_fewer_cells_than_categories_still_fit(spark):
    df = spark.createDataFrame([(i % 3, float(i % 3 == 1)) for i in range(300)], "g int, y double")
    framed = encoding.feature_vector(df, [], ["g"], {"g": 40})
    scored = boosting.predict(boosting.fit_rounds(framed, "y", "classifier", 2, TREES), framed, "p")
    low, high = scored.groupBy("y").agg(F.min("p").alias("a"), F.max("p").alias("b")).orderBy("y").collect()
    assert low.b < high.a


def test_trees_send_unbinned_rows_where_their_bins_went(spark):
    rng = random.Random(3)
    rows = [(i, rng.gauss(0, 1), float(i % 5)) for i in range(3000)] + [(3000, None, None), (3001, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "row_id long, x double, k double")
    values = boosting.bin_values(df, ["x", "k"], 16)
    assert set(values) == {"x"} and 2 < len(values["x"]) <= 16
    near = boosting.binned(df.withColumn("raw", F.col("x")), values).collect()
    for r in near[:3000]:
        assert r.x == min(values["x"], key=lambda v: (abs(v - r.raw), v))
    assert near[3000].x is None and near[3001].x != near[3001].x
    finite = df.where("row_id < 3000").withColumns({"y": (F.col("x") > 0.3).cast("double"), "raw": F.col("x")})
    raw = encoding.feature_vector(finite, ["x"], [], {})
    cut = encoding.feature_vector(boosting.binned(finite, values), ["x"], [], {})
    assert boosting.cells(cut, "y").count() <= 32
    model = boosting.fit_rounds(cut, "y", "classifier", 3, TREES)
    a = boosting.predict(model, raw, "p").select("row_id", "p")
    b = boosting.predict(model, cut, "p").select("row_id", F.col("p").alias("q"))
    assert a.join(b, "row_id").where("p <> q").count() == 0

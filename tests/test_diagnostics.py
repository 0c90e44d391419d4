import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from trialquota.functions.scores import standardized
from trialquota.operators import diagnostics
from trialquota.spec import ExperimentSpec

SPEC = ExperimentSpec(continuous=("x",), categorical=("g",))


def test_effect_matches_hand_values(spark):
    rows = list(zip([1, 0, 1, 0, 0, 1], [1, 1, 1, 0, 0, 0]))
    df = spark.createDataFrame(rows, "conversion int, treatment int")
    found = diagnostics.treatment_effects(df, ["conversion"], "treatment").first()
    assert found.estimate == pytest.approx(1 / 3)
    assert found.standard_error == pytest.approx(math.sqrt(2) / 3)
    assert (found.n_treated, found.n_control) == (3, 3)
    assert found.ci_lower < found.estimate < found.ci_upper


@pytest.mark.parametrize(
    "rows, message",
    [
        ([(1, 1), (0, 1), (1, 0)], "fewer than two rows"),
        ([(1, 1), (0, 1)], "fewer than two rows"),
        ([(2, 1), (0, 1), (1, 0), (0, 0)], "only 0 and 1"),
        ([(1, 1), (0, 1), (1, 0), (0, 0), (1, 3)], "only 0 and 1"),
    ],
)
def test_effect_contracts(spark, rows, message):
    df = spark.createDataFrame(rows, "conversion int, treatment int")
    with pytest.raises(Exception, match=message):
        diagnostics.treatment_effects(df, ["conversion"], "treatment").collect()


def test_effect_confidence_is_checked(spark):
    with pytest.raises(ValueError, match="confidence"):
        diagnostics.treatment_effects(spark.range(1), ["conversion"], "treatment", 1.0)


def test_balance_matches_algebra(spark):
    rows = [(2.5, 4, 1, "train"), (-1.0, 4, 1, "validation"), (7.0, 6, 1, "train"), (0.5, 6, 0, "train"), (3.5, 6, 0, "validation"), (4.0, 4, 0, "train"), (9.0, 6, 0, "train")]
    df = spark.createDataFrame(rows, "x double, g int, treatment int, split string")
    found = {r.feature: r for r in diagnostics.balance_table(df, SPEC).collect()}
    arms = {t: [r[0] for r in rows if r[2] == t] for t in (0, 1)}
    pooled = math.sqrt((statistics.variance(arms[0]) + statistics.variance(arms[1])) / 2)
    assert found["x"].value == pytest.approx((statistics.mean(arms[1]) - statistics.mean(arms[0])) / pooled)
    p1, p0 = 2 / 3, 1 / 4  # share of level 4 in each arm
    assert found["g"].value == pytest.approx((p1 - p0) / math.sqrt((p1 * (1 - p1) + p0 * (1 - p0)) / 2))
    assert found["x"].metric_type == "pooled_smd"
    with pytest.raises(ValueError, match="train and validation"):
        diagnostics.balance_table(df.withColumn("split", F.lit("test")), SPEC)


def test_balance_skips_missing_values(spark):
    rows = [(2.0, 1.0, 1), (8.0, math.nan, 1), (math.nan, 1.0, 1), (1.0, 1.0, 0), (2.0, 2.0, 0), (None, None, 0)]
    df = spark.createDataFrame(rows, "x double, g double, treatment int")
    assert diagnostics.continuous_balance(df, ["x"], "treatment").first().value == pytest.approx(3.5 / math.sqrt((18 + 0.5) / 2))
    levels = {r.level: (r.p1, r.p0) for r in diagnostics.level_balance(df, ["g"], "treatment").collect()}
    assert levels == {1.0: (1.0, 0.5), 2.0: (0.0, 0.5)}


def test_standardized_edges(spark):
    df = spark.createDataFrame([(1.0, 2.0), (0.0, 0.0), (1.0, 0.0), (-1.0, 0.0), (None, 1.0)], "d double, s double")
    found = [r.v for r in df.select(standardized(F.col("d"), F.col("s")).alias("v")).collect()]
    assert found == [0.5, 0.0, math.inf, -math.inf, None]


def test_sample_summary(spark):
    rows = [(1, 1, 1), (1, 0, 1), (0, 0, 0)]
    df = spark.createDataFrame(rows, "treatment int, conversion int, visit int")
    found = {(r.metric, r.group): r.value for r in diagnostics.sample_summary(df, SPEC).collect()}
    assert found["test_rows", "all"] == 3
    assert found["visit_events", "treated"] == 2
    assert found["conversion_rate", "treated"] == 0.5
    difference = diagnostics.raw_rate_difference(diagnostics.sample_summary(df, SPEC), "conversion")
    assert difference.first().difference == 0.5


def test_roc_area_against_pair_counting(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(8) / 8, rng.randrange(2)) for i in range(200)]
    pos = [s for _, s, y in rows if y]
    neg = [s for _, s, y in rows if not y]
    expected = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "row_id long, s double, y int")
    assert diagnostics.roc_auc(df, "s", "y").first().auc == pytest.approx(expected)
    with pytest.raises(Exception, match="finite"):
        diagnostics.roc_auc(df.withColumn("s", F.lit(float("nan"))), "s", "y").collect()

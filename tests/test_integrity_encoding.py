import math

import pytest
from pyspark.sql import functions as F

from trialquota.operators import diagnostics, encoding, integrity
from trialquota.spec import ExperimentSpec

SPEC = ExperimentSpec(continuous=("x",), categorical=("g",))
SCHEMA = "row_id long, x double, g double, treatment int, conversion int, visit int, exposure int"


def source(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_clean_rows_pass(spark):
    df = source(spark, (0, 1.0, 1.0, 1, 1, 1, 1), (1, 2.0, 2.0, 0, 0, 1, 0))
    assert integrity.validate_source(df, SPEC, 2)["row_count"] == 2


@pytest.mark.parametrize(
    "row, failed",
    [
        ((0, math.nan, 1.0, 1, 0, 0, 0), "features_finite"),
        ((0, math.inf, 1.0, 1, 0, 0, 0), "features_finite"),
        ((0, 1.0, None, 1, 0, 0, 0), "features_finite"),
        ((0, 1.0, 1.0, None, 0, 0, 0), "binary_domains_valid"),
        ((0, 1.0, 1.0, 2, 0, 0, 0), "binary_domains_valid"),
        ((0, 1.0, 1.0, 0, 0, 0, 1), "control_has_no_exposure"),
        ((0, 1.0, 1.0, 1, 1, 0, 0), "conversion_implies_visit"),
    ],
)
def test_each_check_fails_by_name(spark, row, failed):
    df = source(spark, (7, 1.0, 1.0, 1, 0, 0, 0), row)
    with pytest.raises(ValueError, match=failed):
        integrity.validate_source(df, SPEC)


def test_empty_source_and_wrong_count_fail(spark):
    with pytest.raises(ValueError, match="features_finite"):
        integrity.validate_source(spark.createDataFrame([], SCHEMA), SPEC)
    with pytest.raises(ValueError, match="row_count"):
        integrity.validate_source(source(spark, (0, 1.0, 1.0, 1, 0, 0, 0)), SPEC, 2)


def test_column_order_is_checked(spark):
    with pytest.raises(ValueError, match="unexpected source columns"):
        integrity.check_columns(source(spark, (0, 1.0, 1.0, 1, 0, 0, 0)).select("row_id", "g", "x", *SPEC.binary_columns), SPEC)


def test_levels_are_contiguous_and_unseen_is_null(spark):
    train = spark.createDataFrame([(x, "train") for x in (0.5, 12.0, -4.0, 12.0, 0.5, 7.0, math.nan)], "g double, split string")
    levels = encoding.fit_category_levels(train, ["g"])
    assert [(r.level, r.code) for r in levels.orderBy("code").collect()] == [(-4.0, 0), (0.5, 1), (7.0, 2), (12.0, 3)]
    rows = spark.createDataFrame([(0, 7.0), (1, -4.0), (2, 6.0), (3, None)], "row_id int, g double")
    encoded = encoding.apply_category_levels(rows, levels, ["g"]).orderBy("row_id").collect()
    assert [r.g for r in encoded] == [2, 0, None, None]
    assert encoding.apply_category_levels(rows, levels, ["g"]).schema["g"].dataType.simpleString() == "int"


def test_text_levels_and_large_tables_use_the_same_codes(spark, monkeypatch):
    train = spark.createDataFrame([("b", 2.0), ("a", 1.0), ("b", 1.0)], "t string, g double")
    levels = encoding.fit_category_levels(train, ["t", "g"])
    expected = {("t", "a", 0), ("t", "b", 1), ("g", "1.0", 0), ("g", "2.0", 1)}
    assert {tuple(r) for r in levels.collect()} == expected
    small = encoding.apply_category_levels(train, levels, ["t", "g"])
    monkeypatch.setattr(encoding.broadcast_if_small, "__defaults__", (None, 0))
    large = encoding.apply_category_levels(train, levels, ["t", "g"])
    assert "BroadcastHint" not in large._jdf.queryExecution().analyzed().toString()
    assert small.exceptAll(large).count() == 0


def test_leakage_guards(spark):
    rows = spark.createDataFrame([(1.0, "train"), (2.0, "validation")], "g double, split string")
    with pytest.raises(ValueError, match="train rows only"):
        encoding.fit_category_levels(rows, ["g"])
    with pytest.raises(ValueError, match="train and validation"):
        integrity.require_development_rows(rows.withColumn("split", F.lit("test")))
    with pytest.raises(ValueError, match="only train and validation"):
        integrity.require_train_and_validation(rows.where("split = 'train'"))
    with pytest.raises(ValueError, match="pre-treatment"):
        integrity.require_pre_treatment(["conversion"], SPEC)
    with pytest.raises(ValueError, match="post-assignment"):
        integrity.require_feature_only(rows.withColumn("visit", F.lit(1)), SPEC)


def test_alignment_counts_and_repeats(spark):
    left, right = spark.range(0, 6).toDF("row_id"), spark.range(2, 8).toDF("row_id")
    assert tuple(integrity.alignment(left, right).first()) == (4, 2, 2, 0)
    assert integrity.alignment(left.union(left), left).first().repeated == 6
    integrity.require_aligned(left, left)
    with pytest.raises(RuntimeError, match="not aligned"):
        integrity.require_aligned(left, right)


def test_result_table_guards(spark):
    table = spark.createDataFrame([("a", 0.1, "s"), ("a", 0.1, "s"), ("b", 0.1, "t")], "outcome string, capacity double, sample_scope string")
    with pytest.raises(ValueError, match="duplicate"):
        integrity.require_unique(table, ["outcome", "capacity"])
    with pytest.raises(ValueError, match="must use"):
        integrity.require_scope(table, "s")
    assert integrity.require_unique(table.distinct(), ["outcome", "capacity"]).count() == 2


def test_feature_vector_marks_nominal_columns(spark):
    rows = spark.createDataFrame([(1.5, 0, 7), (2.5, None, 3)], "x double, g int, wide int")
    out = encoding.feature_vector(rows, ["x"], ["g", "wide"], {"g": 2, "wide": 100})
    assert [list(r.features) for r in out.orderBy("x").collect()] == [[1.5, 0.0, 7.0], [2.5, 2.0, 3.0]]
    attributes = out.schema["features"].metadata["ml_attr"]["attrs"]
    assert [a["name"] for a in attributes["nominal"]] == ["_x_g", "_x_wide"]
    assert encoding.nominal_values(out) == 101


def test_levels_keep_their_type(spark):
    from datetime import date

    big = 2**53
    rows = [(big, date(2024, 1, 1), True, -0.0, "NaN"), (big + 1, date(2024, 1, 2), False, 0.0, "a"), (None, None, None, float("nan"), None)]
    df = spark.createDataFrame(rows, "n long, d date, b boolean, x double, t string")
    for feature, wanted in (("n", [big, big + 1]), ("d", [date(2024, 1, 1), date(2024, 1, 2)]), ("b", [False, True]), ("x", [0.0]), ("t", ["NaN", "a"])):
        levels = encoding.fit_category_levels(df.select(feature), [feature])
        assert [r.level for r in levels.orderBy("code").collect()] == wanted
        codes = [r[0] for r in encoding.apply_category_levels(df.select(feature), levels, [feature]).collect()]
        assert sorted(c for c in codes if c is not None) == sorted([0, 0] if feature == "x" else [0, 1])
    mixed = encoding.fit_category_levels(df, ["n", "d", "b", "x", "t"])
    applied = encoding.apply_category_levels(df, mixed, ["n", "d", "b", "x", "t"]).collect()
    assert sorted((r.n, r.d, r.x) for r in applied if r.n is not None) == [(0, 0, 0), (1, 1, 0)]
    assert [tuple(r) for r in applied if r.n is None] == [(None,) * 5]


def test_nan_is_no_level_beside_text(spark):
    rows = [(1, float("nan"), "a"), (1, 1.0, "b"), (0, float("nan"), "a"), (0, 1.0, "b")]
    df = spark.createDataFrame(rows, "treatment int, n double, t string")
    found = {(r.feature, r.level) for r in diagnostics.level_balance(df, ["n", "t"], "treatment").collect()}
    assert found == {("n", "1.0"), ("t", "a"), ("t", "b")}


def test_default_implications_follow_the_outcomes():
    from trialquota.spec import ExperimentSpec

    assert ExperimentSpec(continuous=("x",), categorical=()).implications == (("conversion", "visit"),)
    assert ExperimentSpec(continuous=("x",), categorical=(), outcomes=("sale",)).implications == ()

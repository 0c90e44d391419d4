import pytest
from pyspark.sql import functions as F

from trialquota.plans import reports
from trialquota.spec import CONTRASTS, POLICIES

SUMMARY = (
    "outcome string, capacity double, estimand_type string, name string, estimate double, "
    "bootstrap_standard_error double, ci_lower double, ci_upper double, bootstrap_replicates int"
)


@pytest.fixture(scope="module")
def tables(spark):
    rows = []
    for i, name in enumerate(POLICIES):
        rows.append(("conversion", 0.2, "policy_value", name, 0.01 * (i + 1), 0.001, 0.01 * i, 0.01 * (i + 2), 50))
        rows.append(("conversion", 1.0, "policy_value", name, 0.05, 0.001, 0.04, 0.06, 50))
    for name, _, _ in CONTRASTS:
        rows.append(("conversion", 0.2, "contrast", name, 0.003, 0.001, -0.001, 0.0060, 50))
    return reports.policy_tables(spark.createDataFrame(rows, SUMMARY), 12345)


def test_cohort_columns(tables):
    row = tables[0].where("name = 'random' AND capacity = 0.2").first()
    assert row.selected_rows == 2469
    assert row.selected_fraction_exact == 2469 / 12345
    assert row.test_cohort_incremental_count_estimate == pytest.approx(123.45)
    assert (row.quantity_type, row.unit) == ("held_out_policy_value", "incremental_outcomes_per_test_row")
    assert tables[1].first().quantity_type == "paired_policy_value_difference"


def test_views_are_ordered_and_formatted(tables):
    view = reports.policy_view(tables[0], "conversion", 0.2 + 1e-9).collect()
    assert [r.position for r in view] == [1, 2, 3, 4]
    assert view[0].allocation_rule == "Expected random allocation"
    assert view[0].selected_users == "2,469"
    assert view[3].interval_per_100k == "3,000.0 to 5,000.0"
    contrast = reports.contrast_view(tables[1], "conversion", 0.2).collect()
    assert [r.position for r in contrast] == [1, 2, 3, 4, 5]
    assert reports.rows_at_capacity(tables[0], "conversion", 0.21).count() == 0


def test_best_rule_and_tie(tables):
    best = {r.capacity: r for r in reports.best_rules(tables[0]).collect()}
    assert best[0.2].highest == "Doubly robust uplift targeting"
    assert best[0.2].outcomes_per_100k == pytest.approx(4000)
    assert best[1.0].highest == "All rules tie"


def test_cells_and_reversal(spark, tables):
    pivot = {r.capacity_percent: r for r in reports.policy_value_pivot(tables[0], "conversion").collect()}
    assert pivot[20.0].response == "2000.0 [1000.0, 3000.0]"
    reversed_row = reports.reversed_contrast(tables[1].where("name = 't_learner_minus_response'")).first()
    assert (reversed_row.name, reversed_row.estimate) == ("response_minus_t_learner", -0.003)
    assert (reversed_row.ci_lower, reversed_row.ci_upper) == (-0.006, 0.001)
    table = reports.response_contrast_pivot(tables[1], "conversion").first()
    assert table.response_minus_t_learner == "-300.0 [-600.0, 100.0]"
    tiny = spark.createDataFrame([(-1e-9, 0.0, 3e-7)], "e double, l double, u double")
    text = tiny.select(reports.cell_text(F.col("e"), F.col("l"), F.col("u"), 100_000.0).alias("t")).first().t
    assert text == "0.0 [0.0, 0.0]"


def test_scope_and_duplicates_are_refused(tables):
    with pytest.raises(ValueError, match="must use"):
        reports.effect_percentage_points(tables[0].withColumn("sample_scope", F.lit("train")))
    with pytest.raises(ValueError, match="duplicate"):
        reports.policy_value_pivot(tables[0].union(tables[0]), "conversion")

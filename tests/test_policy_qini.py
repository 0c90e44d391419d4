import math
import random

import pytest
from pyspark.sql import functions as F

from trialquota.functions.hashing import splitmix64
from trialquota.functions.scores import aipw_score, transformed_outcome
from trialquota.operators import policy, qini, ranking
from trialquota.spec import CONTRASTS, SCORE_POLICIES, SEED


def rank(spark, rows, schema, payload=()):
    return ranking.rank_policies(spark.createDataFrame(rows, schema), ["response"], list(payload), SEED)


def test_aipw_follows_its_formula(spark):
    rows = [(1, 1, 0.35, 0.6), (0, 1, 0.1, 0.45), (1, 0, 0.25, 0.3), (0, 0, 0.5, 0.05)]
    df = spark.createDataFrame(rows, "y int, t int, m0 double, m1 double")
    psi = aipw_score(F.col("y"), F.col("t"), F.col("m0"), F.col("m1"), 0.6)
    wanted = [m1 - m0 + ((y - m1) / 0.6 if t else -(y - m0) / 0.4) for y, t, m0, m1 in rows]
    assert [r.p for r in df.select(psi.alias("p")).collect()] == pytest.approx(wanted)
    with pytest.raises(ValueError, match="propensity"):
        aipw_score(F.col("y"), F.col("t"), F.col("m0"), F.col("m1"), 1.0)


def test_ties_follow_the_hashed_key(spark):
    scores = [0.3, 0.7, 0.3, 0.7, 0.1, 0.55, 0.3, 0.7]
    found = rank(spark, list(enumerate(scores)), "row_id long, response double")
    order = [r.row_id for r in found.rows.orderBy("rank").collect()]
    assert order == sorted(range(8), key=lambda i: (-scores[i], splitmix64(i, SEED)))
    chosen = policy.top_k_membership(found, 0.3).where("selected").collect()
    assert sorted(r.row_id for r in chosen) == sorted(order[:2])


def test_rank_is_exact_when_most_scores_tie(spark):
    rng = random.Random(5)
    rows = [(i, 0.5 if rng.random() < 0.6 else rng.choice([0.0, -0.0, rng.random()])) for i in range(4000)]
    expected = [i for i, s in sorted(rows, key=lambda r: (-r[1], splitmix64(r[0], SEED), r[0]))]
    for parts in (1, 9):
        df = spark.createDataFrame(rows, "row_id long, response double").repartition(parts)
        found = ranking.rank_policies(df, ["response"], [], SEED)
        assert [r.row_id for r in found.rows.orderBy("rank").collect()] == expected
        assert found.n_rows == 4000


def test_ranks_within_groups(spark):
    rows = [(g, i) for g in "abc" for i in range(50 if g == "b" else 5)]
    df = spark.createDataFrame(rows, "g string, i int")
    found = ranking.rank_rows(df, ["g"], [F.col("i").desc()])
    assert {(r.g, r.i, r["rank"]) for r in found.rows.collect()} == {
        (g, i, (50 if g == "b" else 5) - i) for g, i in rows
    }
    assert {r.g: r.n_rows for r in found.sizes.collect()} == {"a": 5, "b": 50, "c": 5}
    with pytest.raises(ValueError, match="same non-zero number"):
        found.n_rows


def test_scores_must_be_finite(spark):
    with pytest.raises(Exception, match="finite"):
        rank(spark, [(0, 1.0), (1, float("nan"))], "row_id long, response double")


def test_capacity_counts():
    assert policy.capacity_count(4, 0.49) == 1
    assert policy.capacity_count(10, 1.0) == 10
    for n, q in ((0, 0.5), (5, 1.5), (5, -0.1)):
        with pytest.raises(ValueError):
            policy.capacity_count(n, q)


def test_policy_and_random_values(spark):
    rng = random.Random(12)
    rows = [(i, *(rng.random() for _ in range(3)), rng.choice([-1.5, 0.25, 2.0])) for i in range(11)]
    df = spark.createDataFrame(rows, "row_id long, response double, t_learner double, dr_learner double, psi_y double")
    found = ranking.rank_policies(df, SCORE_POLICIES, ["psi_y"], SEED)
    shares = [0.0, 0.3, 0.62, 1.0]
    grid = policy.policy_value_grid(found, ["y"], shares)
    value = {(r.policy, r.capacity): r.value for r in grid.collect()}
    mean = sum(r[4] for r in rows) / 11
    for q in shares:
        k = math.floor(q * 11)
        assert value["random", q] == pytest.approx(mean * k / 11)
        for p, name in enumerate(SCORE_POLICIES, 1):
            assert value[name, q] == pytest.approx(sum(r[4] for r in sorted(rows, key=lambda r: -r[p])[:k]) / 11)
    assert policy.full_capacity_gap(grid).first().gap < 1e-12
    random_values = {r.capacity: r.value for r in policy.expected_random_values(df, ["y"], [0.3, 0.62], 11).collect()}
    assert random_values == pytest.approx({0.3: mean * 3 / 11, 0.62: mean * 6 / 11})
    halves = df.withColumn("psi_y", F.round(F.col("psi_y") * 4) / 4)
    exact = policy.policy_value_grid(ranking.rank_policies(halves, SCORE_POLICIES, ["psi_y"], SEED), ["y"], [1.0])
    assert policy.full_capacity_gap(exact).first().all_equal and policy.check_full_capacity(exact) is exact
    broken = grid.withColumn("value", F.when(F.col("policy") == "response", 9.0).otherwise(F.col("value")))
    with pytest.raises(AssertionError, match="full capacity"):
        policy.check_full_capacity(broken)


def test_contrasts(spark):
    value = {"random": 0.5, "response": -1.25, "t_learner": 3.0, "dr_learner": 2.5}
    df = spark.createDataFrame(list(value.items()), "policy string, value double")
    df = df.withColumns({"outcome": F.lit("y"), "capacity": F.lit(0.5)})
    found = {r.name: r.value for r in policy.policy_contrasts(df).collect()}
    assert found == {name: value[a] - value[b] for name, a, b in CONTRASTS}


def test_qini_matches_sums_by_rank(spark):
    rng = random.Random(6)
    rows = [(i, rng.randint(0, 1), rng.randint(0, 1), rng.random()) for i in range(9)]
    df = spark.createDataFrame(rows, "row_id long, y int, t int, response double")
    df = df.withColumn("z", transformed_outcome(F.col("y"), F.col("t"), 0.7))
    found = ranking.rank_policies(df, ["response"], ["z"], SEED)
    curve = qini.qini_curve(found).orderBy("position").collect()
    gains = [0.0]
    for _, y, t, _ in sorted(rows, key=lambda r: -r[3]):
        gains.append(gains[-1] + (y / 0.7 if t else -y / 0.3) / 9)
    centered = [g - i / 9 * gains[-1] for i, g in enumerate(gains)]
    assert [r.fraction for r in curve] == pytest.approx([i / 9 for i in range(10)])
    assert [r.cumulative_gain for r in curve] == pytest.approx(gains)
    assert [r.centered_qini for r in curve] == pytest.approx(centered, abs=1e-12)
    assert curve[-1].centered_qini == 0.0
    area = sum((a + b) / 18 for a, b in zip(centered, centered[1:]))
    assert qini.qini_coefficients(found).first().coefficient == pytest.approx(area)


@pytest.mark.parametrize("n", [1, 7, 99, 100, 101, 150, 1000])
def test_display_positions_cover_every_rank(spark, n):
    grid = qini.grid_positions(n)
    assert grid[0] == 0 and grid[-1] == n and len(grid) == 101
    df = spark.range(1, n + 1).toDF("rank").withColumn("p", qini.next_position(F.col("rank"), grid, n))
    for row in df.collect():
        assert row.p == min(p for p in grid if p >= row["rank"])


def test_blocks_do_not_change_curves(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, rng.random(), rng.choice([-2.0, 0.0, 1.0])) for i in range(700)]
    df = spark.createDataFrame(rows, "row_id long, response double, z double")
    found = ranking.rank_policies(df, ["response"], ["z"], SEED)
    whole = [r.cumulative_gain for r in qini.qini_curve(found).orderBy("position").collect()]
    monkeypatch.setattr(qini, "BLOCK_ROWS", 16)
    curve = qini.qini_curve(found).orderBy("position").collect()
    assert [r.cumulative_gain for r in curve] == pytest.approx(whole)
    ordered = sorted(rows, key=lambda r: -r[1])
    total, expected = 0.0, [0.0]
    for _, _, z in ordered:
        total += z
        expected.append(total / 700)
    assert whole == pytest.approx(expected)
    area = sum((a.centered_qini + b.centered_qini) / 2 / 700 for a, b in zip(curve, curve[1:]))
    assert qini.qini_coefficients(found).first().coefficient == pytest.approx(area)
    shown = {r.position: r.cumulative_gain for r in qini.qini_display(found).collect()}
    assert shown == pytest.approx({math.floor(i * 7.0): expected[math.floor(i * 7.0)] for i in range(101)})

"""Exact-capacity policies: membership, values, contrasts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from trialquota.functions.scores import aipw_score
from trialquota.operators.ranking import Ranking
from trialquota.spec import CONTRASTS


def with_aipw(df: DataFrame, outcomes: Sequence[str], treatment: str, propensity: float) -> DataFrame:
    """Add ``psi_<outcome>`` from ``mu0_<outcome>`` and ``mu1_<outcome>``."""
    return df.withColumns(
        {
            f"psi_{y}": aipw_score(F.col(y), F.col(treatment), F.col(f"mu0_{y}"), F.col(f"mu1_{y}"), propensity)
            for y in outcomes
        }
    )


def with_policy_scores(df: DataFrame, outcome: str, dr_score: str = "dr_score") -> DataFrame:
    """Add the three ranking scores of the outcome the policies are trained on."""
    return df.withColumns(
        {
            "response": F.col(f"mu1_{outcome}"),
            "t_learner": F.col(f"mu1_{outcome}") - F.col(f"mu0_{outcome}"),
            "dr_learner": F.col(dr_score),
        }
    )


def capacity_count(n_rows: int, capacity: float) -> int:
    """Number of rows an exact policy may select: floor(capacity * n)."""
    if n_rows < 1 or not 0.0 <= capacity <= 1.0:
        raise ValueError(f"no share {capacity} of {n_rows} rows can be selected")
    return math.floor(float(capacity) * n_rows)


def capacity_table(df: DataFrame, capacities: Sequence[float]) -> DataFrame:
    """Exact slot counts of a sample, one row per capacity."""
    if any(not 0.0 <= q <= 1.0 for q in capacities):
        raise ValueError("capacity must be in [0, 1]")
    shares = F.array(*[F.lit(float(q)) for q in capacities])
    counted = df.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.explode(shares).alias("capacity"))
    return counted.withColumn("k", F.floor(F.col("capacity") * F.col("n_rows")).cast("bigint"))


def top_k_membership(ranking: Ranking, capacity: float) -> DataFrame:
    """Flag the rows each policy selects at one capacity."""
    k = capacity_count(ranking.n_rows, capacity)
    return ranking.rows.withColumn("selected", F.col("rank") <= k)


def _cells(outcomes: Sequence[str], capacities: Sequence[float], n_rows: int, value) -> Column:
    """One struct per outcome and capacity, with ``value(outcome, index, k)`` inside."""
    return F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(y).alias("outcome"),
                    F.lit(float(q)).alias("capacity"),
                    F.lit(capacity_count(n_rows, q)).cast("bigint").alias("k"),
                    value(y, i, capacity_count(n_rows, q)).alias("value"),
                )
                for y in outcomes
                for i, q in enumerate(capacities)
            ]
        )
    )


def expected_random_values(
    scored: DataFrame, outcomes: Sequence[str], capacities: Sequence[float], n_rows: int
) -> DataFrame:
    """Expected value of giving the k slots to k rows drawn uniformly."""
    totals = scored.agg(*[F.sum(f"psi_{y}").alias(f"total_{y}") for y in outcomes])
    share = lambda y, i, k: F.lit(k / n_rows) * F.col(f"total_{y}") / F.lit(float(n_rows))
    cells = totals.select(_cells(outcomes, capacities, n_rows, share).alias("c"))
    return cells.select("c.outcome", "c.capacity", "c.k", F.lit("random").alias("policy"), "c.value")


def policy_value_grid(ranking: Ranking, outcomes: Sequence[str], capacities: Sequence[float]) -> DataFrame:
    """Value per row of every policy, capacity and outcome, random included.

    One aggregation over the staged ranks.  At full capacity every policy takes
    the same total, so the values there are equal bit for bit.
    """
    n = ranking.n_rows
    sums = [F.sum(f"psi_{y}").alias(f"total_{y}") for y in outcomes]
    for i, q in enumerate(capacities):
        k = capacity_count(n, q)
        if 0 < k < n:
            sums += [F.sum(F.when(F.col("rank") <= k, F.col(f"psi_{y}"))).alias(f"top_{i}_{y}") for y in outcomes]
    by_policy = ranking.rows.groupBy("policy").agg(*sums)
    # Three rows, gathered into one: the totals of one named policy stand for all
    # of them, and random allocation joins as a fourth entry without own sums.
    own = [c for c in by_policy.columns if c != "policy"]
    random = F.struct(F.lit("random").alias("policy"), *[F.lit(None).cast("double").alias(c) for c in own])
    shared = by_policy.agg(
        F.collect_list(F.struct("policy", *own)).alias("ranked"),
        *[F.min_by(f"total_{y}", "policy").alias(f"shared_{y}") for y in outcomes],
    )

    def value(y: str, i: int, k: int) -> Column:
        share = F.lit(k / n) * F.col(f"shared_{y}") / F.lit(float(n))
        if k in (0, n):
            return share
        return F.when(F.col("row.policy") == "random", share).otherwise(F.col(f"row.top_{i}_{y}") / F.lit(float(n)))

    rows = shared.withColumn("row", F.explode(F.concat("ranked", F.array(random))))
    cells = rows.select(F.col("row.policy").alias("policy"), _cells(outcomes, capacities, n, value).alias("c"))
    return cells.select("c.outcome", "c.capacity", "c.k", "policy", "c.value")


def policy_contrasts(values: DataFrame, keys: Sequence[str] = ("outcome", "capacity")) -> DataFrame:
    """The five pre-specified differences between policies, per ``keys``."""
    names = sorted({p for _, left, right in CONTRASTS for p in (left, right)})
    wide = values.groupBy(*keys).agg(
        *[F.max(F.when(F.col("policy") == p, F.col("value"))).alias(p) for p in names]
    )
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("name"), (F.col(left) - F.col(right)).alias("value"))
            for name, left, right in CONTRASTS
        ]
    )
    return wide.select(*keys, F.explode(pairs).alias("c")).select(*keys, "c.name", "c.value")


def full_capacity_gap(values: DataFrame) -> DataFrame:
    """Largest difference between any policy and random at full capacity, per outcome."""
    full = values.where(F.col("capacity") == 1.0)
    wide = full.groupBy("outcome").agg(
        F.max(F.when(F.col("policy") == "random", F.col("value"))).alias("random"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.count(F.lit(1)).alias("policies"),
    )
    gap = F.greatest(F.col("high") - F.col("random"), F.col("random") - F.col("low"))
    return wide.select("outcome", "policies", gap.alias("gap"), (gap == 0).alias("all_equal"))


def check_full_capacity(values: DataFrame) -> DataFrame:
    """Return ``values`` unchanged; raise if policies differ at full capacity."""
    if full_capacity_gap(values).where(~F.col("all_equal")).limit(1).count():
        raise AssertionError("policies differ although full capacity selects every row")
    return values

"""Inverse-propensity Qini curves and coefficients from global ranks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from trialquota.operators.ranking import Ranking
from trialquota.sources.staging import broadcast_if_small

BLOCK_ROWS = 1 << 18


def qini_coefficients(ranking: Ranking, gain: str = "z") -> DataFrame:
    """Area under the centered gain curve per policy, from one aggregation.

    Summing the trapezoids by parts leaves each row's gain times the number of
    points at or after its rank, so no running sum is needed.
    """
    n = float(ranking.n_rows)
    z = F.col(gain)
    totals = ranking.rows.groupBy("policy").agg(
        F.sum(z * (F.lit(n + 1.0) - F.col("rank"))).alias("_weighted"), F.sum(z).alias("_total")
    )
    area = F.col("_weighted") / F.lit(n * n) - F.col("_total") / F.lit(n) * F.lit((n + 1.0) / (2.0 * n))
    return totals.select("policy", area.alias("coefficient"))


def grid_positions(n_rows: int, points: int = 101) -> list[int]:
    """floor(share * n) for evenly spaced shares from 0 to 1, in order."""
    step = 1.0 / (points - 1)
    shares = [i * step for i in range(points - 1)] + [1.0]
    return [math.floor(share * n_rows) for share in shares]


def next_position(rank: Column, grid: list[int], n_rows: int) -> Column:
    """First grid position at or after ``rank``.

    The scaled rank is within one grid step of the answer; comparing the
    neighbouring exact positions settles it.
    """
    last = len(grid) - 1
    table = F.array(*[F.lit(p).cast("bigint") for p in grid])
    guess = F.ceil(rank.cast("double") * F.lit(last / n_rows)).cast("int")
    at = lambda i: F.element_at(table, F.least(F.greatest(i, F.lit(0)), F.lit(last)) + 1)
    found = F.when(at(guess - 2) >= rank, at(guess - 2))
    for offset in (-1, 0, 1):
        found = found.when(at(guess + offset) >= rank, at(guess + offset))
    return found.otherwise(at(guess + 2))


def qini_display(ranking: Ranking, gain: str = "z", points: int = 101) -> DataFrame:
    """Gain curve at the display positions: one aggregation to ``points`` rows per policy."""
    n = ranking.n_rows
    grid = grid_positions(n, points)
    sums = (
        ranking.rows.withColumn("position", next_position(F.col("rank"), grid, n))
        .groupBy("policy", "position")
        .agg(F.sum(gain).alias("_gain"))
    )
    wanted = F.array(*[F.lit(p).cast("bigint") for p in sorted(set(grid))])
    positions = ranking.sizes.select("policy", F.explode(wanted).alias("position"))
    running = Window.partitionBy("policy").orderBy("position")
    whole = Window.partitionBy("policy")
    filled = positions.join(sums, ["policy", "position"], "left").withColumn(
        "_gain", F.coalesce("_gain", F.lit(0.0))
    )
    curve = filled.select(
        "policy",
        "position",
        (F.col("position") / F.lit(float(n))).alias("fraction"),
        (F.sum("_gain").over(running) / F.lit(float(n))).alias("cumulative_gain"),
        (F.sum("_gain").over(whole) / F.lit(float(n))).alias("_final"),
    )
    return _centered(curve)


def qini_curve(ranking: Ranking, gain: str = "z") -> DataFrame:
    """Gain after every rank, origin included.

    Ranks are cut into fixed-width blocks; block totals give each block its
    starting gain and a window inside the block does the rest, so no task sees
    more than one block of a policy.
    """
    n = ranking.n_rows
    ranked = ranking.rows.select(
        "policy", "rank", F.col(gain).alias("_z"), F.expr(f"(rank - 1) div {BLOCK_ROWS}").alias("_block")
    )
    totals = ranked.groupBy("policy", "_block").agg(F.sum("_z").alias("_sum"))
    before = Window.partitionBy("policy").orderBy("_block")
    starts = totals.select(
        "policy",
        "_block",
        (F.sum("_sum").over(before) - F.col("_sum")).alias("_start"),
        F.sum("_sum").over(Window.partitionBy("policy")).alias("_all"),
    )
    inside = Window.partitionBy("policy", "_block").orderBy("rank")
    running = ranked.withColumn("_running", F.sum("_z").over(inside))
    n_starts = ranking.sizes.count() * math.ceil(n / BLOCK_ROWS)
    curve = running.join(broadcast_if_small(starts, n_starts), ["policy", "_block"]).select(
        "policy",
        F.col("rank").alias("position"),
        (F.col("rank") / F.lit(float(n))).alias("fraction"),
        ((F.col("_start") + F.col("_running")) / F.lit(float(n))).alias("cumulative_gain"),
        (F.col("_all") / F.lit(float(n))).alias("_final"),
    )
    origin = ranking.sizes.select(
        "policy",
        F.lit(0).cast("bigint").alias("position"),
        F.lit(0.0).alias("fraction"),
        F.lit(0.0).alias("cumulative_gain"),
        F.lit(0.0).alias("_final"),
    )
    return _centered(origin.unionByName(curve))


def _centered(curve: DataFrame) -> DataFrame:
    """Subtract the straight line to the final gain; exactly 0 at both ends."""
    centered = F.when(F.col("fraction") == 1.0, F.lit(0.0)).otherwise(
        F.col("cumulative_gain") - F.col("fraction") * F.col("_final")
    )
    return curve.withColumn("centered_qini", centered).drop("_final")


def qini_tables(ranking: Ranking, gain: str = "z", points: int = 101) -> tuple[DataFrame, DataFrame]:
    """Tidy coefficient and display-curve tables over all ranked policies."""
    scope = F.lit("held_out_test").alias("sample_scope")
    coefficients = qini_coefficients(ranking, gain).select(
        "policy",
        "coefficient",
        F.lit("qini_coefficient").alias("quantity_type"),
        F.lit("centered_ipw_gain_area_per_test_row").alias("unit"),
        scope,
    )
    curves = qini_display(ranking, gain, points).select(
        "policy",
        "fraction",
        "cumulative_gain",
        "centered_qini",
        F.lit("incremental_conversions_per_test_row").alias("unit"),
        scope,
    )
    return coefficients, curves

"""Closed-form outcome models: the mean outcome of each arm in each stratum.

They share the interface of the boosted models (``transform`` adds ``mu0_<y>``
and ``mu1_<y>``) and need one aggregation to fit and one join to apply.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from trialquota.functions.scores import aipw_score
from trialquota.operators.splits import assign_fold
from trialquota.sources.staging import broadcast_if_small, stage_counted


def _arm_sums(df: DataFrame, keys: Sequence[str], outcomes: Sequence[str], treatment: str) -> DataFrame:
    aggs = []
    for arm in (0, 1):
        hit = F.col(treatment) == arm
        aggs.append(F.count(F.when(hit, 1)).alias(f"n{arm}"))
        aggs += [
            F.coalesce(F.sum(F.when(hit, F.col(y).cast("double"))), F.lit(0.0)).alias(f"s{arm}_{y}") for y in outcomes
        ]
    return df.groupBy(*keys).agg(*aggs)


@dataclass(frozen=True)
class CellMeans:
    """Arm means per stratum; strata or arms never seen fall back to the arm mean."""

    cells: DataFrame
    strata: tuple[str, ...]
    outcomes: tuple[str, ...]
    arm_means: dict[str, float]
    n_cells: int

    def transform(self, df: DataFrame) -> DataFrame:
        names = [f"mu{arm}_{y}" for y in self.outcomes for arm in (0, 1)]
        cells = broadcast_if_small(self.cells.select(*self.strata, *names), self.n_cells)
        joined = df.join(cells, list(self.strata), "left")
        return joined.withColumns({m: F.coalesce(F.col(m), F.lit(self.arm_means[m])) for m in names})


def _cell_means(sums: DataFrame, n_cells: int, strata: Sequence[str], outcomes: Sequence[str]) -> CellMeans:
    names = [(f"mu{arm}_{y}", arm, y) for y in outcomes for arm in (0, 1)]
    overall = sums.agg(
        *[F.try_divide(F.sum(f"s{arm}_{y}"), F.sum(f"n{arm}")).alias(m) for m, arm, y in names]
    ).first()
    if any(overall[m] is None for m, _, _ in names):
        raise ValueError("each treatment arm needs at least one row")
    cells = sums.select(
        *strata,
        "n0",
        "n1",
        *[
            F.coalesce(F.try_divide(F.col(f"s{arm}_{y}"), F.col(f"n{arm}")), F.lit(overall[m])).alias(m)
            for m, arm, y in names
        ],
    )
    return CellMeans(cells, tuple(strata), tuple(outcomes), {m: overall[m] for m, _, _ in names}, n_cells)


def fit_cell_means(
    df: DataFrame, strata: Sequence[str], outcomes: Sequence[str], treatment: str = "treatment"
) -> CellMeans:
    sums, n_cells = stage_counted(_arm_sums(df, strata, outcomes, treatment), "cell-sums")
    return _cell_means(sums, n_cells, strata, outcomes)


@dataclass(frozen=True)
class FoldSums:
    """Arm sums per stratum and fold: one pass that fits all folds and the whole sample.

    Out-of-fold sums are all-fold sums minus own-fold sums.
    """

    rows: DataFrame  # the input with its ``fold``
    sums: DataFrame
    n_sums: int
    strata: tuple[str, ...]
    outcomes: tuple[str, ...]
    treatment: str

    def cell_means(self) -> CellMeans:
        """Models fitted on every row."""
        columns = [c for c in self.sums.columns if c not in (*self.strata, "fold")]
        whole = self.sums.groupBy(*self.strata).agg(*[F.sum(c).alias(c) for c in columns])
        return _cell_means(whole, self.n_sums, self.strata, self.outcomes)

    def pseudo_outcomes(self, outcome: str, propensity: float, out: str = "pseudo") -> DataFrame:
        """Doubly robust pseudo-outcomes from models that never saw the row's fold."""
        columns = ["n0", "n1", f"s0_{outcome}", f"s1_{outcome}"]
        whole = Window.partitionBy(*self.strata)  # at most one row per fold in each window
        others = self.sums.select(*self.strata, "fold", *[(F.sum(c).over(whole) - F.col(c)).alias(c) for c in columns])

        per_fold = self.sums.groupBy("fold").agg(*[F.sum(c).alias(c) for c in columns])
        everything = Window.partitionBy(F.lit(1))  # one row per fold
        outside = lambda c: F.sum(c).over(everything) - F.col(c)
        backup = per_fold.select(
            "fold",
            *[F.try_divide(outside(f"s{arm}_{outcome}"), outside(f"n{arm}")).alias(f"_backup{arm}") for arm in (0, 1)],
        )
        models = others.join(F.broadcast(backup), "fold").select(
            *self.strata,
            "fold",
            *[
                F.coalesce(F.try_divide(f"s{arm}_{outcome}", f"n{arm}"), f"_backup{arm}").alias(f"_mu{arm}")
                for arm in (0, 1)
            ],
        )
        scored = self.rows.join(broadcast_if_small(models, self.n_sums), [*self.strata, "fold"], "left")
        psi = aipw_score(F.col(outcome), F.col(self.treatment), F.col("_mu0"), F.col("_mu1"), propensity)
        return scored.withColumn(out, psi).drop("_mu0", "_mu1")


def fit_folds(
    df: DataFrame,
    strata: Sequence[str],
    outcomes: Sequence[str],
    treatment: str,
    folds: int,
    fold_seed: int,
    row_id: str = "row_id",
) -> FoldSums:
    folded = assign_fold(df, row_id, folds, fold_seed)
    sums, n_sums = stage_counted(_arm_sums(folded, [*strata, "fold"], outcomes, treatment), "fold-sums")
    return FoldSums(folded, sums, n_sums, tuple(strata), tuple(outcomes), treatment)


def cross_fitted_scores(
    df: DataFrame,
    strata: Sequence[str],
    outcome: str,
    treatment: str,
    propensity: float,
    folds: int,
    fold_seed: int,
    row_id: str = "row_id",
) -> DataFrame:
    """Rows with their fold and cross-fitted ``pseudo`` outcome."""
    return fit_folds(df, strata, [outcome], treatment, folds, fold_seed, row_id).pseudo_outcomes(outcome, propensity)


@dataclass(frozen=True)
class CellAverage:
    """Second-stage regression on strata: the mean of a column per stratum."""

    cells: DataFrame
    strata: tuple[str, ...]
    overall: float
    out: str
    n_cells: int

    def transform(self, df: DataFrame) -> DataFrame:
        joined = df.join(broadcast_if_small(self.cells, self.n_cells), list(self.strata), "left")
        return joined.withColumn(self.out, F.coalesce(F.col(self.out), F.lit(self.overall)))


def fit_cell_average(df: DataFrame, strata: Sequence[str], column: str, out: str = "dr_score") -> CellAverage:
    sums, n_cells = stage_counted(
        df.groupBy(*strata).agg(F.count(column).alias("_n"), F.sum(column).alias("_s")), "cell-average"
    )
    overall = sums.agg(F.try_divide(F.sum("_s"), F.sum("_n")).alias("mean")).first()["mean"]
    if overall is None:
        raise ValueError("the second stage needs at least one pseudo-outcome")
    cells = sums.select(*strata, F.try_divide("_s", "_n").alias(out))
    return CellAverage(cells, tuple(strata), overall, out, n_cells)

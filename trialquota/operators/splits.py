"""Hash-based split and fold assignment, and row selections built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from trialquota.functions.hashing import derive_seed, unsigned_mod, with_splitmix64
from trialquota.spec import SPLITS, ExperimentSpec

# Purposes for seed derivation; draws of the row bootstrap use their own seed.
SPLIT_PURPOSE = 1
FOLD_PURPOSE = 2
DRAW_PURPOSE = 3


def assign_split(df: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """Add ``split`` from the hashed row id: a projection, no shuffle."""
    keyed = with_splitmix64(df, "_key", spec.row_id, derive_seed(spec.seed, SPLIT_PURPOSE))
    bucket = unsigned_mod(F.col("_key"), spec.bucket_count)
    chosen = None
    for name, buckets in spec.split_buckets:
        hit = bucket.isin(*buckets)
        chosen = F.when(hit, F.lit(name)) if chosen is None else chosen.when(hit, F.lit(name))
    return keyed.withColumn("split", chosen).drop("_key")


def assign_fold(df: DataFrame, row_id: str, folds: int, seed: int) -> DataFrame:
    """Add ``fold`` in ``0 .. folds-1``: the key of the row id modulo ``folds``."""
    if folds < 2:
        raise ValueError("cross-fitting needs at least two folds")
    keyed = with_splitmix64(df, "_key", row_id, seed)
    return keyed.withColumn("fold", unsigned_mod(F.col("_key"), folds).cast("int")).drop("_key")


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


def select_rows(
    df: DataFrame, splits: Sequence[str] = SPLITS, arm: int | None = None, fold: int | None = None,
    hold_out: bool = False, treatment: str = "treatment",
) -> DataFrame:
    """Rows of some splits, one arm and one fold (or all folds but that one)."""
    unknown = set(splits) - set(SPLITS)
    if unknown or not splits:
        raise ValueError(f"invalid split selection: {sorted(unknown)}")
    chosen = df.where(F.col("split").isin(*splits))
    if arm is not None:
        chosen = chosen.where(F.col(treatment) == arm)
    if fold is not None:
        chosen = chosen.where(F.col("fold") != fold if hold_out else F.col("fold") == fold)
    return chosen

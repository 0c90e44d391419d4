"""Train-fitted category codes and the ordered feature vector."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from trialquota.functions.scores import is_finite, level_family, level_value
from trialquota.operators.integrity import require_train_rows
from trialquota.operators.ranking import rank_rows
from trialquota.sources.staging import broadcast_if_small, stage


def _kinds(df: DataFrame, features: Sequence[str]) -> dict[str, str]:
    kinds = dict(df.dtypes)
    return {f: kinds[f] for f in features}


def _level(feature: str, kind: str):
    """Level of one feature in its own type; NULL for values that are never levels."""
    level = level_value(F.col(feature), kind).cast(level_family(kind))
    return F.when(is_finite(level), level) if level_family(kind) == "double" else level


def fit_category_levels(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """``(feature, level, code)``: sorted distinct levels, codes from 0 per feature.

    Duplicates collapse before the shuffle, and codes come from the distributed
    rank, so a feature with very many levels never lands in one task.  Levels
    keep their type, so whole numbers of any size and dates stay exact; they are
    ranked in it and shown as strings only when features of several types meet.
    """
    require_train_rows(train)
    kinds = _kinds(train, features)
    families = sorted({level_family(k) for k in kinds.values()})
    parts = []
    for family in families:
        group = [f for f in features if level_family(kinds[f]) == family]
        levels = (
            train.select(*[_level(f, kinds[f]).alias(f) for f in group])
            .unpivot([], group, "feature", "level")
            .where(F.col("level").isNotNull())
            .distinct()
        )
        # Few levels are left of many rows: written first, ranking them sorts no rows.
        ranked = rank_rows(stage(levels, "distinct-levels"), ["feature"], [F.col("level").asc()], label="levels").rows
        shown = F.col("level") if len(families) == 1 else F.col("level").cast("string")
        parts.append(ranked.select("feature", shown.alias("level"), (F.col("rank") - 1).cast("int").alias("code")))
    levels = parts[0]
    for part in parts[1:]:
        levels = levels.unionByName(part)
    return stage(levels, "category-levels")


def level_counts(levels: DataFrame) -> DataFrame:
    return levels.groupBy("feature").agg(F.count(F.lit(1)).alias("cardinality"))


def apply_category_levels(df: DataFrame, levels: DataFrame, features: Sequence[str]) -> DataFrame:
    """Replace each feature by its code; unseen levels become NULL.

    One join per feature on the level.  A feature's level table is broadcast
    only after its size is known; a larger one is joined by shuffle.
    """
    sizes = {row.feature: row.cardinality for row in level_counts(levels).collect()}
    kinds = _kinds(df, features)
    shown = dict(levels.dtypes)["level"]
    encoded = df
    for feature in features:
        level = _level(feature, kinds[feature])
        lookup = levels.where(F.col("feature") == feature).select(
            F.col("level").alias("_level"), F.col("code").alias("_code")
        )
        encoded = (
            encoded.withColumn("_level", level.cast("string") if shown == "string" else level)
            .join(broadcast_if_small(lookup, sizes.get(feature, 0)), "_level", "left")
            .drop("_level")
            .withColumn(feature, F.col("_code"))
            .drop("_code")
        )
    return encoded.select(*df.columns)


def feature_vector(
    df: DataFrame,
    continuous: Sequence[str],
    categorical: Sequence[str],
    cardinality: dict[str, int],
    out: str = "features",
) -> DataFrame:
    """Continuous features, then category codes, as one ML vector.

    NULL codes take an extra code after the known ones.  Every category is
    nominal, whatever its number of levels; ``nominal_values`` tells how many
    bins a tree learner needs for that.
    """
    columns = [F.col(f).cast("double").alias(f"_x_{f}") for f in continuous]
    for feature in categorical:
        values = cardinality.get(feature, 0) + 1
        attribute = {"name": f"_x_{feature}", "type": "nominal", "num_vals": max(values, 2)}
        code = F.coalesce(F.col(feature), F.lit(values - 1)).cast("double")
        columns.append(code.alias(f"_x_{feature}", metadata={"ml_attr": attribute}))
    names = [f"_x_{f}" for f in (*continuous, *categorical)]
    assembled = VectorAssembler(inputCols=names, outputCol=out).transform(df.select("*", *columns))
    return assembled.drop(*names)


def nominal_values(df: DataFrame, features: str = "features") -> int:
    """Largest number of values of a nominal part of the feature vector."""
    parts = df.schema[features].metadata.get("ml_attr", {}).get("attrs", {}).get("nominal", [])
    return max((part.get("num_vals") or len(part.get("vals", ())) for part in parts), default=0)

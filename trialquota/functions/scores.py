"""Row-level score formulas and small statistics."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, functions as F

from trialquota.spec import check_share


def aipw_score(outcome: Column, treatment: Column, m0: Column, m1: Column, propensity: float) -> Column:
    """Fixed-propensity doubly robust score of the treatment effect of one row."""
    e = check_share("propensity", propensity)
    y, t = outcome.cast("double"), treatment.cast("double")
    treated_part = t * (y - m1) / F.lit(e)
    control_part = (F.lit(1.0) - t) * (y - m0) / F.lit(1.0 - e)
    return m1 - m0 + treated_part - control_part


def transformed_outcome(outcome: Column, treatment: Column, propensity: float) -> Column:
    """Inverse-propensity transformed outcome whose mean is the treatment effect."""
    e = check_share("propensity", propensity)
    y, t = outcome.cast("double"), treatment.cast("double")
    return t * y / F.lit(e) - (F.lit(1.0) - t) * y / F.lit(1.0 - e)


def is_finite(value: Column) -> Column:
    """True for values that are not NULL, NaN or infinite; never NULL itself."""
    number = value.cast("double")
    return value.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(float("inf")))


def finite_or_null(value: Column) -> Column:
    return F.when(is_finite(value), value.cast("double"))


def nan_to_null(value: Column) -> Column:
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


def level_value(value: Column, kind: str) -> Column:
    """A category value in its own type; negative zero is zero and NaN is no level."""
    if kind not in ("double", "float"):
        return value
    number = nan_to_null(value)
    return F.when(number == 0, F.lit(0.0)).otherwise(number)


def level_family(kind: str) -> str:
    """Type in which levels of a column type are compared."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return "bigint"
    return "double" if kind in ("double", "float") else kind


def standardized(difference: Column, scale: Column) -> Column:
    """difference / scale, with 0 or signed infinity where the scale is zero."""
    infinite = F.when(difference > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return (
        F.when(scale > 0, F.try_divide(difference, scale))
        .when(difference.isNull() | scale.isNull(), F.lit(None).cast("double"))
        .when(difference == 0, F.lit(0.0))
        .otherwise(infinite)
    )


def normal_quantile(confidence: float) -> float:
    """Two-sided critical value of the standard normal distribution."""
    return NormalDist().inv_cdf(0.5 + check_share("confidence", confidence) / 2.0)

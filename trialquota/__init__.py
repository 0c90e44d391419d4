"""Randomized-experiment analysis and capacity targeting on Spark DataFrames."""

from trialquota.spec import ExperimentSpec

__all__ = ["ExperimentSpec"]

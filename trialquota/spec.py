"""Declarative description of one experiment table."""

from __future__ import annotations

from dataclasses import dataclass

# Defaults every published result of the method was made with.
SEED = 20260803
PROPENSITY = 0.85
CAPACITIES = (0.05, 0.10, 0.20, 0.50, 1.00)
SPLITS = ("train", "validation", "test")
SCORE_POLICIES = ("response", "t_learner", "dr_learner")
POLICIES = ("random", "response", "t_learner", "dr_learner")
CONTRASTS = (
    ("response_minus_random", "response", "random"),
    ("t_learner_minus_random", "t_learner", "random"),
    ("dr_learner_minus_random", "dr_learner", "random"),
    ("t_learner_minus_response", "t_learner", "response"),
    ("dr_learner_minus_response", "dr_learner", "response"),
)

IMPLICATIONS = (("conversion", "visit"),)

MAX_SEED = (1 << 64) - 1


def check_share(name: str, value: float) -> float:
    """Return ``value`` if it lies strictly between zero and one, else raise."""
    if not 0.0 < value < 1.0:
        raise ValueError(f"{name} must lie strictly between zero and one")
    return float(value)


@dataclass(frozen=True)
class ExperimentSpec:
    """Column roles and fixed parameters of a randomized experiment.

    ``outcomes[0]`` is the outcome the targeting scores are trained on.
    ``implications`` lists ``(a, b)`` pairs of outcomes where a=1 requires b=1;
    by default the known pairs among ``outcomes``.
    """

    continuous: tuple[str, ...]
    categorical: tuple[str, ...]
    outcomes: tuple[str, ...] = ("conversion", "visit")
    row_id: str = "row_id"
    treatment: str = "treatment"
    exposure: str = "exposure"
    propensity: float = PROPENSITY
    seed: int = SEED
    implications: tuple[tuple[str, str], ...] | None = None
    source_order: tuple[str, ...] = ()
    bucket_count: int = 10
    split_buckets: tuple[tuple[str, tuple[int, ...]], ...] = (
        ("train", (0, 1, 2, 3, 4, 5)),
        ("validation", (6, 7)),
        ("test", (8, 9)),
    )

    def __post_init__(self) -> None:
        check_share("propensity", self.propensity)
        if not 0 <= self.seed <= MAX_SEED:
            raise ValueError("seed must be an unsigned 64-bit value")
        if not self.outcomes:
            raise ValueError("at least one outcome is required")
        if self.implications is None:
            known = tuple(pair for pair in IMPLICATIONS if set(pair) <= set(self.outcomes))
            object.__setattr__(self, "implications", known)
        buckets = sorted(b for _, group in self.split_buckets for b in group)
        if buckets != list(range(self.bucket_count)):
            raise ValueError("split buckets must partition the bucket range")
        if tuple(name for name, _ in self.split_buckets) != SPLITS:
            raise ValueError(f"splits must be exactly {SPLITS}")
        overlap = set(self.features) & self.not_features
        if overlap:
            raise ValueError(f"post-assignment columns used as features: {sorted(overlap)}")
        if self.source_order and set(self.source_order) != set(self.features) | set(self.binary_columns):
            raise ValueError("source_order must list every feature and binary column once")

    @property
    def features(self) -> tuple[str, ...]:
        return self.continuous + self.categorical

    @property
    def binary_columns(self) -> tuple[str, ...]:
        return (self.treatment, *self.outcomes, self.exposure)

    @property
    def source_columns(self) -> tuple[str, ...]:
        return self.source_order or self.features + self.binary_columns

    @property
    def not_features(self) -> set[str]:
        """Columns that may never enter a model or a pre-treatment diagnostic."""
        return {self.row_id, "split", *self.binary_columns}

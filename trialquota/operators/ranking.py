"""Exact ranks over a total order without a single-task window.

Rows are range-partitioned and sorted once on the full order (which ends in a
unique id, so tied scores still spread over partitions) and written to the
staging area together with their position.  A count per partition, a table with
about as many rows as there are partitions, turns positions into global ranks.
Later passes read the staged columns they need and never sort again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window, functions as F

from trialquota.functions.hashing import unsigned_order, with_splitmix64
from trialquota.functions.scores import is_finite
from trialquota.sources.staging import broadcast_if_small, stage, stage_counted

_POSITION_BITS = 33  # monotonically_increasing_id keeps the partition number above these


@dataclass(frozen=True)
class Ranking:
    """Ranked rows (``rank`` starts at 1 in each group) and the group sizes."""

    rows: DataFrame
    sizes: DataFrame
    groups: tuple[str, ...]

    @cached_property
    def n_rows(self) -> int:
        """Common size of all groups; raises when groups differ or are empty."""
        found = self.sizes.agg(F.min("n_rows").alias("low"), F.max("n_rows").alias("high")).first()
        if not found.high or found.low != found.high:
            raise ValueError("every ranking needs the same non-zero number of rows")
        return found.high


def rank_rows(df: DataFrame, groups: Sequence[str], order: Sequence[Column], label: str = "ranked") -> Ranking:
    """Rank rows inside each group by ``order``, which must be a total order."""
    groups = tuple(groups)
    by = [F.col(g) for g in groups] + list(order)
    tagged = (
        df.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("_position", F.monotonically_increasing_id())
    )
    staged = stage(tagged, label)
    partition = F.shiftright(F.col("_position"), _POSITION_BITS)
    # At most (shuffle partitions + groups) rows.
    blocks, n_blocks = stage_counted(
        staged.groupBy(*groups, partition.alias("_partition")).agg(
            F.count(F.lit(1)).alias("_rows"), F.min("_position").alias("_first")
        ),
        f"{label}-blocks",
    )
    running = Window.partitionBy(*groups).orderBy("_partition")
    starts = blocks.select(
        *groups,
        "_partition",
        (F.sum("_rows").over(running) - F.col("_rows") - F.col("_first") + 1).alias("_shift"),
    )
    rows = (
        staged.withColumn("_partition", partition)
        .join(broadcast_if_small(starts, n_blocks), [*groups, "_partition"])
        .withColumn("rank", F.col("_position") + F.col("_shift"))
        .drop("_partition", "_position", "_shift")
    )
    sizes = blocks.groupBy(*groups).agg(F.sum("_rows").alias("n_rows"))
    return Ranking(rows, sizes, groups)


def policy_order(score: str = "score", key: str = "tie_key", row_id: str = "row_id") -> list[Column]:
    """Higher score first, then the unsigned tie key, then the row id."""
    return [F.col(score).desc(), unsigned_order(F.col(key)).asc(), F.col(row_id).asc()]


def with_policies(
    scored: DataFrame, policies: Sequence[str], payload: Sequence[str], seed: int, row_id: str = "row_id"
) -> DataFrame:
    """Long form: one row per policy and input row, with score and tie key."""
    keyed = with_splitmix64(scored.select(row_id, *policies, *payload), "tie_key", row_id, seed)
    score = F.col("raw_score").cast("double")
    finite = F.when(is_finite(score), score + F.lit(0.0)).otherwise(
        F.raise_error(F.lit("a policy score is missing or not finite")).cast("double")
    )
    return keyed.unpivot([row_id, "tie_key", *payload], list(policies), "policy", "raw_score").select(
        "policy", row_id, "tie_key", finite.alias("score"), *payload
    )


def rank_policies(
    scored: DataFrame, policies: Sequence[str], payload: Sequence[str], seed: int, row_id: str = "row_id"
) -> Ranking:
    """Rank every row under every policy in one sorted, staged pass."""
    long = with_policies(scored, policies, payload, seed, row_id)
    return rank_rows(long, ["policy"], policy_order(row_id=row_id), label="policies")

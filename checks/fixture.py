"""Experiment tables derived from the given star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trialquota.functions.hashing import derive_seed, unsigned_mod, with_splitmix64
from trialquota.operators.nuisance import fit_cell_average, fit_folds
from trialquota.operators.policy import with_aipw, with_policy_scores
from trialquota.operators.splits import assign_split
from trialquota.spec import ExperimentSpec

FOLDS = 3
FOLD_SEED = 20260804
OUTCOME_PURPOSE = 11
VISIT_PURPOSE = 12
TREATMENT_PURPOSE = 13

EVENTS = ExperimentSpec(continuous=("f0", "f2"), categorical=("f1", "f3"))
ORDERS = ExperimentSpec(
    continuous=("o_totalprice", "c_acctbal"),
    categorical=("o_orderpriority", "o_orderstatus", "c_mktsegment", "c_nationkey"),
)
NUISANCE_STRATA = ("f3",)
DR_STRATA = ("f1",)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an experiment: about 85% treated, purchases as conversions."""
    flag = lambda condition: F.when(condition, 1).otherwise(0)
    base = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"),
        F.col("value").alias("f0"),
        F.dayofmonth("ts").cast("double").alias("f2"),
        (F.col("user_id") % 25).cast("double").alias("f1"),
        F.hour("ts").cast("double").alias("f3"),
        flag(F.get_json_object("props", "$.k").cast("int") < 85).alias("treatment"),
        flag(F.col("event_type") == "purchase").alias("conversion"),
        flag(F.col("event_type").isin("purchase", "click", "view")).alias("visit"),
    )
    return base.withColumn("exposure", flag((F.col("treatment") == 1) & (F.col("f0") > 50)))


def orders_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders joined to customers, with a hashed treatment and a planted effect."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"), "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus"
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey")
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey).drop("o_custkey", "c_custkey")
    joined = joined.withColumn("c_nationkey", F.col("c_nationkey").cast("string"))
    for name, purpose in (("_t", TREATMENT_PURPOSE), ("_c", OUTCOME_PURPOSE), ("_v", VISIT_PURPOSE)):
        joined = with_splitmix64(joined, f"{name}k", "row_id", derive_seed(ORDERS.seed, purpose))
        joined = joined.withColumn(name, unsigned_mod(F.col(f"{name}k"), 1000)).drop(f"{name}k")
    treated = (F.col("_t") < 850).cast("int")
    building = (F.col("c_mktsegment") == "BUILDING").cast("int")
    return (
        joined.withColumn("treatment", treated)
        .withColumn("conversion", (F.col("_c") < 50 + F.col("treatment") * (20 + 60 * building)).cast("int"))
        .withColumn("visit", ((F.col("conversion") == 1) | (F.col("_v") < 200 + 40 * F.col("treatment"))).cast("int"))
        .withColumn("exposure", ((F.col("treatment") == 1) & (F.col("_v") < 300)).cast("int"))
        .drop("_t", "_c", "_v")
    )


def split_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_split(events_experiment(spark, sf_dir), EVENTS)


def development(df: DataFrame) -> DataFrame:
    return df.where(F.col("split").isin("train", "validation"))


def held_out(df: DataFrame) -> DataFrame:
    return df.where(F.col("split") == "test")


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out events with closed-form scores and doubly robust row scores.

    Scores are rounded to 12 digits so that both engines see the same ties.
    """
    rows = split_events(spark, sf_dir)
    dev, test = development(rows), held_out(rows)
    fitted = fit_folds(dev, NUISANCE_STRATA, EVENTS.outcomes, EVENTS.treatment, FOLDS, FOLD_SEED)
    pseudo = fitted.pseudo_outcomes(EVENTS.outcomes[0], EVENTS.propensity)
    second = fit_cell_average(pseudo, DR_STRATA, "pseudo")
    scored = with_policy_scores(second.transform(fitted.cell_means().transform(test)), EVENTS.outcomes[0])
    scored = with_aipw(scored, EVENTS.outcomes, EVENTS.treatment, EVENTS.propensity)
    return scored.withColumns({p: F.round(p, 12) for p in ("response", "t_learner", "dr_learner")})

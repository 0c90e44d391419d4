import pytest
from pyspark.sql import functions as F

from trialquota.functions.hashing import derive_seed, splitmix64, unsigned_mod, unsigned_order, with_splitmix64
from trialquota.operators.splits import assign_fold, assign_split, select_rows, split_counts
from trialquota.spec import SEED, ExperimentSpec

SPEC = ExperimentSpec(continuous=("x",), categorical=())
IDS = [0, 1, 2, 2**32, 2**32 + 1, 2**62 + 12345, 2**63 - 1]


def signed(value):
    return value - (1 << 64) if value >> 63 else value


@pytest.mark.parametrize("seed", [SEED, 0, (1 << 64) - 1])
def test_keys_match_scalar_formula(spark, seed):
    df = spark.createDataFrame([(i,) for i in IDS], "id long")
    found = {r.id: r.key for r in with_splitmix64(df, "key", "id", seed).collect()}
    assert found == {i: signed(splitmix64(i, seed)) for i in IDS}


def test_seed_changes_keys(spark):
    df = spark.range(50)
    one = [r.k for r in with_splitmix64(df, "k", "id", SEED).orderBy("id").collect()]
    two = [r.k for r in with_splitmix64(df, "k", "id", SEED + 1).orderBy("id").collect()]
    assert one != two
    assert derive_seed(SEED, 1) != derive_seed(SEED, 2)


def test_negative_id_and_seed_are_rejected(spark):
    df = spark.createDataFrame([(-1,)], "id long")
    with pytest.raises(Exception, match="non-negative"):
        with_splitmix64(df, "k", "id", SEED).collect()
    with pytest.raises(ValueError):
        with_splitmix64(df, "k", "id", -1)


def test_unsigned_helpers(spark):
    rows = [(signed(v),) for v in (0, 5, (1 << 63) - 1, 1 << 63, (1 << 64) - 1)]
    df = spark.createDataFrame(rows, "k long").select("k", unsigned_mod(F.col("k"), 7).alias("m"), unsigned_order(F.col("k")).alias("o"))
    found = df.orderBy("o").collect()
    assert [r.k % (1 << 64) for r in found] == [0, 5, (1 << 63) - 1, 1 << 63, (1 << 64) - 1]
    assert [r.m for r in found] == [(r.k % (1 << 64)) % 7 for r in found]


def test_filter_on_key_stays_above_the_key_expression(spark):
    keyed = with_splitmix64(spark.range(10), "k", "id", SEED).where(F.col("k") % 10 == 3)
    plan = keyed._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Filter") < plan.index("Generate")


def test_split_shares_and_order_independence(spark):
    df = spark.range(20000).toDF("row_id")
    counts = {r.split: r.rows for r in split_counts(assign_split(df, SPEC)).collect()}
    assert sum(counts.values()) == 20000
    assert abs(counts["train"] / 20000 - 0.6) < 0.02
    assert abs(counts["test"] / 20000 - 0.2) < 0.02
    shuffled = assign_split(df.repartition(7), SPEC)
    assert shuffled.exceptAll(assign_split(df, SPEC)).count() == 0


def test_folds_are_seeded(spark):
    df = spark.range(300).toDF("row_id")
    fold = lambda seed: [r.fold for r in assign_fold(df, "row_id", 3, seed).orderBy("row_id").collect()]
    assert fold(20260804) == fold(20260804)
    assert set(fold(20260804)) == {0, 1, 2}
    assert fold(20260804) != fold(20260805)
    assert fold(20260804) == [splitmix64(i, 20260804) % 3 for i in range(300)]


def test_row_selection(spark):
    rows = spark.createDataFrame([(1, "train", 1, 0), (2, "train", 0, 1), (3, "test", 1, 1)], "row_id long, split string, treatment int, fold int")
    assert [r.row_id for r in select_rows(rows, ["train"], arm=1, fold=1, hold_out=True).collect()] == [1]
    with pytest.raises(ValueError):
        select_rows(rows, ["holdout"])


def test_spec_contracts():
    with pytest.raises(ValueError):
        ExperimentSpec(continuous=("x",), categorical=(), propensity=1.0)
    with pytest.raises(ValueError):
        ExperimentSpec(continuous=("exposure",), categorical=())
    with pytest.raises(ValueError):
        ExperimentSpec(continuous=("x",), categorical=(), bucket_count=11)

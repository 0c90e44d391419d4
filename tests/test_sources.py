import gzip
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from trialquota.sources import prepared, scan, staging, tables
from trialquota.spec import ExperimentSpec

SPEC = ExperimentSpec(continuous=("x",), categorical=("g",))
HEADER = "x,g,treatment,conversion,visit,exposure"


def write_gz(path, lines):
    with gzip.open(path, "wt") as out:
        out.write("\n".join(lines) + "\n")


def test_gzip_scan_has_declared_types_and_source_order(spark, tmp_path):
    path = str(tmp_path / "one.csv.gz")
    write_gz(path, [HEADER] + [f"{i * 0.5},{i % 3},1,0,1,0" for i in range(50)])
    df = scan.scan_csv(spark, path, SPEC, partitions=4)
    assert df.columns == ["row_id", *SPEC.source_columns]
    assert [kind for _, kind in df.dtypes] == ["bigint", "double", "double"] + ["smallint"] * 4
    assert [(r.row_id, r.x) for r in df.orderBy("row_id").collect()] == [(i, i * 0.5) for i in range(50)]


def test_ordinal_spans_files_and_splits(spark, tmp_path):
    folder = tmp_path / "many"
    os.makedirs(folder)
    value = 0
    for number, count in enumerate((400, 3, 900)):
        with open(folder / f"part-{number}.csv", "w") as out:
            out.write(HEADER + "\n")
            for _ in range(count):
                out.write(f"{float(value)},0,1,0,1,0\n")
                value += 1
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000b")
    try:
        df = scan.scan_csv(spark, str(folder), SPEC)
        assert df.where(F.col("row_id") != F.col("x")).count() == 0
        assert df.count() == df.select("row_id").distinct().count() == value
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_ids_do_not_depend_on_how_files_are_packed(spark, tmp_path):
    folder = tmp_path / "packed"
    os.makedirs(folder)
    value = 0
    for number in range(12):
        with open(folder / f"part-{number:02}.csv", "w") as out:
            out.write(HEADER + "\n")
            for _ in range(10 + 9 * number):
                out.write(f"{float(value)},0,1,0,1,0\n")
                value += 1
    names = ("spark.sql.files.minPartitionNum", "spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        spark.conf.set("spark.sql.files.minPartitionNum", "12")
        df = scan.scan_csv(spark, str(folder), SPEC)
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "900b")
        assert df.where(F.col("row_id") != F.col("x")).count() == 0
        assert df.agg(F.min("row_id"), F.max("row_id"), F.count_distinct("row_id")).first() == (0, value - 1, value)
    finally:
        for name, setting in before.items():
            spark.conf.unset(name) if setting is None else spark.conf.set(name, setting)


def test_every_file_header_is_checked(spark, tmp_path):
    folder = tmp_path / "headers"
    os.makedirs(folder)
    for number, header in enumerate((HEADER, "g,x,treatment,conversion,visit,exposure")):
        with open(folder / f"part-{number}.csv", "w") as out:
            out.write(header + "\n1,2,1,0,1,0\n")
    with pytest.raises(Exception, match="(?i)header"):
        scan.scan_csv(spark, str(folder), SPEC)


def test_parquet_ordinal(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(0, 1000, 1, 7).write.parquet(path)
    df = scan.with_parquet_ordinal(spark.read.parquet(path), "n")
    assert df.where("n <> id").count() == 0


def test_header_and_values_are_checked(spark, tmp_path):
    path = str(tmp_path / "swapped.csv")
    with open(path, "w") as out:
        out.write("g,x,treatment,conversion,visit,exposure\n1,2,1,0,1,0\n")
    with pytest.raises(ValueError, match="unexpected source header"):
        scan.scan_csv(spark, path, SPEC)
    bad = str(tmp_path / "bad.csv")
    with open(bad, "w") as out:
        out.write(HEADER + "\n1.0,oops,1,0,1,0\n")
    with pytest.raises(Exception, match="MALFORMED|oops|FAILFAST"):
        scan.scan_csv(spark, bad, SPEC).collect()


def split_table(spark):
    names = F.element_at(F.array(F.lit("train"), F.lit("validation"), F.lit("test")), (F.col("id") % 3 + 1).cast("int"))
    return spark.range(30).select(F.col("id").alias("row_id"), (F.col("id") * 2.0).alias("x"), names.alias("split"))


@pytest.mark.parametrize("rebalance", [False, True])
def test_prepared_round_trip(spark, tmp_path, rebalance):
    path = str(tmp_path / f"prepared-{rebalance}")
    prepared.write_prepared(split_table(spark), path, rebalance=rebalance)
    with pytest.raises(Exception, match="(?i)already exists"):
        prepared.write_prepared(split_table(spark), path)
    back = prepared.read_prepared(spark, path, ["test", "train"], ["row_id", "split"], ordered_by="row_id")
    assert [r.row_id for r in back.collect()] == [i for i in range(30) if i % 3 != 1]
    assert prepared.read_prepared(spark, path).exceptAll(split_table(spark)).count() == 0


def test_prepared_reads_prune(spark, tmp_path):
    path = str(tmp_path / "pruned")
    prepared.write_prepared(split_table(spark), path)
    plan = prepared.read_prepared(spark, path, ["test"], ["x"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<x:double>" in plan
    assert "PartitionFilters: [isnotnull(split" in plan or "PartitionFilters: [(split" in plan or "split#" in plan.split("PartitionFilters")[1][:80]
    with pytest.raises(ValueError, match="invalid split"):
        prepared.read_prepared(spark, path, ["dev"])
    with pytest.raises(ValueError, match="invalid split"):
        prepared.read_prepared(spark, path, [])
    with pytest.raises(ValueError, match="unknown columns"):
        prepared.read_prepared(spark, path, ["test"], ["nope"])


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_result_tables_round_trip(spark, tmp_path, fmt):
    rows = spark.createDataFrame([("response", 0.25, "q", "u", "held_out_test")], tables.SCHEMAS["qini_coefficients"])
    folder = str(tmp_path / fmt)
    tables.write_result(rows, folder, "qini_coefficients", fmt)
    assert tables.read_result(spark, folder, "qini_coefficients", fmt).collect() == rows.collect()
    assert tables.register_results(spark, folder, fmt, ["qini_coefficients"]) == ["qini_coefficients"]
    assert spark.sql("SELECT coefficient FROM qini_coefficients").first().coefficient == 0.25
    with pytest.raises(AnalysisException):
        tables.register_results(spark, folder, fmt)
    with pytest.raises(ValueError, match="unknown result table"):
        tables.write_result(rows, folder, "other")


def test_staging_counts_and_cleans_up(spark, tmp_path, monkeypatch):
    app = spark.sparkContext.applicationId
    monkeypatch.setattr(staging, "shared_dir", lambda spark: str(tmp_path))
    staged, rows = staging.stage_counted(spark.range(12), "ids")
    assert rows == 12 and staged.count() == 12
    assert (tmp_path / app).is_dir()
    staging.drop_staged(spark)
    assert not (tmp_path / app).exists()


class FakeSession:
    def __init__(self, folder, master):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("Context", (), {"master": master, "applicationId": "app-fake"})()


def test_shared_folder_comes_from_the_session():
    assert staging.shared_dir(FakeSession("hdfs://nn/check/", "yarn")) == "hdfs://nn/check"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.shared_dir(FakeSession(None, "yarn"))


def test_broadcast_only_below_the_limit(spark):
    small = staging.broadcast_if_small(spark.range(5), limit=5)
    large = staging.broadcast_if_small(spark.range(6), limit=5)
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(small) and not hinted(large)

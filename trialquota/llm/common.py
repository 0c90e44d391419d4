"""Written tables, size-checked broadcasts and connected components."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from trialquota.sources.staging import shared_dir

BROADCAST_BYTES = 32 << 20
BROADCAST_ROWS = 500_000
LONG_MASK_32 = 0x0000000100000001
LANES = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Staged:
    """A table written once to the shared folder, with its row count and size on disk."""

    df: DataFrame
    path: str
    rows: int

    def _folder(self):
        context = self.df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(context._jsc.hadoopConfiguration())

    def bytes(self) -> int:
        path, fs = self._folder()
        return fs.getContentSummary(path).getLength()

    def drop(self) -> None:
        path, fs = self._folder()
        fs.delete(path, True)
        if self.path in _made:
            _made.remove(self.path)

    def for_broadcast(self) -> DataFrame:
        """The table, hinted for broadcast when both its rows and its bytes are below the limits.

        Beyond them it is returned as it is: the join then shuffles.
        """
        small = self.rows <= BROADCAST_ROWS and self.bytes() <= BROADCAST_BYTES
        return F.broadcast(self.df) if small else self.df


def staged_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


#: Folders ``stage`` wrote in this process, oldest first, until ``release_staged`` deletes them.
_made: list[str] = []


def stage(df: DataFrame, label: str, **checks: Column) -> Staged:
    """Write ``df`` as Parquet under the checkpoint folder; lost executors only cost a re-read."""
    spark = df.sparkSession
    path = staged_path(spark, label)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    _made.append(path)
    return Staged(spark.read.schema(df.schema).parquet(path), path, seen.get["rows"])


def release_staged(spark: SparkSession, keep: DataFrame | None = None) -> int:
    """Delete every table ``stage`` wrote so far, except those that ``keep`` reads; returns how many went.

    A stage of a pipeline calls it first: the tables of earlier stages are then
    no longer read, since its input is written.
    """
    held = [f.split(":", 1)[-1] for f in keep.inputFiles()] if keep is not None else []
    gone = 0
    for path in list(_made):
        folder = path.split(":", 1)[-1].rstrip("/") + "/"
        if any(folder in f for f in held):
            continue
        context = spark.sparkContext
        hadoop = context._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(context._jsc.hadoopConfiguration()).delete(hadoop, True)
        _made.remove(path)
        gone += 1
    return gone


def packed(docs: DataFrame) -> DataFrame:
    """All columns as one struct ``row``, so that no name of theirs can clash; ``row.*`` unpacks it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def text_key(text: Column) -> list[Column]:
    """128 bits that identify a text, as two longs; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit(7), text).alias("_k2")]


def bit_sums(hashed: Column) -> list[Column]:
    """Sums that count each of the 64 bits of ``hashed`` over a group.

    Two counters of 32 bits share one long, so 32 sums hold all 64 counts,
    for up to two billion rows in a group.
    """
    mask = F.lit(LONG_MASK_32)
    return [F.sum(F.shiftrightunsigned(hashed, i).bitwiseAND(mask)).alias(f"_s{i}") for i in range(LANES)]


def majority_bits(n: Column) -> Column:
    """The long whose bit is 1 where over half of ``n`` rows have it, from the sums of ``bit_sums``."""
    low = F.lit(0xFFFFFFFF)
    bits = F.lit(0).cast("long")
    for i in range(LANES):
        lane = F.col(f"_s{i}")
        bits = bits.bitwiseOR(F.when(lane.bitwiseAND(low) * 2 > n, F.lit(1 << i)).otherwise(F.lit(0).cast("long")))
        high = 1 << (i + 32)
        bits = bits.bitwiseOR(
            F.when(
                F.shiftrightunsigned(lane, 32) * 2 > n, F.lit(high - (1 << 64) if high >> 63 else high).cast("long")
            ).otherwise(F.lit(0).cast("long"))
        )
    return bits


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def components(edges: DataFrame, label: str = "links") -> Staged:
    """Connected components of the links (a, b): one row (node, root) for each linked node.

    ``root`` is the smallest node of the component.  Rounds of large-star and
    small-star rewriting run until the links no longer change.  The minimum of
    each neighbourhood is combined before the shuffle, so a node with very many
    neighbours is never gathered in one task; each round is a written table.
    """

    def star(pairs: DataFrame) -> DataFrame:
        """(u, v, m): m is the least of u and its neighbours v."""
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return pairs.join(least, "u")

    def oriented(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    current = stage(oriented(edges.select("a", "b")), label)
    mark = None
    while current.rows:
        e = current.df
        both = e.selectExpr("a AS u", "b AS v").unionByName(e.selectExpr("b AS u", "a AS v"))
        large = star(both).where("v > u").selectExpr("v AS a", "m AS b")
        down = oriented(large).selectExpr("a AS u", "b AS v")
        small = star(down).selectExpr("v AS a", "m AS b").unionByName(down.groupBy("u").agg(F.min("v").alias("v")).selectExpr("u AS a", "v AS b"))
        changed = stage(oriented(small), label)
        now = tuple(changed.df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        current.drop()
        current = changed
        if now == mark:
            break
        mark = now
    found = current.df.selectExpr("a AS node", "b AS root")
    roots = current.df.selectExpr("b AS node", "b AS root").distinct()
    done = stage(found.unionByName(roots), label)
    current.drop()
    return done

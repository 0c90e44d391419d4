"""A corpus cleaning pipeline over ``documents``.

Stages, in order: quality rules drop the documents they reject; line dedup
removes repeated lines from the texts; SimHash near-dedup keeps one document of
each group; benchmark decontamination drops contaminated documents; byte-level
BPE encodes what is left.  Every stage but the last returns the columns of
documents; n_chars follows the text where a stage changes it.  Each stage first
deletes the tables that earlier stages wrote on the way, since its input is
written and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from trialquota.llm import bytebpe, decontam, linededup, quality, simhash
from trialquota.llm.common import release_staged, stage, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release_staged(spark, keep=docs)
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release_staged(spark, keep=docs)
    shorter = linededup.drop_repeated_lines(docs)
    n_chars = F.when(F.col("_n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return shorter.withColumn("n_chars", n_chars).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release_staged(spark, keep=docs)
    # The SimHash operator as its query defines it: 3-word shingles, links at 3 or fewer differing bits.
    return simhash.drop_simhash_duplicates(docs, shingle=3)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release_staged(spark, keep=docs)
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release_staged(spark, keep=docs)
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    # Smaller slices than the operator's default: executors reach this last stage with the heap earlier stages grew.
    return bytebpe.encode_decode(docs, ranks, public_tokenizers.PATTERN, slice_bytes=SLICE_BYTES)


SLICE_BYTES = 2 << 20

STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_bpe", byte_bpe),
]

# Tokenization and 64-bit fingerprints can't be stated in SQL; tests compare with a brute-force run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name).df
    return docs

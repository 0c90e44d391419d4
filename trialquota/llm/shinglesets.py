"""Links between texts by the exact Jaccard similarity of their word shingles.

Two sets with Jaccard similarity of at least 4/5 share at least 4/5 of either.
In any fixed order of all shingles, the first n - ceil(4n/5) + 1 of the n
shingles of both then have one in common.  Each text is filed under these, so
no pair at the bound is missed; pairs found are verified by their whole sets.

The order only decides how many pairs meet: shingles that a sample of texts
holds often come last, the others are ordered by hash.  Under a shingle with up
to ``CROWD`` texts all pairs meet; in a larger group each meets only the least
at first, and after these links only pairs still in different groups meet.

Words are what ASCII white space separates, with A-Z folded; a text of fewer
words than a shingle has one shingle, and so has a text without words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from trialquota.llm.common import Staged, components, stage, text_key
from trialquota.llm.wordcodes import slices

CROWD = 64
SAMPLE = 100_000
COMMON = 200_000
OFTEN = 8
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, as unsigned longs."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    starts = lists.offsets.to_numpy()
    starts = starts - starts[0]
    coded = pc.dictionary_encode(lists.flatten())
    words = coded.dictionary.to_pylist()
    hashed = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    codes = coded.indices.to_numpy()
    real = np.array([bool(w) for w in words], bool)[codes]
    starts = np.concatenate([[0], np.cumsum(real)])[starts]
    values = hashed[codes[real]]

    def combined(parts: list[np.ndarray]) -> np.ndarray:
        total = np.full(len(parts[0]), len(parts), np.uint64)
        for part in parts:
            total = (total ^ (total >> np.uint64(29))) * _MIX + part
        return total ^ (total >> np.uint64(32))

    last = max(0, len(values) - shingle + 1)
    runs = combined([values[i : i + last] for i in range(shingle)])
    found = []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        if b - a >= shingle:
            found.append(np.unique(runs[a : b - shingle + 1]))
        elif b > a:
            found.append(combined([values[i : i + 1] for i in range(a, b)]))
        else:
            found.append(np.zeros(1, np.uint64))
    return found


def prefix(found: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The shingles that a text is filed under; those in the sorted ``common`` come last."""
    n = len(found)
    if len(common):
        # ``common`` is sorted: one binary search per shingle, no sort of the list again.
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        held = common[at] == found
        found = np.concatenate([found[~held], found[held]])
    return found[: n - (4 * n + 4) // 5 + 1]


def texts_of(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(*text_key(F.col(text)), F.col(text).alias("text"))


def common_shingles(docs: DataFrame, text: str, shingle: int, rows: int) -> np.ndarray:
    """Shingles held by many texts of a sample, sorted; at most COMMON."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch, "text"):
                held = np.concatenate(shingle_sets(texts, shingle))
                yield pa.RecordBatch.from_arrays([pa.array(held.view(np.int64))], names=["key"])

    share = max(1, rows // SAMPLE)
    sample = texts_of(docs, text).where(F.pmod("_k2", F.lit(share)) == 0).select("text")
    counted = sample.mapInArrow(each, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(f"n >= {OFTEN}")
    keys = counted.orderBy(F.desc("n"), "key").limit(COMMON).select("key").toArrow()["key"]
    return np.sort(keys.combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))


def filed_texts(docs: DataFrame, text: str, shingle: int, rows: int) -> Staged:
    """(node, _k1, _k2, n, keys): a number, the set size and the prefix of each distinct text."""
    common = common_shingles(docs, text, shingle, rows)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                sets = shingle_sets(texts, shingle)
                keys = [prefix(s, common).view(np.int64) for s in sets]
                sizes = pa.array([len(s) for s in sets], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("_k1"), part.column("_k2"), sizes, pa.array(keys, pa.list_(pa.int64()))], names=["_k1", "_k2", "n", "keys"]
                )

    filed = texts_of(docs, text).mapInArrow(file, "_k1 long, _k2 long, n int, keys array<long>")
    distinct = filed.groupBy("_k1", "_k2").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))
    # The number is fixed by writing the table.
    return stage(distinct.select(F.monotonically_increasing_id().alias("node"), "_k1", "_k2", "n", "keys"), "filed-texts")


def crowded_keys(filed: DataFrame) -> Staged:
    """(key, node, n, least, least_n, texts): texts that share a key with others."""
    spread = filed.select("node", "n", F.explode("keys").alias("key")).repartition("key")
    least = spread.groupBy("key").agg(F.min(F.struct("node", "n")).alias("l"), F.count(F.lit(1)).alias("texts")).where("texts > 1")
    joined = spread.join(least, "key")
    return stage(joined.select("key", "node", "n", F.col("l.node").alias("least"), F.col("l.n").alias("least_n"), "texts"), "crowded-keys")


def comparable(a: str, b: str) -> Column:
    """Whether sets of these sizes can reach the bound."""
    return (5 * F.col(a) >= 4 * F.col(b)) & (5 * F.col(b) >= 4 * F.col(a))


def verified(pairs: DataFrame, filed: DataFrame, docs: DataFrame, text: str, shingle: int) -> Staged:
    """Pairs (a, b) whose shingle sets have a Jaccard similarity of at least 4/5."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = stage(filed.join(nodes, "node", "left_semi").select("node", "_k1", "_k2"), "wanted-texts").for_broadcast()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                sets = [s.view(np.int64) for s in shingle_sets(texts, shingle)]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "held"])

    named = texts_of(docs, text).join(wanted, ["_k1", "_k2"]).select("node", "text")
    sets = named.mapInArrow(whole, "node long, held array<long>")
    sets = stage(sets.groupBy("node").agg(F.first("held").alias("held")), "whole-sets").df
    left = sets.select(F.col("node").alias("a"), F.col("held").alias("ha"))
    right = sets.select(F.col("node").alias("b"), F.col("held").alias("hb"))
    both = F.size(F.array_intersect("ha", "hb"))
    met = pairs.join(left, "a").join(right, "b").where(9 * both >= 4 * (F.size("ha") + F.size("hb")))
    return stage(met.select("a", "b"), "set-links")


def text_groups(docs: DataFrame, text: str, shingle: int, rows: int, hints: DataFrame) -> DataFrame:
    """(_k1, _k2, root) for every distinct text; texts linked directly or by others have the same root.

    ``hints`` (_k1, _k2, hint) names groups that are likely alike: their texts meet the
    least of the group first.  Links come from verification alone.
    """
    filed = filed_texts(docs, text, shingle, rows).df
    crowded = crowded_keys(filed).df
    few, many = crowded.where(f"texts <= {CROWD}"), crowded.where(f"texts > {CROWD}")

    def meeting(entries: DataFrame, apart: Column) -> DataFrame:
        x, y = entries.alias("x"), entries.alias("y")
        match = (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & comparable("x.n", "y.n") & apart
        return x.join(y, match).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))

    stars = many.where((F.col("node") != F.col("least")) & comparable("n", "least_n"))
    hinted = filed.join(hints, ["_k1", "_k2"]).select("node", "n", "hint")
    heads = hinted.groupBy("hint").agg(F.min(F.struct("node", "n")).alias("l"))
    alike = hinted.join(heads, "hint").withColumns({"least": F.col("l.node"), "least_n": F.col("l.n")})
    alike = alike.where((F.col("node") != F.col("least")) & comparable("n", "least_n"))
    ends = [F.col("least").alias("a"), F.col("node").alias("b")]
    first = meeting(few, F.lit(True)).unionByName(stars.select(*ends)).unionByName(alike.select(*ends))
    first = stage(first.distinct(), "first-pairs").df
    links = verified(first, filed, docs, text, shingle).df
    rooted = components(links, "text-groups").df
    spots = many.join(rooted, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    second = meeting(spots, F.col("x.root") != F.col("y.root")).distinct()
    second = stage(second.join(first, ["a", "b"], "left_anti"), "second-pairs")
    if second.rows:
        more = verified(second.df, filed, docs, text, shingle)
        if more.rows:
            rooted = components(links.unionByName(more.df), "text-groups").df
    return filed.join(rooted, "node", "left").select("_k1", "_k2", F.coalesce("root", "node").alias("root"))

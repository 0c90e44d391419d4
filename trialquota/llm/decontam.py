"""Benchmark contamination by a prefix-filtered set join.

An item gives one window per run of ``width`` words.  A window occurs in a
document only if all its words do, so its rarest word alone is a sufficient
prefix: words are ordered by how often the documents hold them, and each
distinct window is filed under its rarest word with the word's offset.  A
document word that is filed proposes the window at one start; starts before the
text or too near its end are dropped by position and length, and the remaining
ones are verified by comparing the words of the whole window.

Defined cases: null texts and texts without words have no hits; items without
words give no window; null item ids count as an item without a name and are
left out of the list; repeated rows each give a row; an empty benchmark leaves
every document clean; columns other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trialquota.llm.common import Staged, packed, stage, text_key
from trialquota.llm.simhash import LOWER, UPPER

#: Runs of ASCII characters that are neither letters nor digits.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WIDTH = 13


def plain_words(text: Column) -> Column:
    """Words as written; case is folded where words are compared."""
    parts = F.split(F.coalesce(text, F.lit("")), BREAKS, -1)
    first, last = F.element_at(parts, 1) == "", F.element_at(parts, -1) == ""
    return F.slice(
        parts,
        F.when(first, 2).otherwise(1),
        F.greatest(F.size(parts) - first.cast("int") - last.cast("int"), F.lit(0)),
    )


def fold(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def rough(word: Column) -> Column:
    """Hash of the lower-cased word: equal for words that are equal after ``fold``."""
    return F.xxhash64(F.lower(word))


def benchmark_windows(benchmark: DataFrame, width: int, item_id: str, text: str) -> Staged:
    """(window, length, words, items): distinct windows with the items that hold them."""
    words = benchmark.select(F.col(item_id).alias("item_id"), plain_words(fold(F.col(text))).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(width))
    starts = words.select("item_id", "w", length.alias("length"), F.explode(F.sequence(F.lit(1), F.size("w") - length + 1)).alias("s"))
    cut = starts.select("item_id", F.slice("w", F.col("s"), F.col("length")).alias("words"), "length")
    grouped = cut.groupBy(F.array_join("words", " ").alias("window"), "length").agg(
        F.first("words").alias("words"), F.collect_set(F.col("item_id").cast("string")).alias("items")
    )
    return stage(grouped, "windows")


def document_words(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), *text_key(F.col(text)), plain_words(F.col(text)).alias("words"))


def filed_windows(words: DataFrame, windows: Staged) -> Staged:
    """(token, offset, window, length, items): each window under its rarest word.

    Only words of the benchmark are counted.  Ties go to the smaller hash.
    """
    spots = windows.df.select(
        "window", "length", "items", F.posexplode(F.transform("words", rough)).alias("offset", "token")
    )
    wanted = stage(spots.select("token").distinct(), "benchmark-words")
    tokens = words.select(F.explode("words").alias("word")).select(rough(F.col("word")).alias("token"))
    counts = stage(tokens.join(wanted.for_broadcast(), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n")), "word-counts")
    ranked = spots.join(counts.for_broadcast(), "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = ranked.groupBy("window", "length").agg(
        F.min(F.struct("n", "token", "offset")).alias("r"), F.first("items").alias("items")
    )
    filed = rarest.where("r.n > 0").select(
        F.col("r.token").alias("token"), F.col("r.offset").alias("offset"), "window", "length", "items"
    )
    return stage(filed, "filed-windows")


def contaminated_spans(words: DataFrame, filed: Staged) -> DataFrame:
    """(doc_id, _k1, _k2, start, length, items) of verified windows."""
    spots = words.select("doc_id", "_k1", "_k2", "words", F.posexplode("words").alias("p", "word"))
    spots = spots.withColumn("token", rough(F.col("word")))
    proposed = spots.join(filed.for_broadcast(), "token")
    start = F.col("p") - F.col("offset")
    inside = (start >= 0) & (start + F.col("length") <= F.size("words"))
    found = fold(F.array_join(F.slice("words", start + 1, F.col("length")), " "))
    return proposed.where(inside).where(found == F.col("window")).select(
        "doc_id", "_k1", "_k2", start.alias("start"), "length", "items"
    )


def covered(spans: Column) -> Column:
    """Positions covered by (start, end) structs sorted by start."""
    seed = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(done: Column, span: Column) -> Column:
        new = F.greatest(span["end"] - F.greatest(span["start"], done["end"]), F.lit(0))
        return F.struct((done["n"] + new).alias("n"), F.greatest(done["end"], span["end"]).alias("end"))

    return F.aggregate(spans, seed, step, lambda done: done["n"])


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = WIDTH,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Per row: words, words inside benchmark windows, items found, and the verdict."""
    words = document_words(docs, doc_id, text)
    filed = filed_windows(words, benchmark_windows(benchmark, width, item_id, item_text))
    keys = ["doc_id", "_k1", "_k2"]
    spans = contaminated_spans(words, filed)
    hits = spans.groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    ).select(*keys, covered(F.col("spans")).cast("long").alias("n_hit"), "items")
    rows = words.select(*keys, F.size("words").cast("long").alias("n_words"))
    joined = rows.join(hits.selectExpr(*[f"{k} AS _{k}" for k in keys], "n_hit", "items"), (
        rows["doc_id"].eqNullSafe(F.col("_doc_id")) & (rows["_k1"] == F.col("__k1")) & (rows["_k2"] == F.col("__k2"))
    ), "left")
    n_hit, items = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        "_k1", "_k2",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` that are not contaminated, with all their columns."""
    bad = contamination(docs, benchmark, doc_id=doc_id, text=text).where("contaminated").select(
        F.col("doc_id").alias("_d"), F.col("_k1").alias("_b1"), F.col("_k2").alias("_b2")
    )
    bad = stage(bad.distinct(), "contaminated")
    rows = packed(docs)
    k1, k2 = text_key(F.col(f"row.{text}"))
    match = F.col(f"row.{doc_id}").eqNullSafe(F.col("_d")) & (k1 == F.col("_b1")) & (k2 == F.col("_b2"))
    return rows.join(bad.for_broadcast(), match, "left_anti").select("row.*")

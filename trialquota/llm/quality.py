"""Quality rules with thresholds read from mergeable quantile sketches.

Each document gets integer measures.  A sketch is a table of counts over bins
that keep the leading ``PRECISION`` bits of a value, so it merges by adding, in
any order, and a quantile read from it is exact to 1/64 of its value.  Sketches
are built per language and source in one aggregation; a group with too few
documents for its own quartiles reads the sum of the sketches of its language,
or of all.  A document is rejected when a measure lies beyond the quartiles of
its group by ``REACH`` times their distance.

Defined cases: a null text counts as empty and fails the base rules; null
languages and sources form groups of their own; repeated rows each count and
each give a row; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from trialquota.llm.common import Staged, packed, stage, text_key
from trialquota.llm.wordcodes import slices

SPACES = " \t\n\x0b\x0c\r"
WINDOW = 5
PRECISION = 7
MIN_GROUP = 200
REACH = 4
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Measure:
    """An integer measure, per thousand.

    ``spread`` is the least distance its quartiles are taken to have; ``noise``
    over the root of the number of words is allowed on top, as means of few
    words scatter.
    """

    name: str
    value: str
    spread: int
    two_sided: bool = False
    noise: int = 0


MEASURES = (
    Measure("word_length", "word_chars * 1000 DIV n_words", 500, True, 7000),
    Measure("symbol_share", "n_symbols * 1000 DIV n_words", 50),
    Measure("duplicate_line_share", "n_dup_lines * 1000 DIV n_lines", 150),
    Measure("repeat_share", "n_repeat_words * 1000 DIV n_words", 60),
    Measure("capital_share", "n_capitals * 1000 DIV word_chars", 60),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


def repeated_windows(codes: np.ndarray, owner: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Whether each word lies in a window of ``width`` words that its text holds twice or more."""
    n = len(codes)
    covered = np.zeros(n, bool)
    if n < width:
        return covered
    last = n - width + 1
    inside = np.flatnonzero(owner[:last] == owner[width - 1 :])
    if not len(inside):
        return covered
    hashed = owner[inside].astype(np.uint64)
    for i in range(width):
        hashed = (hashed ^ (hashed >> np.uint64(29))) * _MIX + codes[inside + i].astype(np.uint64) + np.uint64(1)
    order = np.argsort(hashed, kind="stable")
    ranked = hashed[order]
    equal = np.flatnonzero(ranked[1:] == ranked[:-1])
    first, second = inside[order[equal]], inside[order[equal + 1]]
    alike = owner[first] == owner[second]
    for i in range(width):
        alike &= codes[first + i] == codes[second + i]
    if not alike.all():  # a collision of hashes: compare the windows themselves
        windows = np.stack([owner[inside], *[codes[inside + i] for i in range(width)]], axis=1)
        _, group, size = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
        starts = inside[size[group.ravel()] > 1]
    else:
        starts = np.unique(np.concatenate([first, second]))
    edge = np.zeros(n + 1, np.int64)
    edge[starts] += 1
    edge[starts + width] -= 1
    return np.cumsum(edge[:-1]) > 0


def line_counts(text: str) -> tuple[int, int]:
    """Lines with a word, and those equal to an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return len(lines), len(lines) - len(set(lines))


def text_counts(texts: pa.Array) -> list[np.ndarray]:
    """The measures' counts for each text, in the order of COUNTS."""
    lists = pc.ascii_split_whitespace(texts)
    starts = lists.offsets.to_numpy()
    starts = starts - starts[0]
    coded = pc.dictionary_encode(lists.flatten())
    codes, words = coded.indices.to_numpy(), coded.dictionary
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    real = lengths[codes] > 0 if len(words) else np.zeros(0, bool)
    starts = np.concatenate([[0], np.cumsum(real)])[starts]
    codes = codes[real]

    def total(per_word: np.ndarray) -> np.ndarray:
        running = np.concatenate([[0], np.cumsum(per_word, dtype=np.int64)])
        return running[starts[1:]] - running[starts[:-1]]

    def matches(pattern: str) -> np.ndarray:
        return pc.count_substring_regex(words, pattern).to_numpy(zero_copy_only=False)[codes]

    n_words = np.diff(starts)
    owner = np.repeat(np.arange(len(n_words)), n_words)
    lines = np.array([line_counts(t) for t in texts.to_pylist()], np.int64).reshape(-1, 2)
    return [
        n_words.astype(np.int64), total(lengths[codes]), total(matches("[#*$%&|<>]")), lines[:, 1],
        total(repeated_windows(codes, owner)), lines[:, 0], total(matches(r"\p{Lu}")),
    ]


def measured(docs: DataFrame, doc_id: str, text: str, lang: str, source: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang, source, counts, and the columns ``keep``) per row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                names = [n for n in part.schema.names if n != "text"]
                counts = [pa.array(c) for c in text_counts(texts)]
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], *counts], names=[*names, *COUNTS])

    narrow = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(lang).cast("string").alias("lang"),
        F.col(source).cast("string").alias("source"), *keep, F.col(text).alias("text"),
    )
    kept = ", ".join(f"{k} long" for k in keep)
    schema = "doc_id long, lang string, source string, " + kept + ", " * bool(kept) + ", ".join(f"{c} long" for c in COUNTS)
    return narrow.mapInArrow(count, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def values() -> list[Column]:
    return [F.when(~base_failed(), F.expr(m.value)).alias(m.name) for m in MEASURES]


def bin_floor(value: Column) -> Column:
    """The value with all but its leading bits cleared."""
    drop = F.greatest(F.length(F.bin(value)) - PRECISION, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketches(counts: DataFrame) -> Staged:
    """(lang, source, measure, bin, n): the sketches of all groups."""
    long = counts.where(~base_failed()).select("lang", "source", *values()).unpivot(
        ["lang", "source"], [m.name for m in MEASURES], "measure", "value"
    )
    merged = long.groupBy("lang", "source", "measure", bin_floor(F.col("value")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return stage(merged, "sketches")


def quartiles(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, measure, size, low, high): quartiles of the merged sketches."""
    merged = sketch.groupBy(*groups, "measure", "bin").agg(F.sum("n").alias("n"))
    by = Window.partitionBy(*groups, "measure")
    ranked = merged.withColumn("size", F.sum("n").over(by)).withColumn("seen", F.sum("n").over(by.orderBy("bin")))
    return ranked.groupBy(*groups, "measure", "size").agg(
        F.min(F.when(4 * F.col("seen") >= F.col("size"), F.col("bin"))).alias("low"),
        F.min(F.when(4 * F.col("seen") >= 3 * F.col("size"), F.col("bin"))).alias("high"),
    )


def thresholds(sketch: Staged, min_group: int = MIN_GROUP) -> Staged:
    """(lang, source, measure, least, most) for every group of the sketch."""
    known = ("size", "low", "high")
    level = {
        "own": quartiles(sketch.df, ["lang", "source"]),
        "lang": quartiles(sketch.df, ["lang"]),
        "all": quartiles(sketch.df, []),
    }
    named = {k: q.select(*[c for c in q.columns if c not in known], *[F.col(c).alias(f"{k}_{c}") for c in known]) for k, q in level.items()}
    joined = named["own"].alias("o").join(
        named["lang"].alias("l"),
        (F.col("o.measure") == F.col("l.measure")) & F.col("o.lang").eqNullSafe(F.col("l.lang")), "left",
    ).join(F.broadcast(named["all"]).alias("a"), F.col("o.measure") == F.col("a.measure"), "left")  # one row per measure

    def pick(column: str) -> Column:
        return (
            F.when(F.col("own_size") >= min_group, F.col(f"own_{column}"))
            .when(F.col("lang_size") >= min_group, F.col(f"lang_{column}"))
            .otherwise(F.col(f"all_{column}"))
        )

    spread = F.lit(0)
    two_sided = F.lit(False)
    for m in MEASURES:
        spread = F.when(F.col("o.measure") == m.name, m.spread).otherwise(spread)
        two_sided = F.when(F.col("o.measure") == m.name, m.two_sided).otherwise(two_sided)
    reach = REACH * F.greatest(pick("high") - pick("low"), spread)
    return stage(
        joined.select(
            F.col("o.lang").alias("lang"), F.col("o.source").alias("source"), F.col("o.measure").alias("measure"),
            F.when(two_sided, pick("low") - reach).alias("least"), (pick("high") + reach).alias("most"),
        ).groupBy("lang", "source").pivot("measure", [m.name for m in MEASURES]).agg(
            F.first("least").alias("least"), F.first("most").alias("most")
        ),
        "thresholds",
    )


def judged(counts: DataFrame, limits: Staged) -> DataFrame:
    """``counts`` with base_failed and kept."""
    inside = F.lit(True)
    for m in MEASURES:
        value = F.expr(m.value)
        slack = F.floor(m.noise / F.sqrt("n_words"))
        inside = inside & F.coalesce(value - slack <= F.col(f"{m.name}_most"), F.lit(True))
        inside = inside & F.coalesce(value + slack >= F.col(f"{m.name}_least"), F.lit(True))
    table = limits.for_broadcast().withColumnsRenamed({"lang": "_lang", "source": "_source"})
    match = counts["lang"].eqNullSafe(F.col("_lang")) & counts["source"].eqNullSafe(F.col("_source"))
    return counts.join(table, match, "left").withColumn("base_failed", base_failed()).withColumn(
        "kept", F.when(base_failed(), False).otherwise(inside)
    )


def quality(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
    min_group: int = MIN_GROUP,
) -> DataFrame:
    """Per row: the counts, base_failed, and whether the document is kept."""
    counts = stage(measured(docs, doc_id, text, lang, source), "counts").df
    limits = thresholds(sketches(counts), min_group)
    # The contract's columns first; the two further counts follow them.
    return judged(counts, limits).select("doc_id", *COUNTS[:5], "base_failed", "kept", *COUNTS[5:])


def keep_good(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
    min_group: int = MIN_GROUP,
) -> DataFrame:
    """Rows of ``docs`` that are kept, with all their columns.

    Rejected rows are few and are looked up by id and text; the counts don't
    travel with the texts.
    """
    k1, k2 = text_key(F.col(f"row.{text}"))
    keyed = packed(docs).withColumns({
        "_id": F.col(f"row.{doc_id}"), "_text": F.col(f"row.{text}"), "_lang": F.col(f"row.{lang}").cast("string"),
        "_source": F.col(f"row.{source}").cast("string"), "_k1": k1, "_k2": k2,
    })
    counts = stage(measured(keyed, "_id", "_text", "_lang", "_source", ("_k1", "_k2")), "counts").df
    bad = judged(counts, thresholds(sketches(counts), min_group)).where("NOT kept").select(
        F.col("doc_id").alias("_d"), F.col("_k1").alias("_b1"), F.col("_k2").alias("_b2"),
        F.col("lang").alias("_bl"), F.col("source").alias("_bs"),
    )
    rejected = stage(bad.distinct(), "rejected").for_broadcast()
    match = (
        keyed["_id"].eqNullSafe(rejected["_d"]) & (keyed["_k1"] == rejected["_b1"]) & (keyed["_k2"] == rejected["_b2"])
        & keyed["_lang"].eqNullSafe(rejected["_bl"]) & keyed["_source"].eqNullSafe(rejected["_bs"])
    )
    return keyed.join(rejected, match, "left_anti").select("row.*")

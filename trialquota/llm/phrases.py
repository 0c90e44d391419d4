"""Collocations: frequent phrases of two to four words, mined by Toivonen's method.

Texts are lower-cased (A-Z), split into pieces at ``PIECE_BREAKS`` and pieces
into words at runs of spaces and tabs.  All counting is per language (null:
``und``).  ``f(p)`` is the number of contiguous occurrences of phrase ``p``
within pieces, overlaps included; a phrase is frequent when ``f >= MIN_COUNT``.

Toivonen's method: a seeded sample of ``SAMPLE`` of the texts proposes the
phrases frequent in it at a lowered threshold.  One full pass then counts,
exactly, every occurring phrase whose two sub-phrases of one word fewer are
proposed (single words are counted whole, so every two-word phrase of frequent
words is counted).  What is counted but was not proposed is the negative
border.  A border phrase that turns out frequent is a failure of the sample:
it joins the proposed set and a further pass counts exactly the phrases that
only now have both sub-phrases in it, until no failure is left.  A phrase is
frequent only if both its sub-phrases are, so the result is exact whatever the
sample holds; the sample only decides how much the full passes filter out
before they shuffle.

Words go by 64 bits of their language and spelling, phrases by the keys of both
sub-phrases (128 bits).  A pass reads the texts once more in Arrow batches and
counts phrases within a slice before they reach Spark, so a very frequent phrase
is never gathered row by row.  The proposed set goes to the tasks as a bitmap of
bounded size: it lets all proposed phrases through, and some others, which are
then counted exactly as well.  Only frequent phrases are spelled out at the end.
A candidate (2 to 4 words,
``f >= MIN_COUNT``) is scored at its weakest cut, ``floor(2000000 a / (l + r))``
in exact decimal arithmetic; candidates inside a longer candidate that keeps 80%
of their count are dropped; each language reports its first ``TOP`` phrases by
score, count and phrase, chosen per hash bucket first and then per language.

Defined cases: a null text has no words; a null language is ``und``; empty and
very long texts are counted whole; repeated rows count again; ties are broken
by the phrase (UTF-8 byte order); an empty table gives no rows; columns other
than text and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from trialquota.llm.common import Staged, stage
from trialquota.llm.repeats import text_bytes
from trialquota.llm.wordcodes import slices

# Fixed by the contract: piece breaks, word breaks, the smallest count, the score scale, the report size, phrase lengths.
PIECE_BREAKS = b".,;:!?\n\v\f\r"
WORD_BREAKS = b" \t"
MIN_COUNT = 30
SCALE = 2_000_000
TOP = 2000
SHORTEST, LONGEST = 2, 4
CONTAINED_SHARE = (100, 80)
#: Of each byte: 0 inside a word, 1 between words, 2 between pieces; and its lower case (A-Z).
KINDS = np.zeros(256, np.uint8)
KINDS[list(WORD_BREAKS)], KINDS[list(PIECE_BREAKS)] = 1, 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Share of texts in the sample, its seed, and the share of MIN_COUNT * SAMPLE a phrase needs in it to be proposed.
SAMPLE = 0.1
SEED = 11
LOWERED = 0.7
BUCKETS = 64
SLICE_BYTES = 4 << 20
#: Bits of a filter for each key, and the logarithm of its largest size (2 ** 27 bits are 16 MB).
FILTER_BITS = 32
LARGEST_FILTER = 27
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _ODD[0]
    h = (h ^ (h >> np.uint64(29))) * _ODD[1]
    return h ^ (h >> np.uint64(32))


def phrase_keys(prefix: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Keys of the phrases made of a prefix (all words but the last) and a suffix (all but the first).

    The last two bits of a key hold the number of words: 1 to 3, and 0 for four.
    """
    number = ((prefix & np.uint64(3)) + np.uint64(1)) & np.uint64(3)
    return (mixed(prefix * _ODD[2] + suffix * _ODD[3]) & ~np.uint64(3)) | number


@dataclass(frozen=True)
class Words:
    """The words of some texts in order: code of each, its piece (rising over the texts), its language and its key."""

    codes: np.ndarray
    distinct: pa.Array
    piece: np.ndarray
    langs: pa.Array
    lang: np.ndarray
    keys: np.ndarray


def words_of(texts: pa.Array, langs: pa.Array) -> Words:
    data, ends = text_bytes(texts)
    kind = KINDS[data]
    inside = kind == 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = ends[:-1][ends[:-1] < ends[1:]]
    begins[firsts] = inside[firsts]
    at, kept = np.flatnonzero(begins), LOWER[data[inside]]
    offsets = np.append(np.flatnonzero(begins[inside]), len(kept)).astype(np.int32)
    strings = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(kept))
    coded, named = strings.dictionary_encode(), langs.dictionary_encode()
    text = np.searchsorted(ends[1:], at, side="right")
    breaks = np.flatnonzero(kind == 2)
    piece = np.searchsorted(breaks, at) + text
    codes, lang = coded.indices.to_numpy(), named.indices.to_numpy()[text]
    hashed, seeds = (
        np.fromiter(map(xxhash.xxh3_64_intdigest, column.to_pylist()), np.uint64, len(column))
        for column in (coded.dictionary, named.dictionary)
    )
    keys = mixed(hashed[codes] + seeds[lang] * _ODD[3])
    return Words(codes, coded.dictionary, piece, named.dictionary, lang, (keys & ~np.uint64(3)) | np.uint64(1))


def sources(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("`lang`"), F.lit("und")).alias("lang"), F.coalesce(F.col("`text`"), F.lit("")).alias("text")
    )


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, phrase, key, f): every word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text", SLICE_BYTES):
                found = words_of(texts, part.column("lang"))
                pairs = found.codes.astype(np.int64) * len(found.langs) + found.lang
                pairs, first, times = np.unique(pairs, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        found.langs.take(pa.array(found.lang[first])), found.distinct.take(pa.array(found.codes[first])),
                        pa.array(found.keys[first].view(np.int64)), pa.array(times.astype(np.int64)),
                    ],
                    names=["lang", "phrase", "key", "c"],
                )

    counted = sources(docs).mapInArrow(count, "lang string, phrase string, key long, c long")
    return counted.groupBy("lang", "phrase", "key").agg(F.sum("c").alias("f"))


def bitmap(keys: Staged) -> Broadcast:
    """A set of keys as a bitmap of bounded size, for the tasks: it holds all of them, and some others as well."""
    bits = 1 << min(max(FILTER_BITS * keys.rows, 1 << 16).bit_length(), LARGEST_FILTER)
    spot = F.col("key").bitwiseAND(F.lit(bits - 1))
    marked = keys.df.groupBy(F.shiftright(spot, 6).alias("at")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), spot.bitwiseAND(F.lit(63)).cast("int"))).alias("marks")
    ).toArrow()
    found = np.zeros(bits >> 6, np.uint64)
    found[marked.column("at").to_numpy()] = marked.column("marks").to_numpy().view(np.uint64)
    return keys.df.sparkSession.sparkContext.broadcast(found)


def member(keys: np.ndarray, marks: np.ndarray) -> np.ndarray:
    spot = keys & np.uint64((len(marks) << 6) - 1)
    return (marks[spot >> np.uint64(6)] >> (spot & np.uint64(63))) & np.uint64(1) == 1


def gram_counts(docs: DataFrame, allowed: Broadcast, longest: int, least: int, fresh: Broadcast | None = None, closed: bool = False) -> DataFrame:
    """(k, p, s, key, f): phrases of 2 to ``longest`` words with ``f >= least``, by the keys of prefix, suffix and whole.

    Both sub-phrases must be in ``allowed`` and, with ``fresh``, one of them in
    that too.  With ``closed`` only words are looked up in ``allowed``, and a
    longer phrase stands when its sub-phrases do.  The filters let some other
    phrases through as well; these are counted whole too.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, new = allowed.value, fresh.value if fresh else None
        for batch in batches:
            for part, texts in slices(batch, "text", SLICE_BYTES):
                found = words_of(texts, part.column("lang"))
                keys, piece = found.keys, found.piece
                stands = member(keys, known)
                for k in range(SHORTEST, longest + 1):
                    whole = phrase_keys(keys[:-1], keys[1:])
                    hit = (piece[k - 1 :] == piece[: len(whole)]) & stands[:-1] & stands[1:]
                    chosen = np.flatnonzero(hit)
                    if new is not None:
                        chosen = chosen[member(keys[chosen], new) | member(keys[chosen + 1], new)]
                    order = chosen[np.argsort(whole[chosen])]
                    first = np.flatnonzero(np.concatenate([[True], np.diff(whole[order]) != 0])) if len(order) else order
                    times, one = np.diff(np.append(first, len(order))), order[first]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[one].view(np.int64)), pa.array(keys[one + 1].view(np.int64)), pa.array(times)],
                        names=["p", "s", "c"],
                    )
                    if closed:
                        stands = hit
                    else:
                        stands, at = np.zeros(len(hit), bool), np.flatnonzero(hit)
                        stands[at] = member(whole[at], known)
                    keys = whole

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, s = (batch.column(c).to_numpy().view(np.uint64) for c in ("p", "s"))
            k = (p & np.uint64(3)).astype(np.int32) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(k), batch.column("p"), batch.column("s"), pa.array(phrase_keys(p, s).view(np.int64)), batch.column("f")],
                names=["k", "p", "s", "key", "f"],
            )

    counted = sources(docs).mapInArrow(count, "p long, s long, c long").groupBy("p", "s").agg(F.sum("c").alias("f"))
    return counted.where(F.col("f") >= least).mapInArrow(named, "k int, p long, s long, key long, f long")


def spelled(singles: DataFrame, grams: DataFrame) -> DataFrame:
    """(lang, k, phrase, f): the frequent phrases in words; a phrase is its prefix and the last word of its suffix."""
    known = singles.select("key", "lang", "phrase", F.col("phrase").alias("last"), "f")
    union = singles.select("lang", F.lit(1).alias("k"), "phrase", "f")
    for k in range(SHORTEST, LONGEST + 1):
        prefix = known.select(F.col("key").alias("p"), "lang", F.col("phrase").alias("head"))
        suffix = known.select(F.col("key").alias("s"), "last")
        named = grams.where(F.col("k") == k).join(prefix, "p").join(suffix, "s")
        known = stage(named.select("key", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "f"), f"phrases-of-{k}").df
        union = union.unionByName(known.select("lang", F.lit(k).alias("k"), "phrase", "f"))
    return union


def frequent_phrases(docs: DataFrame) -> tuple[DataFrame, DataFrame, dict]:
    """All phrases of 1 to 4 words with ``f >= MIN_COUNT`` (lang, k, phrase, f), word totals (lang, n), and pass figures."""
    words = stage(word_counts(docs), "phrases-words").df
    totals = stage(words.groupBy("lang").agg(F.sum("f").alias("n")), "phrases-totals").df
    singles = words.where(F.col("f") >= MIN_COUNT)
    keys = stage(singles.select("key").distinct(), "phrases-word-keys")

    least = max(1, int(LOWERED * MIN_COUNT * SAMPLE))
    drawn = F.pmod(F.xxhash64(F.lit(SEED), F.coalesce(F.col("`text`"), F.lit(""))), F.lit(1_000_000)) < int(SAMPLE * 1_000_000)
    sampled = gram_counts(docs.where(drawn), bitmap(keys), LONGEST - 1, least, closed=True)
    proposed = stage(sampled.select("key").distinct(), "phrases-proposed")
    allowed = stage(keys.df.unionByName(proposed.df).distinct(), "phrases-allowed")
    figures = {"proposed": proposed.rows, "passes": 0, "failures": 0}
    found, fresh = None, None
    while True:
        marks = bitmap(allowed)
        late = bitmap(fresh) if fresh else None
        more = stage(gram_counts(docs, marks, LONGEST, MIN_COUNT, late), "phrases-counts").df
        # What a filter let through may be counted in two passes, alike in both.
        found = more if found is None else found.unionByName(more).dropDuplicates(["p", "s"])
        figures["passes"] += 1
        for used in (marks, late):
            if used:
                used.destroy()
        hits = more.where(F.col("k") < LONGEST).select("key").distinct()
        fresh = stage(hits.join(allowed.df, "key", "left_anti"), "phrases-failures")
        if not fresh.rows:
            break
        figures["failures"] += fresh.rows
        allowed = stage(allowed.df.unionByName(fresh.df), "phrases-allowed")
    return stage(spelled(singles, found), "phrases-frequent").df, totals, figures


def scored(frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """Candidates with their weakest cut, without those contained in a longer candidate of nearly their count."""
    cands = frequent.where(F.col("k") >= SHORTEST).select("lang", "k", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = cands.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("j")).select(
        "lang", "phrase", "a", "j", F.array_join(F.slice("w", 1, F.col("j")), " ").alias("left"),
        F.array_join(F.slice("w", F.col("j") + 1, F.col("k")), " ").alias("right"),
    )
    lookup = frequent.select("lang", "phrase", "f")
    cuts = (
        cuts.join(lookup.withColumnRenamed("phrase", "left").withColumnRenamed("f", "l"), ["lang", "left"])
        .join(lookup.withColumnRenamed("phrase", "right").withColumnRenamed("f", "r"), ["lang", "right"])
        .withColumn("score", F.expr(f"CAST(CAST(a AS DECIMAL(38,0)) * {SCALE} DIV (l + r) AS BIGINT)"))
    )
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "j", "l", "r")).alias("b")).select(
        "lang", "phrase", "a", "b.l", "b.r", "b.score"
    )
    inner = cands.where(F.col("k") > SHORTEST).select(
        "lang", "a", "w", F.explode(F.sequence(F.lit(SHORTEST), F.col("k") - 1)).alias("m")
    ).select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("m"))).alias("s"))
    inner = inner.groupBy("lang", F.array_join(F.slice("w", F.col("s") + 1, F.col("m")), " ").alias("phrase")).agg(
        F.max("a").alias("outer")
    )
    hundred, share = CONTAINED_SHARE
    kept = best.join(inner, ["lang", "phrase"], "left").where(
        F.col("outer").isNull() | (F.col("outer") * hundred < F.col("a") * share)
    )
    return kept.join(totals, "lang").drop("outer")


def top_phrases(ranked: DataFrame, top: int = TOP) -> DataFrame:
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    bucket = F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS))
    first = ranked.withColumn("_b", bucket).withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_b").orderBy(*order)))
    first = first.where(F.col("_r") <= top).drop("_b", "_r")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(
        F.col("rank") <= top
    )


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` collocations."""
    frequent, totals, _ = frequent_phrases(docs)
    return top_phrases(scored(frequent, totals), top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

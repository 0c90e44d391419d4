"""Fuzzy line deduplication in DataFrame operations only.

A line is normalised by trimming it and folding its case; its words are what
single spaces separate, without those of one character: a separator would
outweigh the words it stands between.  Lines of at least ``min_chars`` characters take part;
equal normalised lines are one class from the start.  Two
classes are linked when their 64-bit SimHashes differ in at most three bits and
the edit similarity of their words is at least ``SIMILARITY``: the distance
counts words inserted, deleted or replaced, against the longer line.  For it
each word is turned into one of 20,000 characters by its hash.  Of
each connected group the first occurrence stays, by document id (null last),
text key and position.

The bits are cut into five blocks, so fingerprints within three bits agree on
two whole blocks: each fingerprint is filed under its ten pairs of blocks.
In a pair of blocks with
up to ``CROWD`` fingerprints all pairs meet; in a larger one each meets only the
least.  After these links are verified, only pairs that are still in different
groups meet, so a dense group does not spread into all its pairs, and no link
that matters is lost.

Defined cases: a null text counts as empty and stays as it is; shorter lines
are never removed; repeated rows share one list of removed lines, and the
first keeps its lines as all of them do; a text that loses all lines becomes
empty; other columns pass through.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from trialquota.llm.common import Staged, bit_sums, components, hamming, majority_bits, packed, stage, text_key

MIN_CHARS = 12
BITS = 3
SIMILARITY = 0.8
CROWD = 64
CUTS = (0, 13, 26, 39, 52, 64)
KEYS = ["_k1", "_k2"]
RUN = 7  # words that counters of four bits hold without touching the sign of a long
COUNTERS = {8: 63, 16: 16383}  # bits of a counter, and the most words it is used for: 2 ** (bits - 2) - 1 at most


def raw_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def normalised(line: Column) -> Column:
    """The line trimmed and folded; trimming costs much, so only lines with something to trim pay for it."""
    trims = [test(F.lit(c)) for c in " \t\r" for test in (line.startswith, line.endswith)]
    return F.lower(F.when(reduce(Column.__or__, trims), F.btrim(line, F.lit(" \t\r"))).otherwise(line))


def keyed_lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, _k1, _k2, pos, norm) of every line."""
    # The keys in a step of their own: beside the generator each text would be hashed again for each of its lines.
    keyed = docs.select(F.col(doc_id).alias("doc_id"), *text_key(F.col(text)), F.col(text).alias("_text"))
    folded = F.transform(raw_lines(F.col("_text")), normalised)
    return keyed.select("doc_id", *KEYS, F.posexplode(folded).alias("pos", "norm"))


def document_lines(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """(doc_id, _k1, _k2, pos, norm, h1, h2, bytes, line): lines long enough, each with a number; h1 and h2 stand for norm."""
    lines = keyed_lines(docs, doc_id, text).where(F.char_length("norm") >= min_chars)
    hashed = {"h1": F.xxhash64("norm"), "h2": F.xxhash64(F.lit(7), F.col("norm"))}
    return lines.withColumns(hashed | {"bytes": F.octet_length("norm"), "line": F.monotonically_increasing_id()})


def word_characters(norm: Column) -> Column:
    """One character for each word of a line."""

    def digits(word: Column) -> Column:
        return F.hex(F.pmod(F.xxhash64(word), F.lit(20_000)) + 0x4E00)

    return F.decode(F.unhex(F.array_join(F.transform(F.split(norm, " ", -1), digits), "")), "UTF-16BE")


def long_prints(lines: DataFrame) -> DataFrame:
    """(h1, h2, fp, n, parts, at) of each distinct line, each bit counted word by word."""
    words = lines.select("line", "h1", "h2", F.posexplode(F.split("norm", " ", -1)).alias("_i", "word"))
    begins = (F.col("_i") == 0).cast("int").alias("begins")
    hashed = words.select("line", "h1", "h2", "_i", begins, F.when(F.char_length("word") > 1, F.xxhash64("word")).alias("h"))
    # Occurrences of a line add alike to the bits and to their number, so the majority holds.
    of_line = [F.count("h").alias("m"), F.sum("begins").alias("n"), (F.max("_i") + 1).alias("parts"), F.min("line").alias("at")]
    summed = hashed.groupBy("h1", "h2").agg(*of_line, *bit_sums(F.col("h")))
    fp = F.when(F.col("m") > 0, majority_bits(F.col("m"))).otherwise(F.col("h1")).alias("fp")
    return summed.select("h1", "h2", fp, "n", "parts", "at")


def counted_prints(lines: DataFrame, width: int) -> DataFrame:
    """(h1, h2, fp, n, parts, at) of each occurrence of a line of few enough words for counters of ``width`` bits.

    ``RUN`` words are added in four longs of sixteen counters each, and the runs of
    a line in ``width`` longs.  No branch for each bit: the JVM leaves so long a method uncompiled.
    Words are hashed as columns, not in lambdas, which Spark interprets word by word.
    """
    words = lines.select("line", "h1", "h2", F.split("norm", " ", -1).alias("words"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(RUN))
    runs = words.select("line", "h1", "h2", F.size("words").alias("parts"), "words", F.explode(starts).alias("_i"))
    keys, names = ["line", "h1", "h2", "parts"], [f"_w{j}" for j in range(RUN)]
    each = runs.select(*keys, *[F.get("words", F.col("_i") + j).alias(n) for j, n in enumerate(names)])
    counts = [F.char_length(n) > 1 for n in names]
    m = reduce(Column.__add__, [F.when(c, 1).otherwise(0) for c in counts]).alias("m")
    hashed = each.select(*keys, m, *[F.when(c, F.xxhash64(n)).otherwise(F.lit(0).cast("long")).alias(n) for c, n in zip(counts, names)])
    fours, ones = F.lit(0x1111111111111111), sum(1 << at for at in range(0, 64, width))
    quarters = [reduce(Column.__add__, [F.shiftrightunsigned(n, i).bitwiseAND(fours) for n in names]).alias(f"_r{i}") for i in range(4)]
    counted = hashed.select(*keys, "m", *quarters)
    # The i-th sum counts the bits i, i + width and so on.
    sums = [F.sum(F.shiftrightunsigned(f"_r{i % 4}", i // 4 * 4).bitwiseAND(F.lit(15 * ones))) for i in range(width)]
    summed = counted.groupBy(*keys).agg(F.sum("m").alias("m"), *[F.coalesce(x, F.lit(0)).alias(f"_s{i}") for i, x in enumerate(sums)])
    # Twice a count, less the words, plus the most of COUNTERS, has the bit below the top just where over half of them have it.
    rest = (F.lit((1 << width - 2) - 1) - F.col("m")) * F.lit(ones)
    bits = [F.shiftleft(F.shiftrightunsigned(F.col(f"_s{i}") * 2 + rest, width - 2).bitwiseAND(F.lit(ones)), i) for i in range(width)]
    fp = F.when(F.col("m") > 0, reduce(Column.bitwiseOR, bits)).otherwise(F.col("h1")).alias("fp")
    return summed.select("h1", "h2", fp, F.lit(1).cast("long").alias("n"), "parts", F.col("line").alias("at"))


def line_classes(lines: DataFrame) -> Staged:
    """(h1, h2, fp, n, parts, at): fingerprint, occurrences, parts between spaces and one line of each distinct line."""
    prints, above = [], -1
    for width, most in COUNTERS.items():
        # Words of two bytes or more and the spaces between them: so many bytes hold at most ``most`` words.
        fits = 3 * most - 1
        prints.append(counted_prints(lines.where(f"bytes > {above} AND bytes <= {fits}"), width))
        above = fits
    prints = reduce(DataFrame.unionByName, [*prints, long_prints(lines.where(f"bytes > {above}"))])
    once = [F.min("fp").alias("fp"), F.sum("n").alias("n"), F.min("parts").alias("parts"), F.min("at").alias("at")]
    return stage(prints.groupBy("h1", "h2").agg(*once), "line-classes")


def block_keys(fp: Column) -> Column:
    """Array of keys, one for each pair of blocks."""
    keys = []
    for number, pair in enumerate(combinations(range(len(CUTS) - 1), 2)):
        key, shift = F.lit(number).cast("long"), 4
        for block in pair:
            width = CUTS[block + 1] - CUTS[block]
            part = F.shiftrightunsigned(fp, CUTS[block]).bitwiseAND(F.lit((1 << width) - 1))
            key, shift = key.bitwiseOR(F.shiftleft(part, shift)), shift + width
        keys.append(key)
    return F.array(*keys)


def crowded_blocks(prints: DataFrame) -> Staged:
    """(key, fp, least, n): of distinct fingerprints those that share a pair of blocks with others, n in all."""
    filed = prints.select("fp", F.explode(block_keys(F.col("fp"))).alias("key"))
    # Nearly every key is its own group: sorting once costs less than counting the groups and joining.
    own = Window.partitionBy("key")
    met = filed.withColumns({"least": F.min("fp").over(own), "n": F.count(F.lit(1)).over(own)})
    return stage(met.where("n > 1"), "crowded-blocks")


def close(a: str, b: str) -> Column:
    return hamming(F.col(a), F.col(b)) <= BITS


def most_edits(a: Column, b: Column) -> Column:
    """The edits allowed between lines of so many words."""
    return F.floor((1 - SIMILARITY) * F.greatest(a, b) + 1e-9).cast("int")


def alike_in_length(a: str, b: str) -> Column:
    """Whether lines of ``a`` and ``b`` words can be within the edits allowed: these are at least the difference."""
    return F.abs(F.col(a) - F.col(b)) <= most_edits(F.col(a), F.col(b))


def verified(pairs: DataFrame, texts: DataFrame) -> Staged:
    """Pairs (a, b) of lines whose edit similarity reaches the bound."""
    ends = stage(pairs.select(F.col("a").alias("h1")).unionByName(pairs.select(F.col("b").alias("h1"))).distinct(), "paired-lines")
    paired = texts.join(ends.for_broadcast(), "h1", "left_semi")
    texts = stage(paired.select("h1", word_characters(F.col("norm")).alias("words")), "line-words").df
    found = pairs.join(texts.select(F.col("h1").alias("a"), F.col("words").alias("wa")), "a").join(
        texts.select(F.col("h1").alias("b"), F.col("words").alias("wb")), "b"
    )
    limit = most_edits(F.char_length("wa"), F.char_length("wb"))
    distance = F.call_function("levenshtein", F.col("wa"), F.col("wb"), F.col("limit"))
    return stage(found.withColumn("limit", limit).where(distance >= 0).select("a", "b"), "line-links")


def line_groups(docs_lines: DataFrame, classes: Staged) -> DataFrame:
    """(line, root) for every line that is linked to another; a line goes by its first hash."""
    members = classes.df.select("fp", F.col("h1").alias("line"), "parts", "at")
    # Written once: the blocks, the twins and the lines near others all start from the distinct fingerprints.
    prints = stage(members.groupBy("fp").agg(F.min("line").alias("head"), F.count(F.lit(1)).alias("lines")), "fingerprints")
    heads, blocks = prints.df, crowded_blocks(prints.df)
    crowded = blocks.df
    a, b = crowded.where(f"n <= {CROWD}").alias("a"), crowded.where(f"n <= {CROWD}").alias("b")
    few = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & close("a.fp", "b.fp"))
    many = crowded.where(f"n > {CROWD}")
    stars = many.where((F.col("fp") != F.col("least")) & close("fp", "least"))
    twins = heads.where("lines > 1").select(F.col("fp").alias("fa"), F.col("fp").alias("fb"))
    near = stage(
        few.select(F.col("a.fp").alias("fa"), F.col("b.fp").alias("fb"))
        .unionByName(stars.select(F.col("least").alias("fa"), F.col("fp").alias("fb")))
        .unionByName(twins).distinct(),
        "near-fingerprints",
    ).df
    met = near.select(F.col("fa").alias("fp")).unionByName(near.select(F.col("fb").alias("fp"))).unionByName(many.select("fp"))
    placed = stage(members.join(met.distinct(), "fp", "left_semi").join(heads, "fp"), "near-lines")
    wanted = stage(placed.df.select(F.col("at").alias("line")), "wanted-lines")
    texts = stage(docs_lines.select("line", "h1", "norm").join(wanted.for_broadcast(), "line", "left_semi").drop("line"), "line-texts")

    def sides(pairs: DataFrame, lines: DataFrame) -> DataFrame:
        """Lines of both fingerprints of each pair."""
        left = lines.select(*[F.col(c).alias(f"{c}_a") for c in lines.columns])
        right = lines.select(*[F.col(c).alias(f"{c}_b") for c in lines.columns])
        return pairs.join(left, F.col("fa") == F.col("fp_a")).join(right, F.col("fb") == F.col("fp_b"))

    # At first the least line of a fingerprint stands for it.
    first = sides(near, placed.df.drop("at")).where(
        (F.col("line_a") != F.col("line_b")) & alike_in_length("parts_a", "parts_b") & ((F.col("line_a") == F.col("head_a")) | (F.col("line_b") == F.col("head_b")) & (F.col("fa") != F.col("fb")))
    )
    first = stage(first.select(F.col("line_a").alias("a"), F.col("line_b").alias("b")).distinct(), "first-pairs").df
    links = verified(first, texts.df).df
    rooted = components(links, "line-groups").df.withColumnRenamed("node", "line")
    grouped = stage(
        placed.df.join(rooted, "line", "left").select("fp", "line", "parts", "lines", F.coalesce("root", "line").alias("root")), "placed-lines"
    ).df
    # A fingerprint whose lines are all in one group need not meet others of that group again.
    ends = grouped.groupBy("fp").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.first("lines").alias("lines"))
    spots = many.select("key", "fp").join(ends, "fp")
    a, b = spots.alias("a"), spots.alias("b")
    apart = (F.col("a.low") != F.col("a.high")) | (F.col("b.low") != F.col("b.high")) | (F.col("a.low") != F.col("b.low"))
    meets = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & apart & close("a.fp", "b.fp"))
    plural = ends.where("lines > 1").select("fp")
    again = near.join(plural, F.col("fa") == F.col("fp"), "left_semi").unionByName(near.join(plural, F.col("fb") == F.col("fp"), "left_semi"))
    pairs = meets.select(F.col("a.fp").alias("fa"), F.col("b.fp").alias("fb")).unionByName(again).distinct()
    second = sides(pairs, grouped).where(
        (F.col("root_a") != F.col("root_b")) & alike_in_length("parts_a", "parts_b") & ((F.col("fa") != F.col("fb")) | (F.col("line_a") < F.col("line_b")))
    )
    second = second.select(F.col("line_a").alias("a"), F.col("line_b").alias("b"))
    second = stage(second.join(first, ["a", "b"], "left_anti"), "second-pairs")
    more = verified(second.df, texts.df) if second.rows else second
    for read in (prints, blocks, texts):
        read.drop()
    if not more.rows:
        return rooted
    return components(links.unionByName(more.df), "line-groups").df.withColumnRenamed("node", "line")


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> Staged:
    """(_d, _k1, _k2, drops): sorted positions of the lines to remove from each text that loses any."""
    # Written once: splitting and folding cost more than reading the lines back, and
    # what is computed for a line is not computed again for each of its words.
    written = stage(document_lines(docs, doc_id, text, min_chars), "lines")
    lines = written.df
    classes = line_classes(lines)
    grouped = line_groups(lines, classes)
    root = F.coalesce("root", "line").alias("root")
    repeated = classes.df.select(F.col("h1").alias("line"), "h2", "n").join(grouped, "line", "left").where(
        (F.col("n") > 1) | F.col("root").isNotNull()
    )
    repeated = stage(repeated.select(F.col("line").alias("h1"), "h2", root), "repeated-lines")
    at = lines.select("doc_id", *KEYS, "pos", "h1", "h2").join(repeated.for_broadcast(), ["h1", "h2"])
    places = stage(at.select("doc_id", *KEYS, "pos", "root"), "repeated-places").df
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *KEYS, "pos")
    kept = places.groupBy("root").agg(F.min(order).alias("first")).select(
        *[F.col(f"first.{c}").alias(c) for c in ("doc_id", *KEYS, "pos")], F.lit(1).alias("keep")
    )
    flagged = places.select("doc_id", *KEYS, "pos", F.lit(0).alias("keep")).unionByName(kept)
    by_line = flagged.groupBy("doc_id", *KEYS, "pos").agg(F.max("keep").alias("keep")).where("keep = 0")
    drops = by_line.groupBy("doc_id", *KEYS).agg(F.array_sort(F.collect_list("pos")).alias("drops"))
    done = stage(drops.withColumnRenamed("doc_id", "_d"), "line-drops")
    # Nothing reads these again, and the texts are shuffled next.
    written.drop()
    classes.drop()
    return done


def without(lines: Column, drops: Column) -> Column:
    """``lines`` without the positions in the sorted array ``drops``, in linear time."""
    runs = F.transform(
        F.sequence(F.lit(0), F.size(drops)),
        lambda j: F.slice(
            lines,
            F.coalesce(F.get(drops, j - 1), F.lit(-1)) + 2,
            F.coalesce(F.get(drops, j), F.size(lines)) - F.coalesce(F.get(drops, j - 1), F.lit(-1)) - 1,
        ),
    )
    return F.flatten(runs)


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with repeated lines removed from the text, plus _n_lines and _n_removed."""
    drops = repeated_lines(docs, doc_id, text, min_chars).df
    own = F.col(f"row.{text}")
    k1, k2 = text_key(own)
    keyed = packed(docs).withColumns({"_id": F.col(f"row.{doc_id}"), "_t1": k1, "_t2": k2})
    match = keyed["_id"].eqNullSafe(drops["_d"]) & (keyed["_t1"] == drops["_k1"]) & (keyed["_t2"] == drops["_k2"])
    joined = keyed.join(drops, match, "left")
    gone = F.col("drops")
    # A column of its own: inside the lambda the text would be split again for each run of lines.
    joined = joined.withColumn("_lines", F.when(gone.isNotNull(), raw_lines(own)))
    full = F.coalesce(own, F.lit(""))
    breaks = F.octet_length(full) - F.octet_length(F.replace(full, F.lit("\n"), F.lit("")))
    n_lines = F.when(gone.isNull(), breaks + 1).otherwise(F.size("_lines"))
    shorter = F.when(gone.isNull(), own).otherwise(F.array_join(without(F.col("_lines"), gone), "\n"))
    removed = F.when(gone.isNull(), 0).otherwise(F.size(gone)).cast("long")
    kept = [shorter.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return joined.select(*kept, n_lines.cast("long").alias("_n_lines"), removed.alias("_n_removed"))


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """Per row: lines, lines removed, and the digest of the text that is left."""
    left = drop_repeated_lines(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), min_chars=min_chars)
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return left.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), digest.alias("kept_sha256"))

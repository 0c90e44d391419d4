"""SimHash near-duplicates linked by multi-index hashing.

``simhash_components`` links at three bits.  ``drop_near_duplicates`` links by
the similarity of the shingles themselves, with these components as hints.

The fingerprint of a text is the bitwise majority of the XXH64 values of its
word shingles.  Work on links is done over distinct fingerprints only.

* Links of up to two bits: two fingerprints are that close exactly when their
  balls of radius one share a point.  Each fingerprint is sent to the 65 points
  of its ball; a point has at most 65 fingerprints, and its least one is linked
  to the others.  No pair list of a dense group arises.
* Links of three bits: one of the two 32-bit segments then differs in at most
  one bit.  The ball of radius one of each segment is looked up in a table of
  segments; matches in another component are verified by the full distance.

Defined cases: a null text counts as empty; a text without words has
fingerprint zero and is linked like any other; repeated rows each give a row;
null document ids are kept and never become a component id unless a component
has no other; columns other than the two named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trialquota.llm.common import bit_sums, components, hamming, majority_bits, packed, stage, text_key
from trialquota.llm.shinglesets import text_groups

SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; plain ASCII texts take the fast built-in."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def space_words(text: Column) -> Column:
    """Words between ASCII white space; one empty string for a text without words."""
    return F.split(F.btrim(text, F.lit(SPACES)), r"[\x20\x09-\x0D]+", -1)


def text_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, _k1, _k2, fingerprint long, _rows): one row per distinct id and text, with its row count.

    Shingles are counted in place before the shuffle.  Rows with the same id and
    text share a group: their counts and the number of shingles grow alike, so
    the majority stays as it is.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    exploded = (
        docs.select(F.col(doc_id).alias("doc_id"), *text_key(F.col(text)), space_words(ascii_lower(content)).alias("_w"))
        .withColumn("_n", F.when(F.get("_w", F.lit(0)) == "", 0).otherwise(F.size("_w")))
        .select("*", F.posexplode("_w").alias("_p", "_word"))
        .where(F.col("_p") <= F.greatest(F.col("_n") - shingle, F.lit(0)))
    )
    parts = [F.get("_w", F.col("_p") + i) for i in range(shingle)]
    whole = F.when(F.col("_n") >= shingle, F.concat_ws(" ", *parts)).otherwise(F.array_join("_w", " "))
    hashed = F.when(F.col("_n") > 0, F.xxhash64(whole))
    counted = (
        exploded.select("doc_id", "_k1", "_k2", "_p", hashed.alias("_h"))
        .groupBy("doc_id", "_k1", "_k2")
        .agg(F.count("_h").alias("_m"), F.sum((F.col("_p") == 0).cast("int")).alias("_rows"), *bit_sums(F.col("_h")))
    )
    fp = F.when(F.col("_m") == 0, F.lit(0).cast("long")).otherwise(majority_bits(F.col("_m")))
    return counted.select("doc_id", "_k1", "_k2", fp.alias("fingerprint"), "_rows")


def flips(value: Column, bits: int, shift: int = 0) -> Column:
    """Array of ``value`` and its neighbours at one bit, over ``bits`` bits from ``shift``."""
    signed = [(1 << b) - (1 << 64) if b == 63 else 1 << b for b in range(shift, shift + bits)]
    return F.array(value, *[value.bitwiseXOR(F.lit(m).cast("long")) for m in signed])


def near_links(fingerprints: DataFrame) -> DataFrame:
    """Links (a, b) of up to two bits between distinct ``fingerprint`` values, as stars."""
    hubs = fingerprints.select("fingerprint", F.explode(flips(F.col("fingerprint"), 64)).alias("hub"))
    shared = hubs.groupBy("hub").agg(F.collect_list("fingerprint").alias("members")).where(F.size("members") > 1)
    return shared.select(F.array_min("members").alias("a"), F.explode("members").alias("b")).where("a <> b")


def far_links(fingerprints: DataFrame) -> DataFrame:
    """Pairs (a, b) of different ``root`` values that hold fingerprints within three bits."""

    def segments(ball: bool) -> Column:
        low = F.col("fingerprint").bitwiseAND(F.lit(0xFFFFFFFF))
        high = F.shiftrightunsigned("fingerprint", 32)
        keys = [flips(x, 32) if ball else F.array(x) for x in (low, high)]
        # Bit 32 names the segment, so both tables share one join.
        return F.concat(keys[0], F.transform(keys[1], lambda k: k.bitwiseOR(F.lit(1 << 32))))

    probes = fingerprints.select(
        F.col("fingerprint").alias("fa"), F.col("root").alias("a"), F.explode(segments(True)).alias("key")
    )
    entries = fingerprints.select(
        F.col("fingerprint").alias("fb"), F.col("root").alias("b"), F.explode(segments(False)).alias("key")
    )
    close = (F.col("a") < F.col("b")) & (hamming(F.col("fa"), F.col("fb")) <= 3)
    return probes.join(entries, (probes["key"] == entries["key"]) & close).select("a", "b").distinct()


def fingerprint_components(fingerprints: DataFrame) -> DataFrame:
    """(fingerprint, root) for distinct fingerprints linked at three or fewer bits."""
    distinct = stage(fingerprints.select("fingerprint").distinct(), "fingerprints").df
    near = components(near_links(distinct), "near").df.withColumnRenamed("node", "fingerprint")
    root = F.coalesce("root", "fingerprint").alias("root")
    rooted = stage(distinct.join(near, "fingerprint", "left").select("fingerprint", root), "rooted").df
    merged = components(far_links(rooted), "far").df.selectExpr("node AS root", "root AS top")
    return rooted.join(merged, "root", "left").select("fingerprint", F.coalesce("top", "root").alias("root"))


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint hex, component_id): component_id is the smallest id of the component."""
    prints = stage(text_fingerprints(docs, doc_id, text, shingle), "prints").df
    rooted = fingerprint_components(prints)
    least = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    named = stage(rooted.join(least, "fingerprint"), "named").df
    names = named.groupBy("root").agg(F.min("first").alias("component_id"))
    component = named.select("fingerprint", "root").join(names, "root").select("fingerprint", "component_id")
    shown = F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), "_rows")).alias("_copy")
    return prints.join(component, "fingerprint").select("doc_id", shown, "component_id", copies).drop("_copy")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """Rows of ``docs`` that come first in their component, with all their columns.

    Texts are linked when their sets of word shingles have a Jaccard similarity
    of at least 0.8.  Three bits of 64 cover few such pairs, so fingerprints only
    name texts to compare first; ``text_groups`` finds all pairs and verifies them.

    First is the smallest id (null last), then the smallest text key; of rows
    equal in id and text one stays.  The winner of a component is a minimum
    combined before the shuffle, however large the component is.
    """
    printed = stage(text_fingerprints(docs, doc_id, text, shingle), "prints")
    prints = printed.df
    hints = prints.select("fingerprint", "_k1", "_k2").distinct().join(fingerprint_components(prints), "fingerprint")
    hints = hints.select("_k1", "_k2", F.col("root").alias("hint"))
    rooted = text_groups(docs, text, shingle, printed.rows, hints)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_k1", "_k2", "_rows")
    least = prints.groupBy("_k1", "_k2").agg(F.min(order).alias("w"))
    first = rooted.join(least, ["_k1", "_k2"]).groupBy("root").agg(F.min("w").alias("w"))
    winners = stage(
        first.select(*[F.col(f"w.{c}").alias(f"_w{c}") for c in ("doc_id", "_k1", "_k2", "_rows")]), "winners"
    ).df
    k1, k2 = text_key(F.col(f"row.{text}"))
    keyed = packed(docs).withColumns({"_id": F.col(f"row.{doc_id}"), "_k1": k1, "_k2": k2})
    match = (
        keyed["_id"].eqNullSafe(winners["_wdoc_id"])
        & (keyed["_k1"] == winners["_w_k1"])
        & (keyed["_k2"] == winners["_w_k2"])
    )
    kept = keyed.join(winners, match)
    single = kept.where("_w_rows = 1")
    repeated = kept.where("_w_rows > 1").dropDuplicates(["_wdoc_id", "_k1", "_k2"])
    return single.unionByName(repeated).select("row.*")


def drop_simhash_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """Rows of ``docs`` that come first in their SimHash component, with all their columns.

    Components are those of ``simhash_components``: fingerprints of ``shingle``-word
    shingles linked at three or fewer differing bits, nothing else.  First is the
    smallest id (null last), then the smallest text key; of rows equal in id and
    text one stays.  The first text of each fingerprint is found before the
    shuffle, then the first of each component, so a component of any size is
    never gathered row by row.

    Defined cases: a null text counts as empty (fingerprint zero, linked like any
    other); repeated rows leave one; null ids stay only where a component has no
    other; an empty table gives no rows; columns of any name pass through.
    """
    prints = stage(text_fingerprints(docs, doc_id, text, shingle), "prints").df
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_k1", "_k2", "_rows")
    per_print = prints.groupBy("fingerprint").agg(F.min(order).alias("w"))
    first = per_print.join(fingerprint_components(prints), "fingerprint").groupBy("root").agg(F.min("w").alias("w"))
    winners = stage(
        first.select(*[F.col(f"w.{c}").alias(f"_w{c}") for c in ("doc_id", "_k1", "_k2", "_rows")]), "winners"
    ).df
    k1, k2 = text_key(F.col(f"row.{text}"))
    keyed = packed(docs).withColumns({"_id": F.col(f"row.{doc_id}"), "_k1": k1, "_k2": k2})
    match = (
        keyed["_id"].eqNullSafe(winners["_wdoc_id"])
        & (keyed["_k1"] == winners["_w_k1"])
        & (keyed["_k2"] == winners["_w_k2"])
    )
    kept = keyed.join(winners, match)
    single = kept.where("_w_rows = 1")
    repeated = kept.where("_w_rows > 1").dropDuplicates(["_wdoc_id", "_k1", "_k2"])
    return single.unionByName(repeated).select("row.*")

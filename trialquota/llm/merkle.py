"""Merkle manifest of a document table, with proofs found by pointer jumping.

Every row is a leaf: the SHA-256 (lowercase hex) of its fields ``doc_id``,
``source``, ``lang``, ``n_chars`` and ``text``, each written as ``-`` when null,
else as its UTF-8 byte count, ``:`` and its value (integers in decimal).  Per
source, leaves ascend by ``doc_id`` (nulls first, ties by leaf); every run of
``FANOUT`` consecutive nodes (the last run shorter, even of one) becomes the
hash of their digests, level by level, until one node, the subroot, is left.
The subroots, ordered by source (null first, UTF-8 bytewise), give the root in
the same way.

Proofs: every node above the leaves holds the segment of its siblings (the
others of its run, split into those left and right of it, as bytes) and a
pointer to its parent.  In each round every node joins the record of the node
it points to, takes over that node's pointer and appends its segments, so the
distance covered doubles; after about log2(depth) rounds every node reaches the
root.  The top of a source tree points to its subroot's place in the tree of
subroots without a segment.  Leaves, FANOUT times as many as all other nodes,
do not jump: each takes its own segment from its run and the finished proof of
its parent in one last join, so the growing proofs are written for one node
in FANOUT only.

Ancestor records of the levels with few nodes (a size bound derived from the
counted leaves, not guessed) are broadcast; larger levels are joined by a
shuffle, where every key has at most FANOUT**distance rows behind it, the same
for every key of a level.  Each round is a written table.

Defined cases: null fields hash as ``-``; empty and very long texts hash whole;
repeated rows are separate leaves (ties in doc_id ordered by leaf); an empty
table gives no rows; columns other than the five are ignored.  A row with a null
doc_id is never tampered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trialquota.llm.common import BROADCAST_BYTES, BROADCAST_ROWS, stage
from trialquota.operators.ranking import rank_rows
from trialquota.sources.staging import broadcast_if_small

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Bytes a node's record holds for one level of its proof: FANOUT - 1 digests of 64 characters and overhead.
LEVEL_BYTES = (FANOUT - 1) * 64 + 64
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in (doc_id, source, lang, n_chars, text)]), 256)


def tampered(doc_id: Column) -> Column:
    """Rows whose text the check alters: 5 divides the unsigned crc32 of the decimal doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def depth(n: Column, levels: int) -> Column:
    """Levels above the leaves of a tree of ``n`` leaves: the count of L >= 1 with n > FANOUT**(L-1)."""
    return sum((F.when(n > FANOUT ** (level - 1), 1).otherwise(0) for level in range(1, levels + 1)), F.lit(0))


def levels_for(n: int) -> int:
    levels, width = 0, n
    while width > 1:
        width, levels = -(-width // FANOUT), levels + 1
    return levels


def build_tree(nodes: DataFrame, top: int, label: str, payload: tuple[str, ...] = ()) -> tuple[DataFrame, list, DataFrame | None]:
    """Hash runs of FANOUT nodes until each tree has one node.

    ``nodes``: (t, level 0, idx, hash, d, *payload) where d is the tree's depth.
    Returns all nodes (t, level, idx, hash, d); the links (t, level, idx, left,
    right) of every node above level 0 and below its tree's top, with the sibling
    digests as bytes; and the runs of level 0 (t, d, parent, run), whose entries
    keep the payload, so that the leaves' own rows come from them.
    """
    all_nodes, links, current, first_runs = [nodes.select("t", "level", "idx", "hash", "d")], [], nodes, None
    for level in range(top):
        kept = ("idx", "hash", *payload) if level == 0 else ("idx", "hash")
        runs = (
            current.where(F.col("level") < F.col("d"))
            .groupBy("t", "d", F.floor(F.col("idx") / FANOUT).alias("parent"))
            .agg(F.array_sort(F.collect_list(F.struct(*kept))).alias("run"))
        )
        runs = stage(runs, f"{label}-runs").df
        digests = F.transform("run", lambda x: x["hash"])
        parents = runs.select(
            "t", F.lit(level + 1).alias("level"), F.col("parent").alias("idx"),
            F.sha2(F.array_join(digests, ""), 256).alias("hash"), "d",
        )
        current = stage(parents, f"{label}-level").df
        all_nodes.append(current)
        if level == 0:
            first_runs = runs
            if payload:
                continue
        links.append(sibling_segments(runs).withColumn("level", F.lit(level)))
    union = all_nodes[0]
    for df in all_nodes[1:]:
        union = union.unionByName(df)
    return union, links, first_runs


def sibling_segments(runs: DataFrame) -> DataFrame:
    """(t, idx, left, right, entry): each member of a run with the digests before and after it, as bytes."""
    digests = F.transform("run", lambda x: x["hash"])
    return runs.select("t", "run", F.posexplode(digests).alias("pos", "hash")).select(
        "t",
        F.col("run")[F.col("pos")]["idx"].alias("idx"),
        F.unhex(F.array_join(F.slice(digests, 1, F.col("pos")), "")).alias("left"),
        F.unhex(F.array_join(F.slice(digests, F.col("pos") + 2, FANOUT), "")).alias("right"),
        F.col("run")[F.col("pos")].alias("entry"),
    )


def manifest(docs: DataFrame, tamper: bool = True) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``folded_root`` folds the leaf of the altered text (when ``tamper`` and the row
    is chosen by ``tampered``) with the original siblings up to the root.
    """
    spark = docs.sparkSession
    d = docs.select(*[F.col(f"`{c}`").alias(c) for c in FIELDS])
    lowered = F.translate("text", UPPER, UPPER.lower())
    leaves = d.select(
        "doc_id",
        "source",
        leaf_hash(*[F.col(c) for c in FIELDS]).alias("leaf"),
        F.when(F.lit(tamper) & tampered(F.col("doc_id")), leaf_hash(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), lowered))
        .otherwise(leaf_hash(*[F.col(c) for c in FIELDS]))
        .alias("folded_leaf"),
    )
    leaves = stage(leaves, "merkle-leaves")
    if not leaves.rows:
        return spark.createDataFrame(
            [], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        )
    sources = stage(leaves.df.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "merkle-sources")
    ranked_sources = rank_rows(sources.df, [], [F.col("source").asc_nulls_first()], label="merkle-source-order").rows
    top = levels_for(sources.df.agg(F.max("n")).first()[0])
    trees = stage(ranked_sources.select("source", F.col("rank").alias("t"), "n", depth(F.col("n"), top).alias("d")), "merkle-trees")
    n_sources = trees.rows
    tree_keys = broadcast_if_small(trees.df.select(F.col("source").alias("_source"), "t", "d"), trees.rows)
    keyed = leaves.df.join(tree_keys, F.col("source").eqNullSafe(F.col("_source")))
    ranked = rank_rows(
        keyed.select("t", "d", "doc_id", "leaf", "folded_leaf"), ["t"], [F.col("doc_id").asc_nulls_first(), F.col("leaf")], label="merkle-leaf-order"
    ).rows
    ranked = ranked.withColumn("idx", F.col("rank") - 1).drop("rank")
    level0 = ranked.select("t", F.lit(0).alias("level"), "idx", F.col("leaf").alias("hash"), "d", "doc_id", "folded_leaf")
    source_nodes, source_links, leaf_runs = build_tree(level0, top, "merkle-source", ("doc_id", "folded_leaf"))

    tops = source_nodes.where(F.col("level") == F.col("d")).select("t", F.col("hash").alias("subroot"))
    tops = stage(tops, "merkle-subroots")
    root_depth = levels_for(n_sources)
    root_level0 = tops.df.select(F.lit(0).alias("t"), F.lit(0).alias("level"), (F.col("t") - 1).alias("idx"), F.col("subroot").alias("hash"), F.lit(root_depth).alias("d"))
    root_nodes, root_links, _ = build_tree(root_level0, root_depth, "merkle-root")
    root = root_nodes.where(F.col("level") == root_depth).select("hash").first()[0]

    seg = F.struct(F.col("left"), F.col("right"))
    parent_of = [
        F.col("t").cast("long").alias("at"), (F.col("level") + 1).cast("int").alias("al"),
        F.floor(F.col("idx") / FANOUT).cast("long").alias("ai"),
    ]
    records = [
        link.select("t", F.col("level").cast("int"), "idx", *parent_of, F.array(seg).alias("segs")) for link in [*source_links, *root_links]
        if link is not None
    ]
    # The top of a source tree points to its subroot among the subroots, with no segment.
    records.append(
        tops.df.join(trees.df.select("t", "d"), "t").select(
            "t", F.col("d").cast("int").alias("level"), F.lit(0).cast("long").alias("idx"),
            F.lit(0).cast("long").alias("at"), F.lit(0).alias("al"), (F.col("t") - 1).alias("ai"),
            F.array().cast("array<struct<left:binary,right:binary>>").alias("segs"),
        )
    )
    # The root points nowhere.
    records.append(
        spark.range(1).select(
            F.lit(0).cast("long").alias("t"), F.lit(root_depth).alias("level"), F.lit(0).cast("long").alias("idx"),
            F.lit(None).cast("long").alias("at"), F.lit(None).cast("int").alias("al"), F.lit(None).cast("long").alias("ai"),
            F.array().cast("array<struct<left:binary,right:binary>>").alias("segs"),
        )
    )
    table = records[0]
    for r in records[1:]:
        table = table.unionByName(r)
    jumped = jump(stage(table, "merkle-pointers"), source_level_sizes(trees.df, top), n_sources, top, root_depth)

    # Leaves attach to the finished proof of their parent; a lone leaf is its source's top.
    above = jumped.select("t", "level", "idx", F.col("segs").alias("above"))
    lone = ranked.where(F.col("d") == 0).join(above.where(F.col("level") == 0), ["t", "idx"]).select(
        "t", "doc_id", "leaf", "folded_leaf", F.col("above").alias("segs")
    )
    if leaf_runs is not None:
        leaves = sibling_segments(leaf_runs).select(
            "t", "idx", "entry.doc_id", F.col("entry.hash").alias("leaf"), "entry.folded_leaf", F.array(seg).alias("own")
        )
        parents = above.where(F.col("level") == 1).select("t", F.col("idx").alias("_parent"), "above")
        attached = leaves.withColumn("_parent", F.floor(F.col("idx") / FANOUT).cast("long")).join(parents, ["t", "_parent"])
        lone = attached.select("t", "doc_id", "leaf", "folded_leaf", F.concat("own", "above").alias("segs")).unionByName(lone)
    found = lone.join(broadcast_if_small(tops.df, tops.rows), "t")
    text = lambda b: F.lower(F.hex(b))
    proof = F.sha2(text(F.aggregate("segs", F.lit(b"").cast("binary"), lambda acc, s: F.concat(acc, s["left"], s["right"]))), 256)
    folded = F.aggregate("segs", F.col("folded_leaf"), lambda acc, s: F.sha2(F.concat(text(s["left"]), acc, text(s["right"])), 256))
    return found.select(
        "doc_id", "leaf", "subroot", F.lit(root).alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def source_level_sizes(trees: DataFrame, top: int) -> dict[int, int]:
    """Nodes of all source trees at each level, from the leaf counts alone."""
    if top == 0:
        return {}
    sizes = trees.agg(
        *[
            F.sum(F.when(F.col("d") >= level, F.ceil(F.col("n") / F.lit(FANOUT**level)))).alias(f"l{level}")
            for level in range(1, top + 1)
        ]
    ).first()
    return {level: int(sizes[f"l{level}"] or 0) for level in range(1, top + 1)}


def jump(records, sizes: dict[int, int], n_sources: int, top: int, root_depth: int) -> DataFrame:
    """Pointer jumping until no record points anywhere.

    Records of ancestors: every node above the leaves.  Levels are taken into the
    broadcast side from the top down while their node count and their proof bytes
    (at most one level's segment per level above them) stay under the limits.
    """
    root_rows = sum(-(-n_sources // FANOUT**level) for level in range(root_depth + 1))
    rows, size, cut = root_rows, root_rows * (root_depth + 1) * LEVEL_BYTES, top + 1
    for level in range(top, 0, -1):
        more_rows = sizes[level]
        more_bytes = more_rows * (top - level + root_depth + 2) * LEVEL_BYTES
        if rows + more_rows > BROADCAST_ROWS or size + more_bytes > BROADCAST_BYTES:
            break
        rows, size, cut = rows + more_rows, size + more_bytes, level
    few = (F.col("t") == 0) | (F.col("level") >= cut)
    points_few = (F.col("at") == 0) | (F.col("al") >= cut)
    current = records
    while current.df.where(F.col("at").isNotNull()).limit(1).count():
        df = current.df
        ancestors = df.where((F.col("level") > 0) | (F.col("t") == 0)).select(
            F.col("t").alias("bt"), F.col("level").alias("bl"), F.col("idx").alias("bi"),
            F.col("at").alias("nt"), F.col("al").alias("nl"), F.col("ai").alias("ni"), F.col("segs").alias("more"),
        )
        on = [F.col("at") == F.col("bt"), F.col("al") == F.col("bl"), F.col("ai") == F.col("bi")]
        moved = F.col("at").isNotNull()
        step = [
            "t", "level", "idx", F.col("nt").alias("at"), F.col("nl").alias("al"), F.col("ni").alias("ai"),
            F.concat("segs", "more").alias("segs"),
        ]
        near = df.where(moved & points_few).join(F.broadcast(ancestors.where(few_b(cut))), on).select(*step)
        far = df.where(moved & ~points_few).join(ancestors.where(~few_b(cut)), on).select(*step)
        done = df.where(~moved)
        nxt = stage(done.unionByName(near).unionByName(far), "merkle-jump")
        current.drop()
        current = nxt
    return current.df


def few_b(cut: int) -> Column:
    return (F.col("bt") == 0) | (F.col("bl") >= cut)

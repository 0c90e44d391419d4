"""Removal of byte strings that occur more than once, by common-prefix intervals of suffix arrays.

Every window of ``length`` bytes has an anchor: the k-gram of the least hash in
it, the leftmost on ties.  Equal windows have equal anchors at equal places, so
the windows of one anchor form a segment, and segments are compared only with
those of the same anchor hash.  Segments whose anchor occurs once are dropped at
once.  Equal segments are counted as one class before they meet others.

Classes of one anchor hash are put into an enhanced suffix array.  A scan with a
stack gives its common-prefix intervals; those whose occurrences are preceded by
different bytes (or begin a segment) are the maximal repeats, and every
occurrence is reported.  An anchor hash with more than ``GROUP`` classes is not
gathered: its windows are split into runs, which are grouped by the bytes that
all their windows hold, until a group has no more than ``GROUP`` classes.

Defined cases: a null text counts as empty; texts shorter than ``length`` lose
nothing; matches never cross documents; repeated rows are repeats of each
other; null ids are kept; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from trialquota.llm.common import stage
from trialquota.llm.wordcodes import slices

LENGTH = 200
GRAM_STEPS = 5  # k-grams of 2 ** 5 bytes
GROUP = 2000
BATCH_BYTES = 512 << 10
SLICE_BYTES = 2 << 20
ROWS = 4096
PLACE_BITS = 28
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the k-gram that begins at each byte."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _ODD[5]
    for step in range(GRAM_STEPS):
        h ^= h >> np.uint64(31)
        h = h[: -(1 << step)] * _ODD[step] + h[1 << step :]
    h ^= h >> np.uint64(33)
    h *= _ODD[4]
    h ^= h >> np.uint64(29)
    return h


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, start, windows, anchor hash) of every segment; start counts from the first byte of ``data``."""
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty.astype(np.uint64)
    grams = gram_hashes(data)
    place = np.arange(len(grams), dtype=np.uint64)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    anchor = sliding_min((grams & ~mask) | place, length - (1 << GRAM_STEPS) + 1) & mask
    firsts, lasts = offsets[:-1], offsets[1:] - length
    firsts = firsts[lasts >= firsts]
    breaks = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
    starts = np.unique(np.concatenate([breaks, firsts]))
    # Empty texts share an offset with the next one: the last of them is meant.
    text = np.searchsorted(offsets[:-1], starts, side="right") - 1
    inside = starts <= lasts[text]
    starts, text = starts[inside], text[inside]
    following = np.append(starts[1:], len(data))
    windows = np.minimum(following, lasts[text] + 1) - starts
    return text, starts, windows, grams[anchor[starts].astype(np.int64)]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and the first byte of each text (and the end)."""
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    joined = "".join(texts.to_pylist()).encode()
    return np.frombuffer(joined, np.uint8), ends


SEGMENT = "doc_id long, k long, start int, windows int, m long, d long"


def text_segments(docs: DataFrame, length: int) -> DataFrame:
    """SEGMENT rows: document, text key, first byte, windows, anchor hash, and hash of the bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text", SLICE_BYTES):
                data, offsets = text_bytes(texts)
                text, starts, windows, m = segments(data, offsets, length)
                view = memoryview(data)
                ends = (starts + windows + length - 1).tolist()
                digest = xxhash.xxh3_64_intdigest
                d = np.array([digest(view[a:b]) for a, b in zip(starts.tolist(), ends, strict=True)], np.uint64)
                where = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(where), part.column("k").take(where),
                        pa.array((starts - offsets[text]).astype(np.int32)), pa.array(windows.astype(np.int32)),
                        pa.array(m.view(np.int64)), pa.array(d.view(np.int64)),
                    ],
                    names=["doc_id", "k", "start", "windows", "m", "d"],
                )

    return docs.select("doc_id", "k", "text").mapInArrow(cut, SEGMENT)


def window_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` bytes that begin at each byte, put together from runs of powers of two."""
    runs, size, at = (data.astype(np.uint64) + np.uint64(1)) * _ODD[5], 1, 0
    found = np.zeros(len(data) - length + 1, np.uint64)
    while at < length:
        if length & size:
            found = (found ^ (found >> np.uint64(29))) * _ODD[4] + runs[at : at + len(found)]
            at += size
        mixed = runs ^ (runs >> np.uint64(31))
        runs = mixed[:-size] * _ODD[size.bit_length() % 4] + mixed[size:]
        size *= 2
    return found


def suffix_array(data: np.ndarray, remaining: np.ndarray, length: int) -> np.ndarray:
    """Suffixes whose first ``length`` bytes occur again, equal beginnings side by side.

    The order is that of a suffix array, but for the first ``length`` bytes, whose
    hash stands for them: only suffixes that share these bytes are ever compared.
    The byte 255 is in no UTF-8 text, so 0 can mark the end of a string.
    """
    starts = np.flatnonzero(remaining >= length)
    if len(starts) < 2:
        return starts[:0]
    hashed = window_hashes(data, length)[starts]
    order = np.argsort(hashed)
    ranked = hashed[order]
    alike = ranked[1:] == ranked[:-1]
    shared = np.concatenate([alike, [False]]) | np.concatenate([[False], alike])
    starts, hashed = starts[order[shared]], ranked[shared]
    if not len(starts):
        return starts
    reach = int(remaining[starts].max()) - length
    rows = np.zeros((len(starts), 8 + reach), np.uint8)
    rows[:, :8] = hashed.astype(">u8").view(np.uint8).reshape(-1, 8)
    column = np.arange(reach)
    # Places are eight bytes for each byte of the rows: some rows at a time.
    for low in range(0, len(starts), ROWS):
        some = starts[low : low + ROWS]
        at = np.minimum(some[:, None] + length + column, len(data) - 1)
        rows[low : low + ROWS, 8:] = np.where(column < (remaining[some] - length)[:, None], data[at] + np.uint8(1), 0)
    return starts[np.argsort(rows.view(f"S{8 + reach}").ravel(), kind="stable")]


def common_prefixes(data: np.ndarray, remaining: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of the suffixes at a and b: eight bytes at a time, then one by one."""
    found, most = np.zeros(len(a), np.int64), np.minimum(remaining[a], remaining[b])
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    packed = np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(data)]
    active = np.arange(len(a))
    while len(active):
        active = active[found[active] + 8 <= most[active]]
        same = (packed[a[active] + found[active]] == packed[b[active] + found[active]]).all(axis=1)
        active = active[same]
        found[active] += 8
    active = np.arange(len(a))
    for _ in range(8):
        active = active[found[active] < most[active]]
        active = active[data[a[active] + found[active]] == data[b[active] + found[active]]]
        found[active] += 1
    return found


def maximal_repeats(data: np.ndarray, bounds: np.ndarray, length: int) -> Iterator[tuple[int, list[int]]]:
    """(length, positions) of the maximal repeats of at least ``length`` bytes among the strings of ``data``.

    String i is data[bounds[i]:bounds[i + 1]]; no match crosses its end.
    """
    n = len(data)
    if n < length:
        return
    sizes = np.diff(bounds)
    remaining = np.repeat(bounds[1:], sizes) - np.arange(n)
    order = suffix_array(data, remaining, length)
    if len(order) < 2:
        return
    prefix = common_prefixes(data, remaining, order[:-1], order[1:])
    begins = np.zeros(n, bool)
    begins[bounds[:-1][sizes > 0]] = True
    # Preceding byte; 256 for the first of a string, which differs from all others.
    left = np.where(begins, 256, np.concatenate([[0], data[:-1]]).astype(np.int64))
    # Runs of neighbours that share at least ``length`` bytes.
    edges = np.flatnonzero(prefix >= length)
    cuts = np.flatnonzero(np.diff(edges) > 1) + 1
    for run in np.split(edges, cuts):
        if len(run):
            low, high = int(run[0]), int(run[-1]) + 1
            yield from intervals(order[low : high + 1].tolist(), prefix[low:high].tolist(), left)


def intervals(suffixes: list[int], prefix: list[int], left: np.ndarray) -> Iterator[tuple[int, list[int]]]:
    """Left-diverse common-prefix intervals of a run, closed in the order of a stack.

    A stack entry is (common prefix, first index, left symbol): the symbol is
    the byte before all occurrences so far, or -1 once they differ.
    """

    def joined(x: int, y: int) -> int:
        return x if x == y and x != 256 else -1

    stack: list[tuple[int, int, int]] = []
    symbols = left[suffixes].tolist()
    for i, common in enumerate([*prefix, 0]):
        begin, symbol = i, symbols[i]
        while stack and stack[-1][0] > common:
            size, begin, before = stack.pop()
            symbol = joined(before, symbol)
            if symbol == -1:
                yield size, suffixes[begin : i + 1]
        if stack and stack[-1][0] == common:
            size, start, before = stack.pop()
            stack.append((size, start, joined(before, symbol)))
        elif common:
            stack.append((common, begin, symbol))
    return


COVER = "m long, d long, off int, len int"


def interval_covers(contents: DataFrame, length: int) -> DataFrame:
    """COVER rows: the maximal repeats' occurrences in each class, from classes (m, d, content)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, d, strings, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            bounds = np.cumsum([0, *map(len, strings)])
            data = np.frombuffer(b"".join(strings), np.uint8)
            spans: dict[tuple[int, int], int] = {}
            for repeat, places in maximal_repeats(data, bounds, length):
                for place in places:
                    spans[place] = max(spans.get(place, 0), repeat)
            places = np.array(sorted(spans), np.int64)
            owner = np.searchsorted(bounds, places, side="right") - 1
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.array(m, np.int64)[owner]), pa.array(np.array(d, np.int64)[owner]),
                    pa.array((places - bounds[owner]).astype(np.int32)),
                    pa.array(np.array([spans[p] for p in places.tolist()], np.int32)),
                ],
                names=["m", "d", "off", "len"],
            )

        for batch in batches:
            for own, digest, content in zip(*(batch.column(c).to_pylist() for c in ("m", "d", "content")), strict=True):
                if size >= BATCH_BYTES and own != m[-1]:
                    yield flush()
                    m, d, strings, size = [], [], [], 0
                m.append(own)
                d.append(digest)
                strings.append(content)
                size += len(content)
        if strings:
            yield flush()

    return contents.repartition("m").sortWithinPartitions("m", "d").mapInArrow(scan, COVER)


def anchor_places(contents: list[bytes], length: int) -> list[int]:
    """Place of the anchor in each class: that of its first window, and so of all its windows."""
    joined = b"".join(content[:length] for content in contents) + bytes((1 << GRAM_STEPS) - 1)
    grams = gram_hashes(np.frombuffer(joined, np.uint8)).reshape(len(contents), length)[:, : length - (1 << GRAM_STEPS) + 1]
    return np.argmin(grams & ~np.uint64((1 << PLACE_BITS) - 1), axis=1).tolist()


RANGE = "g long, e long, m long, d long, off int, content binary"


def range_classes(contents: DataFrame, length: int, width: int) -> DataFrame:
    """RANGE rows: the windows of each class in runs of at most ``width``.

    A window is numbered by its bytes before the anchor, and a run holds the
    numbers of one multiple of ``width``.  ``g`` hashes the bytes that all windows
    of the run share, so equal windows have equal ``g``; ``e`` stands for the
    bytes of the run, which begin at ``off`` in the class.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            m, d, base, contents = (batch.column(c).to_pylist() for c in ("m", "d", "off", "content"))
            out: list[list] = [[], [], [], [], [], []]
            for row, (content, at) in enumerate(zip(contents, anchor_places(contents, length), strict=True)):
                least = at - (len(content) - length)
                for number in range(least // width, at // width + 1):
                    low, high = number * width, number * width + width - 1
                    first, last = at - min(at, high), at - max(least, low)
                    run = content[first : last + length]
                    seed = digest(f"{m[row]} {number}")
                    shared = digest(content[at - low : at - high + length], seed)
                    own = digest(run, digest(f"{shared} {at - first}"))
                    for column, value in zip(out, (shared, own, m[row], d[row], base[row] + first, run), strict=True):
                        column.append(value)
            hashes = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in out[:2]]
            yield pa.RecordBatch.from_arrays(
                [*hashes, pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.int32()), pa.array(out[5], pa.binary())],
                names=["g", "e", "m", "d", "off", "content"],
            )

    return contents.select("m", "d", "off", "content").mapInArrow(cut, RANGE)


def crowd_covers(contents: DataFrame, length: int) -> DataFrame:
    """COVER rows for anchor hashes of very many classes.

    Their windows are split into shorter and shorter runs.  Equal runs are one
    class and repeats from end to end; runs that share no bytes all their windows
    hold are done.  Groups of up to ``GROUP`` classes are compared by suffix
    arrays, and only the classes of larger ones are split again, down to single
    windows: a class is split where its repeats begin and end, not window by window.
    """
    covers, width = [], 4 ** max(0, math.ceil(math.log(length - (1 << GRAM_STEPS) + 1, 4)) - 1)
    contents = contents.select("m", "d", F.lit(0).alias("off"), "content")
    while True:
        runs = stage(range_classes(contents, length, width), "runs").df
        classes = stage(
            runs.groupBy("g", "e").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("m", "d", "off")).alias("p"), F.first("content").alias("content"))
            .select("g", "e", "n", "p.*", "content"),
            "run-classes",
        ).df
        groups = classes.groupBy("g").agg(F.count(F.lit(1)).alias("classes"), F.min("n").alias("least"))
        mixed = classes.join(stage(groups.where("classes > 1 AND least = 1").drop("least"), "run-groups").for_broadcast(), "g")
        equal = runs.join(classes.where("n > 1").select("g", "e"), ["g", "e"])
        covers.append(equal.select("m", "d", "off", F.length("content").alias("len")))
        small = mixed.where(f"classes <= {GROUP}")
        part = interval_covers(small.select(F.col("g").alias("m"), F.col("e").alias("d"), "content"), length)
        part = part.select(F.col("m").alias("g"), F.col("d").alias("e"), F.col("off").alias("inner"), "len")
        # A run of several classes is covered from end to end already.
        single = small.where("n = 1").select("g", "e", "m", "d", "off")
        covers.append(part.join(single, ["g", "e"]).select("m", "d", (F.col("off") + F.col("inner")).alias("off"), "len"))
        contents = stage(mixed.where(f"classes > {GROUP}").select("m", "d", "off", "content"), "crowded-runs")
        if not contents.rows:
            return reduce(DataFrame.unionByName, covers)
        contents, width = contents.df, width // 4


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    content = F.coalesce(F.col(text), F.lit("")).alias("text")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("k"), content)


def repeated_spans(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, k, spans): spans (start, end) in bytes that lie in repeats, unmerged."""
    # Written once: cutting costs more than reading it back.
    found = stage(text_segments(rows, length), "all-segments").df
    anchors = found.groupBy("m").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("m")
    shared = stage(found.join(anchors, "m"), "segments").df
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k", "start", "windows")
    classes = shared.groupBy("m", "d").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("p"))
    # An anchor needs comparison if it has several classes and one of them occurs once.
    groups = classes.groupBy("m").agg(F.count(F.lit(1)).alias("classes"), F.min("n").alias("least"))
    tagged = stage(
        classes.join(groups, "m").select(
            "m", "d", "n", "classes", ((F.col("classes") > 1) & (F.col("least") == 1)).alias("mixed"),
            *[F.col(f"p.{c}").alias(c) for c in ("doc_id", "k", "start", "windows")],
        ),
        "segment-classes",
    ).df
    wanted = tagged.where("mixed").groupBy("doc_id", "k").agg(F.collect_list(F.struct("m", "d", "classes", "start", "windows")).alias("cuts"))
    contents = stage(class_contents(rows, wanted, length).dropDuplicates(["m", "d"]), "contents").df
    small, large = contents.where(f"classes <= {GROUP}"), contents.where(f"classes > {GROUP}")
    part = interval_covers(small.select("m", "d", "content"), length)
    if not large.isEmpty():
        part = part.unionByName(crowd_covers(large, length))
    # A class that occurs twice is a repeat from end to end.
    whole = tagged.where("n > 1").select("m", "d", F.lit(0).alias("off"), (F.col("windows") + length - 1).alias("len"))
    covers = whole.unionByName(part).groupBy("m", "d").agg(F.collect_list(F.struct("off", "len")).alias("covers"))
    spans = shared.join(stage(covers, "covers").df, ["m", "d"]).select(
        "doc_id", "k", F.explode(F.transform("covers", lambda c: F.struct(
            (F.col("start") + c["off"]).alias("start"), (F.col("start") + c["off"] + c["len"]).alias("end")))).alias("span"),
    )
    return spans.groupBy("doc_id", "k").agg(F.collect_list("span").alias("spans"))


def class_contents(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(m, d, classes, content): bytes of one occurrence of each class in ``wanted``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, cuts in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist(), strict=True):
                data = text.encode()
                for c in cuts:
                    content = data[c["start"] : c["start"] + c["windows"] + length - 1]
                    for column, value in zip(out, (c["m"], c["d"], c["classes"], content), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())],
                names=["m", "d", "classes", "content"],
            )

    match = rows["doc_id"].eqNullSafe(wanted["doc_id"]) & (rows["k"] == wanted["k"])
    return rows.join(wanted, match).select(rows["text"], "cuts").mapInArrow(cut, "m long, d long, classes long, content binary")


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of spans that overlap or touch."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    first = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]]))
    last = np.append(first[1:], len(starts)) - 1
    return list(zip(starts[first].tolist(), reach[last].tolist(), strict=True))


def remove_repeats(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: bytes, bytes in repeats, maximal runs of them, and the digest of the rest."""
    rows = keyed(docs, doc_id, text)
    spans = repeated_spans(rows, length)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            spans = batch.column("spans")
            flat, places = spans.flatten(), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(spans), 0).to_numpy())])
            starts, ends = (flat.field(i).to_numpy() for i in range(2))
            for row, content in enumerate(batch.column("text").to_pylist()):
                own = slice(places[row], places[row + 1])
                data, runs = content.encode(), merged(starts[own], ends[own])
                edges = [0, *[x for run in runs for x in run], len(data)]
                kept = hashlib.sha256()
                for a, b in zip(edges[::2], edges[1::2], strict=True):
                    kept.update(data[a:b])
                for column, value in zip(out, (len(data), sum(b - a for a, b in runs), len(runs), kept.hexdigest()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    match = rows["doc_id"].eqNullSafe(spans["doc_id"]) & (rows["k"] == spans["k"])
    return rows.join(spans, match, "left").select(rows["doc_id"], rows["text"], "spans").mapInArrow(cut, REMOVED)

"""Texts of an Arrow batch as codes of their distinct words, each handled once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 16 << 20
MEMO_ENTRIES = 1 << 19


class Memo:
    """Remembers results per key in two generations of bounded size.

    When the young one is full it becomes the old one; what is still in use
    moves back on its next hit.  Forgetting only costs time.
    """

    def __init__(self, entries: int = MEMO_ENTRIES) -> None:
        self.entries, self.young, self.old = entries, {}, {}

    def get(self, key):
        value = self.young.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.young) >= self.entries:
            self.old, self.young = self.young, {}
        self.young[key] = value


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Pieces of ``batch`` of about ``limit`` bytes of text (one row at least), with the text column, null as empty."""
    texts = pc.fill_null(batch.column(text), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start), texts.slice(start, stop - start)
        start = stop


def word_codes(
    texts: pa.Array, odd: pa.Array, split_odd: Callable[[str], list[str]], separator: str = " "
) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Codes of all words in order, the first word of each text (and the end), and the distinct words.

    Texts are split at ``separator``, those marked ``odd`` by ``split_odd`` instead.
    """
    is_odd = odd.to_numpy(zero_copy_only=False)
    if is_odd.any():
        plain, strange = np.flatnonzero(~is_odd), np.flatnonzero(is_odd)
        lists = pa.concat_arrays([
            pc.split_pattern(texts.take(pa.array(plain)), separator),
            pa.array([split_odd(t) for t in texts.take(pa.array(strange)).to_pylist()], pa.list_(pa.string())),
        ])
        order = np.empty(len(texts), np.int64)
        order[np.concatenate([plain, strange])] = np.arange(len(texts))
        lists = lists.take(pa.array(order))
    else:
        lists = pc.split_pattern(texts, separator)
    starts = lists.offsets.to_numpy()
    starts = starts - starts[0]
    coded = pc.dictionary_encode(lists.flatten())
    return coded.indices.to_numpy(), starts, coded.dictionary.to_pylist()


def gathered_ids(codes: np.ndarray, starts: np.ndarray, encoded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All token ids in order and the first id of each text (and the end); ``encoded`` has int32 ids per distinct word."""
    ends = np.cumsum([0, *map(len, encoded)], dtype=np.int64) // 4
    lists = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(encoded), np.int32)))
    taken = lists.take(pa.array(codes))
    offsets = taken.offsets.to_numpy()
    offsets = offsets - offsets[0]
    return taken.flatten().to_numpy(), offsets[starts]

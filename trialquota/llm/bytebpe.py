"""Byte-level BPE by dynamic programming over prefixes.

Every byte prefix of a piece has one encoding, and that encoding has one last
token.  The table of last tokens is filled from left to right: a token that
ends a prefix is its last one exactly when it may follow the last token of the
prefix before it.  Reading the table from the end gives the encoding.  The
table of a longer piece starts with the table of its beginning, so text can be
appended, and after an edit only a window has to be filled again.

Defined cases: a null text counts as empty and has no tokens; texts of any
length and repeated rows are encoded row by row; columns other than the two
named are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from trialquota.llm.wordcodes import SLICE_BYTES, Memo, gathered_ids, slices, word_codes

NO_LIMIT = 1 << 62
PAIRS = 1 << 20
#: White space after a space, a text that ends with one, or the mark that is put before spaces.
ODD = r"[ ][\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ ]$|\x{00}"


class PrefixEncoder:
    """Encodes byte strings by the ranks of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, ranks))
        self.halves: dict[int, tuple[int, int]] = {}
        for token, rank in ranks.items():
            if len(token) > 1:
                parts = self._merged(token, rank)
                # A token that its own merges don't reach is never chosen inside a piece.
                if len(parts) == 2:
                    self.halves[rank] = (ranks[parts[0]], ranks[parts[1]])
        #: Token of every ending of a token, or -1 for an ending that is none itself.
        self.endings = {t[i:]: -1 for t in ranks for i in range(1, len(t))}
        self.endings |= {t: r for t, r in ranks.items() if len(t) == 1 or r in self.halves}
        #: Answers of ``may_follow`` already known.
        self.follows: dict[int, bool] = {}

    def _merged(self, token: bytes, below: int) -> list[bytes]:
        """Parts of ``token`` after all merges of a rank under ``below``."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            found = [(self.ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            rank, i = min(found)
            if rank >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the encoding of both tokens' bytes is just these two.

        Undo merges from the latest to the earliest.  At each step the parts at
        the seam existed together; if they form a token whose merge comes before
        the one undone last, that merge would have crossed the seam.
        """
        tokens, ranks, halves = self.tokens, self.ranks, self.halves
        limit = NO_LIMIT
        while True:
            if ranks.get(tokens[left] + tokens[right], limit) < limit:
                return False
            a, b = halves.get(left), halves.get(right)
            if a and (b is None or left > right):
                limit, left = left, a[1]
            elif b:
                # On a tie of rank the left occurrence is merged first.
                limit, right = right + 1, b[0]
            else:
                return True

    def fill(self, data: bytes, last: list[int], begin: int, stop=None) -> list[int]:
        """Last tokens of all prefixes; those up to ``begin`` bytes are in ``last`` already."""
        endings, follows, may_follow = self.endings, self.follows, self.may_follow
        for end in range(begin + 1, len(data) + 1):
            # All tokens that end here, found from the shortest on.
            start, found = end - 1, []
            while start >= 0 and (token := endings.get(data[start:end])) is not None:
                if token >= 0:
                    found.append((start, token))
                start -= 1
            for start, token in reversed(found):
                if start:
                    pair = last[start] << 32 | token
                    if (fits := follows.get(pair)) is None:
                        if len(follows) >= PAIRS:
                            follows.clear()
                        fits = follows[pair] = may_follow(last[start], token)
                    if not fits:
                        continue
                last.append(token)
                break
            if stop and stop(end, last):
                break
        return last

    def table(self, data: bytes) -> list[int]:
        return self.fill(data, [-1], 0)

    def append(self, data: bytes, last: list[int], more: bytes) -> tuple[bytes, list[int]]:
        """Table of ``data + more`` from that of ``data``."""
        whole = data + more
        return whole, self.fill(whole, list(last), len(data))

    def edit(self, data: bytes, last: list[int], start: int, end: int, new: bytes) -> tuple[bytes, list[int]]:
        """Table after data[start:end] is replaced by ``new``.

        The tail of the old table holds again once as many prefixes in a row as
        the longest token has bytes end alike in both, and so begin in this run.
        """
        whole = data[:start] + new + data[end:]
        shift, settled, run = len(whole) - len(data), start + len(new), [0]

        def alike(at: int, table: list[int]) -> bool:
            run[0] = run[0] + 1 if at > settled and table[at] == last[at - shift] else 0
            return run[0] > self.longest

        table = self.fill(whole, last[: start + 1], start, alike)
        return whole, table + last[len(table) - shift :]

    def ids(self, data: bytes, last: list[int]) -> list[int]:
        found, end = [], len(data)
        while end:
            found.append(last[end])
            end -= len(self.tokens[last[end]])
        return found[::-1]

    def encode(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.ids(data, self.table(data))


class TextCodec:
    """Encodes and decodes batches of texts; pieces are the matches of ``pattern``."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.encoder, self.pattern, self.memo = PrefixEncoder(ranks), regex.compile(pattern), Memo()
        self.bytes = pa.array(self.encoder.tokens, pa.binary())
        self.decimals = pa.array([b"%d " % i for i in range(len(self.encoder.tokens))], pa.binary())

    def _word(self, word: str) -> bytes:
        memo, parts = self.memo, []
        letters = word.isalpha() or (word[:1] == " " and word[1:].isalpha())
        for piece in (word,) if letters else self.pattern.findall(word):
            ids = memo.get(piece)
            if ids is None:
                ids = np.array(self.encoder.encode(piece.encode()), np.int32).tobytes()
                memo.put(piece, ids)
            parts.append(ids)
        return b"".join(parts)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the first of each text (and the end).

        A space before another character always begins a piece, so texts are
        cut there and each distinct part is encoded once.
        """
        odd = pc.match_substring_regex(texts, ODD)
        marked = pc.if_else(odd, texts, pc.replace_substring(texts, " ", "\x00 "))
        codes, starts, words = word_codes(marked, odd, self.pattern.findall, "\x00")
        return gathered_ids(codes, starts, [self._word(w) for w in words])


def spans(values: pa.Array, starts: np.ndarray) -> Iterator[memoryview]:
    """Bytes of ``values`` between consecutive starts, without copying."""
    _, offsets, data = values.buffers()
    ends = np.frombuffer(offsets, np.int32)[values.offset : values.offset + len(values) + 1][starts]
    view = memoryview(data) if data else memoryview(b"")
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        yield view[a:b]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> TextCodec:
    return TextCodec(load_ranks(path), pattern)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_decode(
    docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """Per row: number of ids, digest of the ids, digest of the bytes decoded from them.

    Texts are worked on in slices of about ``slice_bytes`` (one text at least), which bounds a task's memory.
    """

    def digests(batches):
        own = codec(path, pattern)
        for batch in batches:
            for part, texts in slices(batch, text, slice_bytes):
                ids, starts = own.encode(texts)
                taken = pa.array(ids)
                shown = [hashlib.sha256(x[:-1]).hexdigest() for x in spans(own.decimals.take(taken), starts)]
                decoded = [hashlib.sha256(x).hexdigest() for x in spans(own.bytes.take(taken), starts)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(doc_id), pa.array(np.diff(starts)), pa.array(shown), pa.array(decoded)],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(doc_id, text).mapInArrow(digests, SCHEMA)

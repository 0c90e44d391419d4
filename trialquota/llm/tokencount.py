"""Token counts by heap-and-linked-list byte-pair merging.

The characters of a word form a linked list.  A heap holds the adjacent pairs
that are pieces of the vocabulary; the pair of the best rank, leftmost on ties,
is merged until none is left.  The count is the initial number of symbols minus
the merges; no ids are made.  A character outside the vocabulary counts as its
UTF-8 bytes.

Defined cases: a null text counts as empty and has no tokens; texts of any
length and repeated rows are counted row by row; columns other than the two
named are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from trialquota.llm.wordcodes import Memo, slices, word_codes

SPACE = "▁"
#: Runs of spaces, spaces at either end, or the character that stands for a space.
ODD = "  |^ | $|" + SPACE
RUNS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
TOKEN_LIMIT = 4096


class PairMerger:
    """Counts the pieces that merging by rank leaves of a string."""

    def __init__(self, pieces: dict[str, float]) -> None:
        order = {s: r for r, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        self.rank = {piece: order[score] for piece, score in pieces.items()}
        #: Two characters that stand side by side in no piece are never merged across.
        self.adjacent = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("pieces must not hold a space after another character")

    def count(self, text: str) -> int:
        rank, symbols = self.rank, list(text)
        n = len(symbols)
        heap = [(rank[pair], i, 2) for i in range(n - 1) if (pair := text[i : i + 2]) in rank]
        if heap:
            heapify(heap)
            after, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
            while heap:
                _, left, length = heappop(heap)
                symbol = symbols[left]
                right = after[left]
                # A pair is stale if either side has been merged meanwhile.
                if not symbol or right >= n or len(symbol) + len(symbols[right]) != length:
                    continue
                symbols[left] = symbol = symbol + symbols[right]
                symbols[right] = ""
                merges += 1
                after[left] = right = after[right]
                if right < n:
                    before[right] = left
                    if (r := rank.get(symbol + symbols[right])) is not None:
                        heappush(heap, (r, left, length + len(symbols[right])))
                if (left := before[left]) >= 0 and (r := rank.get(symbols[left] + symbol)) is not None:
                    heappush(heap, (r, left, length + len(symbols[left])))
            n -= merges
        if not text.isascii() or any(s and s not in rank for s in symbols):
            n += sum(len(s.encode()) - 1 for s in symbols if s and s not in rank)
        return n


class TokenCounter:
    """Counts tokens of texts; words are counted once and remembered."""

    def __init__(self, model: str) -> None:
        vocabulary = sentencepiece.SentencePieceProcessor(model_file=model)
        ids = range(vocabulary.get_piece_size())
        special = (vocabulary.is_byte, vocabulary.is_control, vocabulary.is_unknown)
        self.merger = PairMerger({vocabulary.id_to_piece(i): vocabulary.get_score(i) for i in ids if not any(f(i) for f in special)})
        self.memo = Memo()

    def word(self, word: str) -> int:
        """Tokens of a space and ``word``."""
        found = self.memo.get(word)
        if found is None:
            adjacent, cut = self.merger.adjacent, len(word)
            while cut > 1 and not word[cut - 1].isalnum():
                cut -= 1
            if cut < len(word) and word[cut - 1 : cut + 1] not in adjacent:
                found = self.word(word[:cut]) + self.merger.count(word[cut:])
                return found
            found = self.merger.count(SPACE + word)
            self.memo.put(word, found)
        return found

    @staticmethod
    def runs(text: str) -> list[str]:
        """Words of a text with runs of spaces, each without the space before it."""
        return [run[1:] for run in RUNS.findall(SPACE + text.replace(" ", SPACE))] if text else []

    def counts(self, texts: pa.Array) -> np.ndarray:
        codes, starts, words = word_codes(texts, pc.match_substring_regex(texts, ODD), self.runs)
        per_word = np.array([self.word(w) for w in words], np.int64)
        running = np.concatenate([[0], np.cumsum(per_word[codes])])
        counts = running[starts[1:]] - running[starts[:-1]]
        return np.where(pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0, 0, counts)


@lru_cache(maxsize=2)
def counter(model: str) -> TokenCounter:
    return TokenCounter(model)


SCHEMA = "doc_id long, n_bytes long, n_tokens long"


def count_tokens(
    docs: DataFrame, model: str, limit: int = TOKEN_LIMIT, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: UTF-8 bytes, tokens, and whether there are more than ``limit`` tokens."""

    def counts(batches):
        own = counter(model)
        for batch in batches:
            for part, texts in slices(batch, text):
                n_bytes = pc.cast(pc.binary_length(texts), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(doc_id), n_bytes, pa.array(own.counts(texts))], names=["doc_id", "n_bytes", "n_tokens"]
                )

    return docs.select(doc_id, text).mapInArrow(counts, SCHEMA).withColumn("over_limit", F.col("n_tokens") > limit)

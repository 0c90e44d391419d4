"""Best-fit packing of token sequences under several capacities at once.

A document's ids (tokenizers, ``add_special_tokens=False``) end with the end
id.  A document longer than the sequence length is cut into full pieces; only
its first piece may be shorter.  Pieces are packed into sequences by vector
best fit: every open sequence has residual capacities of tokens, documents and
attention cost (the sum of squared piece lengths).  A piece goes to a sequence
where it fits under every capacity, chosen by the least weighted norm of the
residuals it would leave (``rule="norm"``) or by the largest weighted dot
product of the piece's demand and the residuals (``rule="dot"``), ties to the
earliest opened sequence; where none fits, a new sequence opens.  Pieces are
placed longest first.

Scale: tokenizing runs on Arrow batches in slices of about a megabyte of text,
by rank merging over the file's own vocabulary (``TokenEncoder``, equal to the
library's ids and tested so), and keeps only lengths and checksums.  Pieces are dealt by a hash of their row into groups of about
``GROUP_PIECES``, each packed in one task with memory linear in the group; a
group leaves at most a few sequences less full than one global pass would.
Every piece is packed; nothing is dropped or capped.

Defined cases: a null text counts as empty and gives one piece of the end id;
very long texts are cut whole into pieces; repeated rows are packed as separate
documents; an empty table gives no rows; columns other than doc_id and text
are ignored.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, functions as F

from trialquota.llm.common import stage
from trialquota.llm.wordcodes import slices

SLICE_BYTES = 1 << 20

GROUP_PIECES = 20_000
PIECES_SCHEMA = "_row long, doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
PIECES_ARROW = pa.schema(
    [("_row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
)
PLACED_ARROW = pa.schema([*[PIECES_ARROW.field(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")], ("sequence_id", pa.int64()), ("offset", pa.int64())])


@dataclass(frozen=True)
class Capacities:
    """What one sequence holds, and how much each residual weighs in the choice."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.25, 0.25)
    rule: str = "norm"


def byte_table() -> dict[str, int]:
    """The byte-level tokenizers' stand-in characters: printable Latin-1 stands for itself, other bytes for 256 onwards."""
    kept = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + n): b for n, b in enumerate(others)}


class TokenEncoder:
    """Ids of a byte-level BPE tokenizer file, as the tokenizers library gives them without added special tokens.

    The file's vocabulary becomes ranks of byte strings.  Merging the lowest rank
    first equals applying the file's merges in order when the merged tokens' ids
    grow with the merge order; that is checked on loading, and a file where it
    fails is refused.  Special strings in a text are matched first and stand for
    their ids, as the library does by default; the rest is split by ``pattern``.
    """

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model.get("type") != "BPE" or spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError("only byte-level BPE files without normalizer are supported")
        table, vocab = byte_table(), model["vocab"]
        ranks = {bytes(table[c] for c in token): i for token, i in vocab.items()}
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if any(a >= b for a, b in zip(merged, merged[1:])) or (merged and min(merged) <= max(ranks[bytes([b])] for b in range(256))):
            raise ValueError("merge order and token ids differ; rank merging would give other ids")
        specials = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
        plain = {k: v for k, v in ranks.items() if v not in specials.values()}
        self.encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=plain, special_tokens=specials)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.encoding.encode_batch(texts, allowed_special="all", num_threads=1)


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> TokenEncoder:
    return TokenEncoder(path, pattern)


def cut(n: int, limit: int) -> list[int]:
    """Piece lengths of ``n`` ids: full pieces, the first one possibly shorter."""
    full = (n - 1) // limit if n > limit else 0
    return [n - full * limit] + [limit] * full


def pieces_of(batches, path: str, pattern: str, end_id: int, limit: int):
    """(_row, doc_id, piece, start, length, ids_crc32) for every piece of every document."""
    own = encoder(path, pattern)
    for batch in batches:
        for part, texts in slices(batch, "text", SLICE_BYTES):
            out = {k: [] for k in ("_row", "doc_id", "piece", "start", "length", "ids_crc32")}
            encoded = own.encode(texts.to_pylist())
            for row, doc_id, ids in zip(part.column("_row").to_pylist(), part.column("doc_id").to_pylist(), encoded):
                ids = np.asarray(ids + [end_id], dtype="<u4")
                start = 0
                for k, length in enumerate(cut(len(ids), limit)):
                    out["_row"].append(row)
                    out["doc_id"].append(doc_id)
                    out["piece"].append(k)
                    out["start"].append(start)
                    out["length"].append(length)
                    out["ids_crc32"].append(zlib.crc32(ids[start : start + length].tobytes()))
                    start += length
            yield pa.RecordBatch.from_pydict(out, schema=PIECES_ARROW)


def best_fit(lengths: np.ndarray, caps: Capacities) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, placed in the given order (longest first expected)."""
    size = len(lengths)
    sequence, offset = np.empty(size, dtype=np.int64), np.empty(size, dtype=np.int64)
    scale = np.array([caps.tokens, caps.documents, caps.attention], dtype=np.float64)
    w = np.asarray(caps.weights, dtype=np.float64)
    # Residuals of the sequences that can still take a piece, and their numbers.
    res = np.empty((0, 3), dtype=np.int64)
    ids = np.empty(0, dtype=np.int64)
    used = []
    for i, s in enumerate(lengths.tolist()):
        need = np.array([s, 1, s * s], dtype=np.int64)
        if any(need > [caps.tokens, caps.documents, caps.attention]):
            raise ValueError("a piece exceeds the capacity of a sequence")
        fits = np.flatnonzero((res >= need).all(axis=1)) if len(ids) else np.empty(0, dtype=np.int64)
        if len(fits):
            left = (res[fits] - need) / scale
            if caps.rule == "dot":
                score = -((need / scale) * (res[fits] / scale) * w).sum(axis=1)
            else:
                score = (left * left * w).sum(axis=1)
            at = fits[np.argmin(score)]
            seq = int(ids[at])
            res[at] -= need
            if res[at, 0] == 0 or res[at, 1] == 0:
                res, ids = np.delete(res, at, axis=0), np.delete(ids, at)
        else:
            seq = len(used)
            used.append(0)
            rest = np.array([caps.tokens, caps.documents, caps.attention], dtype=np.int64) - need
            if rest[0] > 0 and rest[1] > 0:
                res, ids = np.vstack([res, rest]), np.append(ids, seq)
        sequence[i], offset[i] = seq, used[seq]
        used[seq] += s
    return sequence, offset


def pack_group(table: pa.Table, caps: Capacities) -> pa.Table:
    order = pc.sort_indices(
        table, [("length", "descending"), ("doc_id", "ascending"), ("_row", "ascending"), ("piece", "ascending")], null_placement="at_start"
    )
    table = table.take(order)
    sequence, offset = best_fit(table.column("length").to_numpy(), caps)
    group = table.column("_group")[0].as_py() if len(table) else 0
    columns = [table.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
    return pa.Table.from_arrays([*columns, pa.array(group * (1 << 32) + sequence), pa.array(offset)], schema=PLACED_ARROW)


def pack(docs: DataFrame, path: str, pattern: str, end_id: int = 0, caps: Capacities = Capacities()) -> DataFrame:
    """Pieces of all documents with their sequence and place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``sequence_id`` is the group number times 2**32 plus the sequence's number in its group.
    """
    # Row numbers of a scan follow its file splits, so a task run again numbers alike.
    rows = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").alias("text")).withColumn(
        "_row", F.monotonically_increasing_id()
    )
    limit = caps.tokens
    pieces = stage(rows.mapInArrow(lambda b: pieces_of(b, path, pattern, end_id, limit), PIECES_SCHEMA), "packing-pieces")
    groups = max(1, -(-pieces.rows // GROUP_PIECES))
    keyed = pieces.df.withColumn("_group", F.pmod(F.xxhash64("_row", "piece"), F.lit(groups)))
    return keyed.groupBy("_group").applyInArrow(lambda t: pack_group(t, caps), PLACED_SCHEMA)

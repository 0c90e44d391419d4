"""Token ids in ORC files that are read back stripe by stripe.

Documents are sorted by id over range partitions and encoded after the sort, so
every file holds ascending ids and is written once.  ORC run-length encodes the
ids; row indexes and a Bloom filter on the document id let a reader skip stripes
and row groups.  Each row also has its part and the number of ids before it in
the part, so the place of a document in the whole stream needs only the totals
of the parts.

Defined cases: a null text counts as empty and gets the end id only; null
document ids come first; rows with equal ids are ordered by text; an empty
table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from trialquota.llm.wordcodes import Memo, gathered_ids, slices, word_codes

END_ID = 1
WORD_END = "</w>"
#: Letters whose normal form and lower case depend on nothing around them, then other marks of ASCII.
SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
PIECE = re.compile(r"[a-zß-öø-ÿ]+|[!-&(-/:-@\[-`{-~]+")
MIXED = r"[^a-z0-9\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}][.,] "
JOINED = 2000
SLICE_BYTES = 8 << 20
MEMO_ENTRIES = 3 << 17
SCHEMA = "doc_id long, part int, before long, ids array<int>"
OPTIONS = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "2000", "orc.compress": "ZLIB"}


class WordEncoder:
    """Encodes words with the library; no token of this vocabulary crosses white space."""

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        for token, i in self.library.get_vocab().items():
            self.ends[i] = token.endswith(WORD_END)
        self.special = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        self.memo = Memo(MEMO_ENTRIES)

    def library_ids(self, words: list[str]) -> list[bytes]:
        encoded = self.library.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, np.int32).tobytes() for e in encoded]

    def simple_ids(self, parts: list[str]) -> list[bytes]:
        """Ids of parts that are one piece each: many are joined by spaces, and cut at the word ends."""
        found = []
        for at in range(0, len(parts), JOINED):
            group = parts[at : at + JOINED]
            ids = np.array(self.library.encode_batch_fast([" ".join(group)], add_special_tokens=False)[0].ids, np.int32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(group):
                found += self.library_ids(group)
                continue
            starts = np.concatenate([[0], cuts[:-1]]).tolist()
            raw = ids.tobytes()
            found += [raw[4 * a : 4 * b] for a, b in zip(starts, cuts.tolist(), strict=True)]
        return found

    def parts(self, word: str) -> tuple[str, str]:
        """A word as two pieces that can be encoded apart; lower-cased where that depends on nothing else."""
        match = SIMPLE.fullmatch(word)
        if match and not any(s in word for s in self.special):
            return match[1].lower(), match[2]
        return word, ""

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of each word, A-Z lower-cased before; new parts are encoded together."""
        get = self.memo.get
        found = [get(word) for word in words]
        new = [i for i, ids in enumerate(found) if ids is None]
        known: dict[str, bytes] = {"": b""}
        split, simple, other = [], {}, {}
        for i in new:
            word = words[i]
            parts = (word, "") if word.isascii() and word.isalpha() else self.parts(word)
            split.append(parts)
            for part in parts:
                if part and part not in known:
                    # A part of the memory may be known although its word is not.
                    ids = get(part)
                    if ids is not None:
                        known[part] = ids
                    elif parts[1] or PIECE.fullmatch(part):
                        simple[part] = None
                    else:
                        # Whatever is not one piece by itself goes to the library alone.
                        other[part] = None
        for names, encode in ((list(simple), self.simple_ids), (list(other), self.library_ids)):
            known.update(zip(names, encode(names) if names else (), strict=True))
        put = self.memo.put
        for i, (stem, tail) in zip(new, split, strict=True):
            found[i] = ids = known[stem] + known[tail]
            put(words[i], ids)
        return found

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        # Lower-casing A-Z first makes more words alike; it must not make a special token out of another string.
        lowered = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        lowered = pc.replace_substring(lowered, "\n", " ")
        # A comma or stop after a letter or digit is a piece of its own; apart from its word it needs no second look.
        apart = pc.replace_substring(pc.replace_substring(lowered, ", ", " , "), ". ", " . ")
        lowered = pc.if_else(pc.match_substring_regex(lowered, MIXED), lowered, apart)
        codes, starts, words = word_codes(lowered, pa.array(np.zeros(len(texts), bool)), list)
        return gathered_ids(codes, starts, self.words(words))


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encoded_rows(docs: DataFrame, tokenizer: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, part, before, ids) in ascending order within and over partitions."""
    ordered = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # The text only breaks ties of the id; a hash spares the range sample from carrying it.
    keyed = ordered.withColumn("_tie", F.xxhash64("text"))
    by = ["doc_id", "_tie", "text"]

    def encode(batches):
        own, part, before = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows, texts in slices(batch, "text", SLICE_BYTES):
                ids, starts = own.texts(texts)
                n = len(texts)
                full = np.insert(ids, starts[1:], end_id).astype(np.int32, copy=False)
                ends = starts + np.arange(n + 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id"), pa.array(np.full(n, part, np.int32)), pa.array(ends[:-1] + before),
                        pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(full)),
                    ],
                    names=["doc_id", "part", "before", "ids"],
                )
                before += int(ends[-1])

    return keyed.repartitionByRange("doc_id", "_tie").sortWithinPartitions(*by).drop("_tie").mapInArrow(encode, SCHEMA)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, **columns: str) -> None:
    encoded_rows(docs, tokenizer, end_id, **columns).write.options(**OPTIONS).orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).orc(path)


def find_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Rows of a few documents: stripes and row groups are skipped by their indexes and Bloom filters."""
    return read_token_files(spark, path).where(F.col("doc_id").isin(doc_ids))


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document from the files: place of its first id, ids, and their checksum."""

    def checksums(batches):
        for batch in batches:
            ids = batch.column("ids")
            offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4", copy=False)
            crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), batch.column("before"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())],
                names=["doc_id", "part", "before", "n_tokens", "ids_crc32"],
            )

    files = read_token_files(spark, path)
    rows = files.mapInArrow(checksums, "doc_id long, part int, before long, n_tokens long, ids_crc32 long")
    # One row per part; the totals are read without the ids.
    totals = files.groupBy("part").agg(F.max(F.col("before") + F.size("ids")).alias("total"))
    running = F.sum("total").over(Window.orderBy("part")) - F.col("total")
    bases = totals.select("part", running.alias("base"))
    return rows.join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
from helpers import awkward_documents, by_id, documents, sha
from tokenizers import Tokenizer

from trialquota.llm import bytebpe, common, tokencount, tokenfiles, wordcodes

BYTES = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PARTS = [
    "a", " ", "\n", "  ", "the", "'s", "'ll", "é", "é", "日本", "1", "23", "!!", "\t", "\x1c", "\x85", " ", "　", "😀", "\0",
    "<|endoftext|>", "<|ENDOFTEXT|>", "</s>", "_", "  \n", "er", "́", "ﬁ", "▁", "I'M", "İ", "ΑΣ", "ß", "Don't", ".", "..", ", ", "É", "Word,",
]


@pytest.fixture(scope="module")
def odd_texts():
    rnd = random.Random(3)
    made = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 25))) for _ in range(4000)]
    return [*made, "", "a" * 3000, " " * 1000, "ab" * 2000, "\n" * 300, "..." * 300]


def test_counts_equal_library(odd_texts):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    found = tokencount.counter(PIECES).counts(pa.array(odd_texts)).tolist()
    assert found == [len(ids) for ids in library.encode(odd_texts, num_threads=1)]


def test_byte_ids_equal_library(odd_texts):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.load_ranks(BYTES), special_tokens={})
    ids, starts = bytebpe.codec(BYTES, public_tokenizers.PATTERN).encode(pa.array(odd_texts))
    assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])] == [library.encode_ordinary(t) for t in odd_texts]


def test_word_ids_equal_library(odd_texts):
    library = Tokenizer.from_file(WORDS)
    ids, starts = tokenfiles.encoder(WORDS).texts(pa.array(odd_texts))
    want = [e.ids for e in library.encode_batch(odd_texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])] == want


def test_prefix_table_append_and_edit():
    encoder, rnd = bytebpe.codec(BYTES, public_tokenizers.PATTERN).encoder, random.Random(1)
    for _ in range(60):
        data = bytes(rnd.choice(b"aabcdthe rin") for _ in range(rnd.randint(0, 400)))
        more = bytes(rnd.choice(b"aabcdthe rin") for _ in range(rnd.randint(0, 9)))
        last = encoder.table(data)
        whole, table = encoder.append(data, last, more)
        assert (whole, table) == (data + more, encoder.table(data + more))
        i = rnd.randint(0, len(data))
        j = rnd.randint(i, min(len(data), i + 9))
        whole, table = encoder.edit(data, last, i, j, more)
        assert whole == data[:i] + more + data[j:] and table == encoder.table(whole)


def test_memo_forgets_within_bounds():
    memo = wordcodes.Memo(4)
    for i in range(100):
        memo.put(i, i + 1)
    assert memo.get(99) == 100 and len(memo.young) + len(memo.old) <= 8


def test_slices_cover_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n if n else None for n in range(50)])], names=["text"])
    parts = list(wordcodes.slices(batch, "text", 100))
    assert [t for _, texts in parts for t in texts.to_pylist()] == ["x" * n for n in range(50)]


def test_count_query_shape(spark):
    rows = awkward_documents()
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    found = tokencount.count_tokens(documents(spark, rows), PIECES).collect()
    want = [(r[0], len((r[1] or "").encode()), n := len(library.encode(r[1] or "")), n > 4096) for r in rows]
    assert by_id(found) == by_id(want)
    assert tokencount.count_tokens(documents(spark, []), PIECES).count() == 0


def test_codec_query(spark):
    rows = awkward_documents()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.load_ranks(BYTES), special_tokens={})
    found = bytebpe.encode_decode(documents(spark, rows), BYTES, public_tokenizers.PATTERN).collect()
    want = [(r[0], len(ids := library.encode_ordinary(r[1] or "")), sha(" ".join(map(str, ids))), sha(r[1] or "")) for r in rows]
    assert by_id(found) == by_id(want)
    assert bytebpe.encode_decode(documents(spark, []), BYTES, public_tokenizers.PATTERN).count() == 0


def test_token_files(spark):
    rows = awkward_documents()
    path = common.staged_path(spark, "token-test")
    tokenfiles.write_token_files(documents(spark, rows), path, WORDS)
    found = tokenfiles.token_index(spark, path).collect()
    library = Tokenizer.from_file(WORDS)
    ids = [library.encode(r[1] or "", add_special_tokens=False).ids + [1] for r in rows]
    want = sorted((r[0] is not None, r[0] or 0, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for r, i in zip(rows, ids))
    got = sorted(found, key=lambda r: r.start)
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == [w[:2] for w in want]
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:i]) for i in range(len(got))]
    assert [r.doc_id for r in tokenfiles.find_documents(spark, path, [9]).collect()] == [9]


def test_token_files_of_an_empty_table(spark):
    path = common.staged_path(spark, "token-empty")
    tokenfiles.write_token_files(documents(spark, []), path, WORDS)
    assert tokenfiles.token_index(spark, path).count() == 0

import zlib

import numpy as np
import public_tokenizers
from helpers import awkward_documents, documents
from tokenizers import Tokenizer

from trialquota.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_best_fit(lengths, caps):
    """Sequences as lists of lengths, by the same rule, over a plain list of bins."""
    bins = []  # [tokens left, docs left, attention left, used]
    where = []
    cap = (caps.tokens, caps.documents, caps.attention)
    for s in lengths:
        need = (s, 1, s * s)
        best, best_score = None, None
        for b, (t, d, a, _) in enumerate(bins):
            if t >= s and d >= 1 and a >= s * s and t > 0 and d > 0:
                rest = (t - s, d - 1, a - s * s)
                if caps.rule == "dot":
                    score = -sum(w * (n / c) * (r / c) for w, n, r, c in zip(caps.weights, need, (t, d, a), cap))
                else:
                    score = sum(w * (r / c) ** 2 for w, r, c in zip(caps.weights, rest, cap))
                if best_score is None or score < best_score - 1e-15:
                    best, best_score = b, score
        if best is None:
            bins.append([caps.tokens, caps.documents, caps.attention, 0])
            best = len(bins) - 1
        t, d, a, used = bins[best]
        where.append((best, used))
        bins[best] = [t - s, d - 1, a - s * s, used + s]
    return where


def expected_pieces(rows, limit=2048):
    tok = Tokenizer.from_file(PATH)
    out = []
    for r in rows:
        ids = np.asarray(tok.encode(r[1] or "", add_special_tokens=False).ids + [0], dtype="<u4")
        start = 0
        for k, n in enumerate(packing.cut(len(ids), limit)):
            out.append((r[0], k, start, n, zlib.crc32(ids[start : start + n].tobytes())))
            start += n
    return sorted(out, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2], x[4]))


def check(found, caps):
    by_seq = {}
    for r in found:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_seq.values():
        parts.sort()
        assert sum(n for _, n in parts) <= caps.tokens and len(parts) <= caps.documents
        assert sum(n * n for _, n in parts) <= caps.attention
        at = 0
        for off, n in parts:
            assert off == at
            at += n
    return len(by_seq)


def test_token_encoder_equals_library():
    import random

    parts = ["a", " ", "\n", "  ", "the", "'s", "'ll", "é", "日本", "1", "23", "!!", "\t", " ", "　", "😀", "\0",
             "<|endoftext|>", "<|endoftext", "|>", "</s>", "Don't", ".", "..", ", ", "Word,", "   x", "\r\n"]
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(3000)] + ["", "ab " * 5000]
    library = Tokenizer.from_file(PATH)
    own = packing.TokenEncoder(PATH, public_tokenizers.PATTERN)
    assert own.encode(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert own.encode(texts[:50]) == [e.ids for e in library.encode_batch(texts[:50], add_special_tokens=False)]


def test_cut():
    assert packing.cut(1, 4) == [1] and packing.cut(4, 4) == [4]
    assert packing.cut(5, 4) == [1, 4] and packing.cut(8, 4) == [4, 4] and packing.cut(9, 4) == [1, 4, 4]


def test_awkward_rows_pieces_and_one_group_equal_brute_force(spark):
    rows = awkward_documents()
    found = packing.pack(documents(spark, rows), PATH, public_tokenizers.PATTERN).collect()
    got = sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2], x[4]))
    assert got == expected_pieces(rows)
    caps = packing.Capacities()
    n = check(found, caps)
    lengths = sorted((r.length for r in found), reverse=True)
    assert n == len({b for b, _ in plain_best_fit(lengths, caps)})


def test_binding_capacities_and_dot_rule():
    rnd = np.random.default_rng(5)
    lengths = np.sort(rnd.integers(1, 300, 400))[::-1]
    for caps in (packing.Capacities(tokens=512, documents=3, attention=100_000), packing.Capacities(tokens=512, rule="dot")):
        seq, off = packing.best_fit(lengths, caps)
        assert list(zip(seq.tolist(), off.tolist())) == plain_best_fit(lengths.tolist(), caps)


def test_groups_lose_little(spark):
    rows = [(i, "word " * (i * 37 % 900), "en", "s", 0, None, None, None) for i in range(3000)]
    old = packing.GROUP_PIECES
    packing.GROUP_PIECES = 700
    try:
        found = packing.pack(documents(spark, rows), PATH, public_tokenizers.PATTERN).collect()
    finally:
        packing.GROUP_PIECES = old
    caps = packing.Capacities()
    n = check(found, caps)
    total = sum(r.length for r in found)
    assert len(found) == 3000 and n <= -(-total // 2048) * 1.02 + 5


def test_empty(spark):
    assert packing.pack(documents(spark, []), PATH, public_tokenizers.PATTERN).collect() == []

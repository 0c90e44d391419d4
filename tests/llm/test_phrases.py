import random
import re
from collections import Counter

from helpers import awkward_documents, documents

from trialquota.llm import phrases


def brute(rows, top=phrases.TOP):
    counts, totals = Counter(), Counter()
    for r in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "")
        lang = r[2] or "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            ws = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang] += len(ws)
            for k in range(1, 5):
                for i in range(len(ws) - k + 1):
                    counts[lang, " ".join(ws[i : i + k])] += 1
    cands = {(lang, p): a for (lang, p), a in counts.items() if a >= 30 and 2 <= len(p.split(" ")) <= 4}
    out = []
    for (lang, p), a in cands.items():
        ws = p.split(" ")
        best = min(
            (2000000 * a // (counts[lang, " ".join(ws[:j])] + counts[lang, " ".join(ws[j:])]), j) for j in range(1, len(ws))
        )
        score, j = best
        l, r = counts[lang, " ".join(ws[:j])], counts[lang, " ".join(ws[j:])]
        dropped = any(
            lang == lang2 and len(q.split(" ")) > len(ws) and 100 * b >= 80 * a and f" {p} " in f" {q} "
            for (lang2, q), b in cands.items()
        )
        if not dropped:
            out.append((lang, p, a, l, r, totals[lang], score))
    ranked = []
    for lang in sorted({x[0] for x in out}):
        mine = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(lang, i + 1, x[1], x[2], x[3], x[4], x[5], x[6]) for i, x in enumerate(mine[:top])]
    return sorted(ranked)


def corpus(seed=3, n=400):
    rnd = random.Random(seed)
    vocab = "the of and river stone Light light x|y ñandú 日本 to be or not".split()
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rnd.randint(0, 12)):
            parts.append(" ".join(rnd.choice(vocab[: rnd.randint(3, len(vocab))]) for _ in range(rnd.randint(1, 7))))
            parts.append(rnd.choice([". ", ", ", "!\n", "\t", "  ", ";"]))
        rows.append((i, "".join(parts), rnd.choice(["en", "fr", None]), "s", 0, None, None, None))
    return rows + awkward_documents()


def run(spark, rows, sample=phrases.SAMPLE, top=phrases.TOP):
    old = phrases.SAMPLE
    phrases.SAMPLE = sample
    try:
        return sorted(tuple(r) for r in phrases.collocations(documents(spark, rows), top).collect())
    finally:
        phrases.SAMPLE = old


def test_equal_brute_force_at_any_sample(spark):
    rows = corpus()
    want = brute(rows)
    assert len(want) > 50
    assert run(spark, rows) == want
    assert run(spark, rows, sample=0.01) == want
    assert run(spark, rows, sample=1.0) == want
    assert run(spark, rows, top=7) == brute(rows, top=7)


def test_small_sample_needs_further_passes(spark):
    old = phrases.SAMPLE
    phrases.SAMPLE = 0.01
    try:
        _, _, figures = phrases.frequent_phrases(documents(spark, corpus()))
    finally:
        phrases.SAMPLE = old
    assert figures["passes"] > 1 and figures["failures"] > 0


def test_empty_and_awkward(spark):
    assert run(spark, []) == []
    assert run(spark, awkward_documents()) == brute(awkward_documents())


def test_filter_that_lets_others_through_stays_exact(spark, monkeypatch):
    # 64 bits hold hundreds of keys: nearly every phrase passes, in every pass.
    monkeypatch.setattr(phrases, "FILTER_BITS", 0)
    monkeypatch.setattr(phrases, "LARGEST_FILTER", 6)
    rows = corpus(n=150)
    assert run(spark, rows, sample=0.01) == brute(rows)


def test_copies_are_counted_before_they_reach_spark(spark):
    rows = [(i, "to be or not to be", "en", "s", 0, None, None, None) for i in range(500)]
    docs = documents(spark, rows).coalesce(1)
    words = phrases.stage(phrases.word_counts(docs), "test-words")
    grams = phrases.gram_counts(docs, phrases.bitmap(words), 2, 1)
    plan = grams._jdf.queryExecution().toString()
    assert "transform(" not in plan and "MapInArrow" in plan
    assert sorted((r.k, r.f) for r in grams.collect()) == [(2, 500), (2, 500), (2, 500), (2, 1000)]

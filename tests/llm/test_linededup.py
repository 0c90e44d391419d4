import random

import pytest
import xxhash
from helpers import Groups, awkward_documents, by_id, documents, sentence

from trialquota.llm import common, linededup


def fingerprint(norm):
    hashed = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in norm.split(" ") if len(w) > 1]
    if not hashed:
        return xxhash.xxh64(norm.encode(), seed=42).intdigest()
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def edits(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def expected(texts):
    """Texts (by id) without repeated lines."""
    places = {}
    for i in sorted(texts):
        for p, line in enumerate((texts[i] or "").split("\n")):
            norm = line.strip(" \t\r").lower()
            if len(norm) >= 12:
                places.setdefault(norm, []).append((i, p))
    names = list(places)
    prints = [fingerprint(n) for n in names]
    groups = Groups(range(len(names)))
    for i in range(len(names)):
        for j in range(i):
            a, b = names[i].split(" "), names[j].split(" ")
            longest = max(len(a), len(b))
            if (prints[i] ^ prints[j]).bit_count() <= 3 and edits(a, b) <= (1 - linededup.SIMILARITY) * longest + 1e-9:
                groups.join(i, j)
    together = {}
    for i, n in enumerate(names):
        together.setdefault(groups.find(i), []).extend(places[n])
    gone = {spot for spots in together.values() for spot in sorted(spots)[1:]}
    return {
        i: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in texts.items()
    }


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(11)
    long = " ".join(f"w{rnd.randint(0, 999)}" for _ in range(80))
    near = [long.replace(f"w{d}", f"v{d}", 1) for d in range(1, 9)] + [long + ".", long.upper(), "  " + long]
    lines = [long, *near, *[sentence(rnd, rnd.randint(2, 12)) for _ in range(12)], "a | b | c | d", "", "short"]
    made = {i: "\n".join(rnd.choice(lines) for _ in range(rnd.randint(0, 6))) for i in range(25)}
    return made | {50: None, 51: "", 52: "\n\n"}


@pytest.mark.parametrize("crowd", [64, 1])
def test_lines_equal_brute_force(spark, texts, crowd, monkeypatch):
    monkeypatch.setattr(linededup, "CROWD", crowd)
    rows = [(i, t, None, None, 0, "x", 1, None) for i, t in texts.items()]
    docs = documents(spark, rows)
    found = linededup.drop_repeated_lines(docs)
    assert found.columns == [*docs.columns, "_n_lines", "_n_removed"]
    want = expected(texts)
    assert {r.doc_id: r.text for r in found.collect()} == want
    assert sum(r._n_removed for r in found.collect()) > 20


def test_repeated_rows_keep_their_lines_together(spark):
    rows = [(1, "one line of some length\nanother line of some length", None, None, 0, None, None, None)] * 2
    rows += [(None, "one line of some length", None, None, 0, None, None, None)]
    found = linededup.line_dedup(documents(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.n_lines, r.n_removed) for r in found) == [(0, 1, 1), (1, 2, 0), (1, 2, 0)]


def test_awkward_rows_and_empty_table(spark):
    rows = awkward_documents()
    found = linededup.line_dedup(documents(spark, rows))
    assert by_id((r.doc_id,) for r in found.collect()) == by_id((r[0],) for r in rows)
    assert linededup.line_dedup(documents(spark, [])).count() == 0


def test_no_python_in_the_plan(spark):
    plan = linededup.line_dedup(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("counters", [{8: 63, 16: 16383}, {8: 2, 16: 70}])
def test_fingerprints_of_short_and_long_lines(spark, counters, monkeypatch):
    monkeypatch.setattr(linededup, "COUNTERS", counters)
    rnd = random.Random(3)
    made = [sentence(rnd, n) for n in (2, 6, 7, 8, 14, 61, 62, 63, 64, 65, 127, 128, 400)] + ["a b c d e f g", "aaaa " * 63 + "x", "bbbb " * 300]
    # Words whose hashes have the top bit, and words without it.
    top = [w for w in (f"w{i}" for i in range(400)) if xxhash.xxh64(w.encode(), seed=42).intdigest() >> 63]
    made += [" ".join(top[:63]), " ".join(top[:150]), " ".join(top[:1] * 63)]
    rows = [(i, line + "\n\t " + line + "\r", None, None, 0, None, None, None) for i, line in enumerate(made)] * 2
    lines = linededup.document_lines(documents(spark, rows), "doc_id", "text", 12)
    names = {r.h1: r.norm for r in lines.select("h1", "norm").distinct().collect()}
    found = {names[r.h1]: (r.fp & (1 << 64) - 1, r.n) for r in linededup.line_classes(lines).df.collect()}
    assert found == {n: (fingerprint(n), 4) for n in {m.lower().strip(" \t\r") for m in made}}


def test_lines_are_normalised_once_and_texts_split_once(spark):
    rows = [(i, "one line of some length\nanother line of some length", None, None, 0, None, None, None) for i in range(2)]
    found = linededup.line_dedup(documents(spark, rows))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    assert {"norm", "h1", "h2"} <= set(linededup.document_lines(documents(spark, rows), "doc_id", "text", 12).columns)
    assert sorted((r.doc_id, r.n_lines, r.n_removed) for r in found.collect()) == [(0, 2, 0), (1, 2, 2)]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_hashed_once_and_words_without_lambdas(spark):
    lines = linededup.document_lines(documents(spark), "doc_id", "text", 12)
    plan = plan_of(lines)
    assert 0 <= plan.find("Generate posexplode") < plan.find("AS _k1")
    assert "lambda" not in plan_of(linededup.counted_prints(lines.select("line", "h1", "h2", "norm"), 16).select("fp")).split("Generate posexplode")[0]


def test_only_pairs_alike_in_length_are_compared_and_written_tables_go(spark, monkeypatch):
    seen, verified = [], linededup.verified
    monkeypatch.setattr(linededup, "verified", lambda pairs, texts: (seen.append(pairs.count()), verified(pairs, texts))[1])
    # Same fingerprint, but ten words against forty; the third is alike to the first.
    lines = ["same " * 9 + "same", "same " * 39 + "same", "same " * 10 + "same"]
    rows = [(i, line, None, None, 0, None, None, None) for i, line in enumerate(lines)]
    before = set(common._made)
    found = linededup.line_dedup(documents(spark, rows))
    assert sorted((r.doc_id, r.n_removed) for r in found.collect()) == [(0, 0), (1, 0), (2, 1)]
    assert sum(seen) == 1
    left = {path.rsplit("/", 1)[1].rsplit("-", 1)[0] for path in set(common._made) - before}
    assert "line-drops" in left and not left & {"lines", "line-classes", "line-texts", "crowded-blocks", "fingerprints"}

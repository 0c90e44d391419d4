import re

import pytest
from helpers import SCHEMA, awkward_documents, by_id, documents, fold, sentence, sha

from trialquota.llm import decontam

ITEMS = "item_id long, text string, doc_id int"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text))


def expected(rows, items):
    windows = {}
    for item, text, _ in items:
        w = words(text)
        n = min(13, len(w))
        for s in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[s : s + n]), set()).add(item)
    out = []
    for r in rows:
        w, hit, found = words(r[1]), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[s : s + n]))) is not None:
                    hit.update(range(s, s + n))
                    found |= own
        named = sorted(str(i) for i in found if i is not None)
        out.append((r[0], len(w), len(hit), len(named), sha(",".join(named)), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.fixture(scope="module")
def cases():
    import random

    rnd = random.Random(5)
    passages = [" ".join(f"{rnd.choice('abcdef')}{rnd.randint(0, 60)}" for _ in range(rnd.randint(3, 40))) for _ in range(12)]
    items = [(i, p, i) for i, p in enumerate(passages)] + [(50, passages[0], 1), (51, "", 1), (52, None, 1), (None, "Straße ñandú", 1), (53, "?!", 1)]
    rows = awkward_documents()
    for i, p in enumerate(passages):
        upper = p.upper().replace(" ", "-, ")
        rows += [
            (200 + i, sentence(rnd, 30) + " " + upper + " " + sentence(rnd, 20), "en", "s", 1, None, None, None),
            (300 + i, " ".join(p.split()[1:]) + " " + sentence(rnd, 400), "en", "s", 1, None, None, None),
            (400 + i, p + " " + p, "en", "s", 1, None, None, None),
        ]
    return rows, items


def test_contamination_equals_brute_force(spark, cases):
    rows, items = cases
    found = decontam.contamination(documents(spark, rows), spark.createDataFrame(items, ITEMS)).drop("_k1", "_k2")
    assert by_id(found.collect()) == by_id(expected(rows, items))


def test_without_broadcast(spark, cases, monkeypatch):
    rows, items = cases
    monkeypatch.setattr("trialquota.llm.common.BROADCAST_ROWS", 0)
    found = decontam.contamination(documents(spark, rows), spark.createDataFrame(items, ITEMS)).drop("_k1", "_k2")
    assert by_id(found.collect()) == by_id(expected(rows, items))


def test_empty_tables(spark, cases):
    rows, items = cases
    none = spark.createDataFrame([], ITEMS)
    assert decontam.contamination(documents(spark, []), spark.createDataFrame(items, ITEMS)).count() == 0
    assert decontam.contamination(documents(spark, rows), none).where("contaminated").count() == 0


def test_filter(spark, cases):
    rows, items = cases
    docs = documents(spark, rows)
    kept = decontam.drop_contaminated(docs, spark.createDataFrame(items, ITEMS))
    wanted = [(r[0],) for r, e in zip(rows, expected(rows, items)) if not e[5]]
    assert kept.columns == docs.columns
    assert by_id((r.doc_id,) for r in kept.collect()) == by_id(wanted)
    assert SCHEMA.count(",") + 1 == len(kept.columns)

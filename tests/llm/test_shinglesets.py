import random

import pytest
from helpers import Groups, SCHEMA, awkward_documents, documents, fold, space_words

from trialquota.llm import shinglesets, simhash


def shingles(text, width=5):
    words = space_words(fold(text))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or {tuple(words)}


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def expected(rows, width=5):
    """Ids that stay, by comparing all pairs of texts; knows nothing of fingerprints."""
    sets = [shingles(r[1], width) for r in rows]
    groups = Groups(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                groups.join(i, j)
    least = {}
    for i, r in enumerate(rows):
        root = groups.find(i)
        least[root] = min((x for x in (least.get(root), r[0]) if x is not None), default=None)
    return sorted(least.values(), key=str)


def planted(seed=3):
    """Texts with near copies at many similarities on both sides of 0.8."""
    rnd = random.Random(seed)
    rows = []
    for _ in range(25):
        words = [f"w{rnd.randint(0, 5000)}" for _ in range(rnd.randint(30, 200))]
        footer = [f"f{i}" for i in range(20)]
        rows.append(words + footer)
        for share in (0.005, 0.01, 0.02, 0.03, 0.05):
            copy = list(words)
            for spot in rnd.sample(range(len(copy)), max(1, round(share * len(copy)))):
                copy[spot] = f"x{rnd.randint(0, 5000)}"
            rows.append(copy + footer)
    rnd.shuffle(rows)
    return [(i, " ".join(w), None, None, 0, "x", 1, None) for i, w in enumerate(rows)]


def kept(spark, rows):
    return sorted((r.doc_id for r in simhash.drop_near_duplicates(documents(spark, rows)).collect()), key=str)


@pytest.mark.parametrize("crowd, often", [(64, 8), (1, 5)])
def test_planted_edits_equal_brute_force(spark, monkeypatch, crowd, often):
    monkeypatch.setattr(shinglesets, "CROWD", crowd)
    monkeypatch.setattr(shinglesets, "OFTEN", often)
    rows = planted()
    want = expected(rows)
    # Most of the pairs at the bound are further apart than three bits.
    sets, prints = [shingles(r[1]) for r in rows], [print_of(r[1]) for r in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j])]
    assert sum((prints[i] ^ prints[j]).bit_count() > 3 for i, j in near) > len(near) / 2
    assert len(want) < len(rows) - 40
    assert kept(spark, rows) == want


def print_of(text):
    from test_simhash import fingerprint

    return fingerprint(text, 5)


def test_awkward_rows_equal_brute_force(spark):
    rows = awkward_documents()
    assert kept(spark, rows) == expected(rows)


def test_columns_and_second_pass(spark):
    found = simhash.drop_near_duplicates(documents(spark, planted()))
    assert found.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    rows = [tuple(r) for r in found.collect()]
    assert len(kept(spark, rows)) == len(rows)


def test_prefix_of_a_pair_at_the_bound_meets():
    import numpy as np

    common = np.arange(0, 50, 2, dtype=np.uint64)
    x = np.arange(45, dtype=np.uint64)
    y = np.arange(5, 50, dtype=np.uint64)  # 40 of 50
    assert np.intersect1d(shinglesets.prefix(x, common), shinglesets.prefix(y, common)).size
    assert len(shinglesets.prefix(x, common)) == 10

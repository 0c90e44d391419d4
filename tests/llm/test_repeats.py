import collections
import random
import tracemalloc

import numpy as np
import pytest
from helpers import awkward_documents, by_id, documents, sha

from trialquota.llm import repeats


def expected(rows, length=200):
    """Every window counted, one by one."""
    often = collections.Counter()
    for r in rows:
        data = (r[1] or "").encode()
        often.update(data[i : i + length] for i in range(len(data) - length + 1))
    out = []
    for r in rows:
        data = (r[1] or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if often[data[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((r[0], len(data), sum(gone), runs, sha(bytes(b for b, g in zip(data, gone) if not g))))
    return out


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)

    def made(n, letters="abcdefgh é日"):
        return "".join(rnd.choice(letters) for _ in range(n))

    base, passage, texts = made(3000), made(500), []
    for _ in range(80):
        start, own = rnd.randint(0, 2500), made(rnd.randint(0, 500))
        texts.append(own[:150] + base[start : start + rnd.randint(50, 600)] + own[150:])
    texts += ["ab" * 300, "a" * 201, "a" * 200, "x" * 199, made(1500, "ab"), texts[3], texts[5]]
    texts += [made(60) + passage[rnd.randint(0, 30) : 500 - rnd.randint(0, 30)] + made(60) for _ in range(40)]
    return [*awkward_documents(), *[(1000 + i, t, None, None, 0, None, None, None) for i, t in enumerate(texts)]]


@pytest.mark.parametrize("group", [2000, 3])
def test_removed_bytes_equal_brute_force(spark, rows, group, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP", group)
    assert by_id(repeats.remove_repeats(documents(spark, rows)).collect()) == by_id(expected(rows))


def test_empty_table(spark):
    assert repeats.remove_repeats(documents(spark, [])).count() == 0


def test_maximal_repeats_are_maximal_and_complete():
    rnd = random.Random(1)
    for _ in range(150):
        length = rnd.choice([5, 10, 33, 200])
        base = "".join(rnd.choice("abc") for _ in range(4 * length))
        strings = []
        for _ in range(rnd.randint(1, 8)):
            at = rnd.randint(0, 2 * length)
            noise = ["".join(rnd.choice("abc") for _ in range(rnd.randint(0, length))) for _ in range(2)]
            strings.append((noise[0] + base[at : at + rnd.randint(0, 2 * length)] + noise[1]).encode())
        bounds, data = np.cumsum([0, *map(len, strings)]), np.frombuffer(b"".join(strings), np.uint8)
        text, begins = data.tobytes(), set(bounds[:-1].tolist())
        covered = np.zeros(len(data), bool)
        for size, places in repeats.maximal_repeats(data, bounds, length):
            shared = text[places[0] : places[0] + size]
            assert {text[p : p + size] for p in places} == {shared}
            # All occurrences are reported, and no common byte on the left extends them.
            everywhere = [o + i for s, o in zip(strings, bounds.tolist()) for i in range(len(s) - size + 1) if s[i : i + size] == shared]
            assert sorted(places) == everywhere
            assert len({text[p - 1] for p in places}) > 1 or begins & set(places)
            for p in places:
                covered[p : p + size] = True
        often = collections.Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
        want = np.zeros(len(data), bool)
        for s, o in zip(strings, bounds.tolist()):
            for i in range(len(s) - length + 1):
                if often[s[i : i + length]] > 1:
                    want[o + i : o + i + length] = True
        assert (covered == want).all()


def test_equal_windows_have_equal_anchors():
    rnd = random.Random(2)
    base = "".join(rnd.choice("abcdefgh") for _ in range(1500))
    texts = ["".join(rnd.choice("abcdefgh") for _ in range(300)) + base[a : a + 450] for a in (0, 10, 200, 700)] + ["", "aaaa" * 80]
    offsets, data = np.cumsum([0, *map(len, texts)]), np.frombuffer("".join(texts).encode(), np.uint8)
    found = collections.defaultdict(set)
    total = 0
    for _, start, windows, anchor in zip(*repeats.segments(data, offsets, 200)):
        total += windows
        for i in range(windows):
            found[data[start + i : start + i + 200].tobytes()].add(int(anchor))
    assert all(len(v) == 1 for v in found.values())
    assert total == sum(max(0, len(t) - 199) for t in texts)


def test_suffixes_of_near_copies_are_sorted_in_bounded_memory():
    # 700 strings of 368 bytes that share all but their last byte: nearly every suffix takes part.
    rnd = np.random.default_rng(2)
    base = rnd.integers(97, 123, 367, dtype=np.uint8)
    strings = [np.append(base, np.uint8(97 + i % 26)) for i in range(700)]
    data, bounds = np.concatenate(strings), np.arange(701) * 368
    remaining = np.repeat(bounds[1:], 368) - np.arange(len(data))
    tracemalloc.start()
    order = repeats.suffix_array(data, remaining, 200)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(order) == 700 * 169
    assert peak < 100 << 20
    whole = [bytes(data[at : at + left]) for at, left in zip(order.tolist(), remaining[order].tolist(), strict=True)]
    grouped = [text[:200] for text in whole]
    assert len(set(grouped)) == 1 + sum(a != b for a, b in zip(grouped, grouped[1:], strict=False))
    assert all(a <= b for a, b in zip(whole, whole[1:], strict=False) if a[:200] == b[:200])


def test_crowded_anchors_are_split_in_fewer_rows_than_windows(spark, monkeypatch):
    rnd = random.Random(9)
    made = lambda n: "".join(rnd.choice("abcdefghijklmnop") for _ in range(n))
    passage = made(400)
    texts = [made(rnd.randint(150, 250)) + passage[rnd.choice([0, 0, 3]) : rnd.choice([400, 400, 380])] + made(rnd.randint(150, 250)) for _ in range(150)]
    rows = [(i, t, None, None, 0, None, None, None) for i, t in enumerate(texts)]
    found, staged = [], repeats.stage
    monkeypatch.setattr(repeats, "GROUP", 20)
    monkeypatch.setattr(repeats, "stage", lambda df, label: found.append((label, staged(df, label))) or found[-1][1])
    assert by_id(repeats.remove_repeats(documents(spark, rows)).collect()) == by_id(expected(rows))
    crowded = next(x for label, x in found if label == "contents").df.where("classes > 20")
    windows = sum(len(r.content) - 199 for r in crowded.collect())
    runs = [x.rows for label, x in found if label == "runs"]
    assert len(runs) > 1 and windows > 10_000
    assert sum(runs) < windows / 8

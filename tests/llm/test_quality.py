import collections
import re

from helpers import awkward_documents, by_id, documents, space_words

from trialquota.llm import quality


def counts(text):
    words = space_words(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often, hit = collections.Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            hit.update(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if space_words(x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit),
        len(words) < 10 or 100 * len(hit) > 20 * len(words),
    )


def test_counts_equal_brute_force(spark):
    rows = awkward_documents()
    rows += [(90, "a b c d e " * 9 + "#$ <x>", "en", "s", 1, None, None, None), (91, "x " * 6, "en", "s", 1, None, None, None)]
    found = quality.quality(documents(spark, rows)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"
    )
    assert by_id(found.collect()) == by_id([(r[0], *counts(r[1])) for r in rows])
    assert quality.quality(documents(spark, [])).count() == 0


def floor(value):
    drop = max(value.bit_length() - 7, 0)
    return value >> drop << drop


def test_verdict_equals_brute_force(spark):
    rows = [(i, f"word{i % 13} and some more plain text of line {i} goes here today", "en", f"s{i % 2}", 1, None, None, None) for i in range(60)]
    rows += [(100 + i, "BUY$$$ NOW!!!%% ### " * 5 + f"{i} unique words make this one last a bit", "en", "s0", 1, None, None, None) for i in range(4)]
    found = {r.doc_id: r.kept for r in quality.quality(documents(spark, rows), min_group=20).collect()}
    sample = {r[0]: (r[3], counts(r[1]), r[1]) for r in rows}

    def measures(entry):
        n, chars, symbols, dups, repeats, _ = entry[1]
        lines = len([x for x in entry[2].split("\n") if space_words(x)])
        capitals = sum(c.isupper() for c in entry[2])
        return (chars * 1000 // n, symbols * 1000 // n, dups * 1000 // lines, repeats * 1000 // n, capitals * 1000 // chars)

    def kept(entry):
        if entry[1][5]:
            return False
        peers = [measures(e) for e in sample.values() if e[0] == entry[0] and not e[1][5]]
        for k, m in enumerate(quality.MEASURES):
            bins = sorted(floor(p[k]) for p in peers)
            low = next(b for i, b in enumerate(bins) if 4 * sum(x <= b for x in bins) >= len(bins))
            high = next(b for i, b in enumerate(bins) if 4 * sum(x <= b for x in bins) >= 3 * len(bins))
            reach = quality.REACH * max(high - low, m.spread)
            slack = int(m.noise / entry[1][0] ** 0.5)
            value = measures(entry)[k]
            if value - slack > high + reach or (m.two_sided and value + slack < low - reach):
                return False
        return True

    assert found == {i: kept(e) for i, e in sample.items()}
    assert not any(found[100 + i] for i in range(4)) and all(found[i] for i in range(60))


def test_small_groups_read_larger_sketches(spark):
    plain = "these are ten or more plain words in a text number"
    rows = [(i, f"{plain} {i}", "en", "big", 1, None, None, None) for i in range(30)]
    rows += [(99, "$$$$ #### **** %%%% &&&& |||| <<<< >>>> $$$$ #### ****", "en", "tiny", 1, None, None, None)]
    assert not {r.doc_id: r.kept for r in quality.quality(documents(spark, rows), min_group=20).collect()}[99]


def test_filter_keeps_columns_and_rows(spark):
    docs = documents(spark)
    kept = quality.keep_good(docs, min_group=5)
    wanted = [r.doc_id for r in quality.quality(docs, min_group=5).where("kept").collect()]
    assert kept.columns == docs.columns
    assert by_id((r.doc_id,) for r in kept.collect()) == by_id((i,) for i in wanted)
    assert quality.keep_good(documents(spark, [])).count() == 0

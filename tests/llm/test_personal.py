import random
import re

from helpers import awkward_documents, by_id, documents, sha

from trialquota.llm import personal

PARTS = [
    "a", "@", "b.c", "..", ".", "1", "23", "255", "256", "4111 1111 1111 1111", "4111111111111111", "-", " ", "+1 ", "+4", "(0)", "😀",
    "é", "\n", "x@y.z", "_", "%", "1.2.3.4", "001.02.3.4", "5555555555555", "DE89 3704 0044 0532 0130 00", "iban ", "123-45-6789", "ssn ",
]


def luhn(digits):
    doubled = [int(c) * 2 if i % 2 else int(c) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def base_spans(text):
    text, found = text or "", []
    bare = lambda m: re.sub("[^0-9]", "", m.group())
    for name, pattern, good in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.group().split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(bare(m)) <= 19 and luhn(bare(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(bare(m)) <= 15),
    ):
        found += [(name, *m.span()) for m in re.finditer(pattern, text) if good(m)]
    return found


def expected(row):
    spans = base_spans(row[1])
    counts = [sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")]
    return (row[0], *counts, sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans)))


def test_base_spans_equal_patterns(spark):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 14))) for _ in range(4000)]
    rows = [*awkward_documents(), *[(1000 + i, t, None, None, 0, None, None, None) for i, t in enumerate(texts)]]
    found = personal.personal_data(documents(spark, rows)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    assert by_id(found.collect()) == by_id(map(expected, rows))
    assert personal.personal_data(documents(spark, [])).count() == 0


def test_very_long_runs_end(spark):
    texts = ["a" * 100_000, "1" * 50_000, "1 " * 50_000, "a@" * 20_000, "+1" + " " * 50_000, "x@y.z " * 800]
    rows = [(i, t, None, None, 0, None, None, None) for i, t in enumerate(texts)]
    found = personal.personal_data(documents(spark, rows)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    assert by_id(found.collect()) == by_id(map(expected, rows))


def test_validators_and_context(spark):
    texts = ["iban DE89 3704 0044 0532 0130 00 ok", "DE89 3704 0044 0532 0130 01", "ssn 123-45-6789", "no 123-45-6789", "mail me at a@b.c", "a@b.c"]
    rows = [(i, t, None, None, 0, None, None, None) for i, t in enumerate(texts)]
    found = {r.doc_id: r for r in personal.personal_data(documents(spark, rows)).collect()}
    assert found[0].spans == "iban:5:32" and found[1].spans == ""
    assert found[2].spans == "ssn:4:15" and found[3].spans == ""
    assert found[4].top_score > found[5].top_score

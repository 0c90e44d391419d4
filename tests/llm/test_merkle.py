import hashlib
import zlib

from helpers import awkward_documents, documents

from trialquota.llm import merkle


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(v):
    if v is None:
        return "-"
    v = str(v)
    return f"{len(v.encode())}:{v}"


def leaf(row):
    return H("".join(field(v) for v in row))


def tree(digests, fan):
    """Levels of a tree over ``digests``: list of lists, last has one node."""
    levels = [digests]
    while len(levels[-1]) > 1:
        cur = levels[-1]
        levels.append([H("".join(cur[i : i + fan])) for i in range(0, len(cur), fan)])
    return levels


def proof(levels, i, fan):
    out = []
    for level in levels[:-1]:
        a = i - i % fan
        run = level[a : a + fan]
        out.append(("".join(run[: i - a]), "".join(run[i - a + 1 :])))
        i //= fan
    return out


def brute(rows, fan=16):
    def key(s):
        return (s is not None, (s or "").encode())

    by_source = {}
    for r in rows:
        by_source.setdefault(r[3], []).append(r)
    sources = sorted(by_source, key=key)
    trees, order = {}, {}
    for s in sources:
        items = sorted(((r[0] is not None, r[0] or 0), leaf((r[0], r[3], r[2], r[4], r[1])), r) for r in by_source[s])
        order[s] = items
        trees[s] = tree([x[1] for x in items], fan)
    top = tree([trees[s][-1][0] for s in sources], fan)
    root = top[-1][0]
    out = []
    for si, s in enumerate(sources):
        for i, (_, lf, r) in enumerate(order[s]):
            segs = proof(trees[s], i, fan) + proof(top, si, fan)
            doc_id = r[0]
            changed = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]) if changed and r[1] is not None else r[1]
            cur = leaf((doc_id, s, r[2], r[4], text))
            for left, right in segs:
                cur = H(left + cur + right)
            out.append((doc_id, lf, trees[s][-1][0], root, H("".join(a + b for a, b in segs)), cur, cur == root))
    return sorted(out, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def run(spark, rows, fan=16):
    merkle.FANOUT = fan
    try:
        got = merkle.manifest(documents(spark, rows)).collect()
    finally:
        merkle.FANOUT = 16
    return sorted((tuple(r) for r in got), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def test_awkward_rows_equal_brute_force(spark):
    rows = awkward_documents()
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, fan=2) == brute(rows, fan=2)


def test_many_leaves_and_sources(spark):
    rows = [(i % 97, f"Text {i} Of Doc", "en", f"s{i % 3}" if i % 7 else None, i, None, None, None) for i in range(700)]
    found = run(spark, rows, fan=3)
    assert found == brute(rows, fan=3)
    assert any(not r[6] for r in found) and any(r[6] for r in found)


def test_one_row_and_empty(spark):
    rows = [(5, "Abc", None, None, 3, None, None, None)]
    ((doc_id, lf, sub, root, proof_sha, folded, ok),) = run(spark, rows)
    assert lf == sub == root and proof_sha == H("")
    assert run(spark, []) == []


def test_one_leaf_per_source(spark):
    rows = [(i, f"T{i}", "en", f"s{i}", 1, None, None, None) for i in range(20)] + [(99, None, None, None, None, None, None, None)]
    assert run(spark, rows) == brute(rows)

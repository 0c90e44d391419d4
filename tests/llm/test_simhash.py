import xxhash
from helpers import Groups, SCHEMA, awkward_documents, by_id, documents, fold, space_words

from trialquota.llm import common, simhash


def fingerprint(text, shingle=3):
    words = space_words(fold(text))
    if not words:
        return 0
    parts = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    hashed = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def expected_components(rows):
    prints = {fingerprint(r[1]) for r in rows}
    groups = Groups(prints)
    for a in prints:
        for b in prints:
            if a < b and (a ^ b).bit_count() <= 3:
                groups.join(a, b)
    least = {}
    for r in rows:
        root = groups.find(fingerprint(r[1]))
        least[root] = min((x for x in (least.get(root), r[0]) if x is not None), default=None)
    return [(r[0], f"{fingerprint(r[1]):016x}", least[groups.find(fingerprint(r[1]))]) for r in rows]


def test_components_equal_brute_force(spark):
    rows = awkward_documents()
    found = simhash.simhash_components(documents(spark, rows)).select("doc_id", "fingerprint", "component_id").collect()
    assert by_id(found) == by_id(expected_components(rows))


def test_empty_table(spark):
    assert simhash.simhash_components(documents(spark, [])).count() == 0
    assert simhash.drop_near_duplicates(documents(spark, [])).count() == 0


def test_near_and_far_links(spark):
    base = 0x0123456789ABCDEF
    values = [base, base ^ 1, base ^ 3, base ^ (7 << 40), base ^ (1 << 63) ^ (1 << 31) ^ 2, base ^ 0xFF00, ~base & (1 << 64) - 1]
    values += [v ^ (0b111 << 20) ^ (0b11 << 50) for v in values]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = simhash.fingerprint_components(spark.createDataFrame([(v,) for v in signed], "fingerprint long")).collect()
    groups = Groups(range(len(values)))
    for i, a in enumerate(values):
        for j, b in enumerate(values[:i]):
            if (a ^ b).bit_count() <= 3:
                groups.join(i, j)
    want, got = {}, {}
    for i, v in enumerate(signed):
        want.setdefault(groups.find(i), set()).add(v)
    for r in found:
        got.setdefault(r.root, set()).add(r.fingerprint)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_dense_group_makes_no_pair_list(spark):
    values = [(sum(1 << (b + i) % 16 for b in range(2)) ^ i << 20,) for i in range(16)]
    links = simhash.near_links(spark.createDataFrame(values, "fingerprint long"))
    assert links.count() <= 65 * len(values)


def test_one_document_of_each_group_stays(spark):
    rows = awkward_documents()
    kept = simhash.drop_near_duplicates(documents(spark, rows), shingle=3)
    assert kept.columns == documents(spark, rows).columns
    wanted = {c for _, _, c in expected_components(rows) if c is not None}
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(wanted)
    # A second pass finds nothing more.
    assert simhash.drop_near_duplicates(spark.createDataFrame(kept.collect(), SCHEMA), shingle=3).count() == len(ids)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(7, 7), (201, 200), (201, 200)]
    found = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).df.collect()}
    assert found == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}


def test_staged_table_counts_and_drops(spark):
    staged = common.stage(spark.range(10), "ten")
    assert staged.rows == 10 and staged.bytes() > 0 and staged.for_broadcast().count() == 10
    staged.drop()

import corpus_pipeline
import pytest
import test_decontam
import test_linededup
import test_simhash
import tiktoken
from helpers import SCHEMA, Groups, documents, sha

from trialquota.llm import bytebpe, common, decontam, queries


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.registered()) == list(range(1, 14))


def test_stages_and_columns(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    columns = docs.columns
    for name, apply in corpus_pipeline.STAGES:
        rows = docs.count()
        docs = common.stage(apply(spark, docs, sf_dir), name).df
        assert docs.count() <= rows
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            assert docs.where("text IS NOT NULL AND char_length(text) <> n_chars").count() == 0


def brute_force(rows, items):
    """Rows left by the stages after the quality rules, and what the last one returns for them."""
    texts = test_linededup.expected({r.doc_id: r.text for r in rows})
    prints = {i: test_simhash.fingerprint(t, 3) for i, t in texts.items()}
    groups = Groups(sorted(texts))
    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                groups.join(i, j)
    single = [i for i in ids if groups.find(i) == i]
    judged = test_decontam.expected([(i, texts[i]) for i in single], items)
    clean = [r[0] for r in judged if not r[5]]
    import public_tokenizers

    ranks = bytebpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = [(i, library.encode_ordinary(texts[i] or "")) for i in clean]
    return sorted((i, len(e), sha(" ".join(map(str, e))), sha(texts[i] or "")) for i, e in encoded)


def test_run_equals_brute_force(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    good = corpus_pipeline.quality_rules(spark, docs, sf_dir).collect()
    items = [(r.item_id, r.text, None) for r in common.table(spark, sf_dir, "benchmark").collect()]
    found = sorted(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert found == brute_force(good, items)


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages_take_awkward_rows(spark, sf_dir, stage):
    name, apply = corpus_pipeline.STAGES[stage]
    assert apply(spark, documents(spark, []), sf_dir).count() == 0
    found = apply(spark, documents(spark), sf_dir)
    if stage < len(corpus_pipeline.STAGES) - 1:
        assert found.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert found.count() > 0
    assert decontam.WIDTH == 13

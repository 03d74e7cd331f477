"""The pipeline's stages, each against brute force on its own input."""

import collections
import hashlib

import pytest

import corpus_pipeline
from tests.llm import corpora
from tests.llm.test_operators import brute_targets
from tidemark.llm import mixing, sharding


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    docs = corpora.documents(spark, n=120)
    docs.write.parquet(f"{at}/documents.parquet")
    long = [r[1] for r in corpora.rows(n=120) if r[1] and len(r[1].split()) > 60 and r[0] is not None]
    items = [(0, " ".join(long[0].split()[:30]).upper()), (1, " ".join(long[5].split()[5:45])), (2, "of no text at all but some words of its own here")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), items


@pytest.fixture(scope="module")
def stages(spark, folder):
    """Input and output rows of each stage."""
    at, _ = folder
    docs, out = spark.read.parquet(f"{at}/documents.parquet"), []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, at).write.parquet(f"{at}/stage{number}")
        docs = spark.read.parquet(f"{at}/stage{number}")
        out.append((before, docs.collect(), docs.columns))
    return out


def test_columns_stay(stages):
    columns = list(corpora.SCHEMA.replace(" long", "").replace(" string", "").replace(" double", "").replace(" int", "").split(", "))
    assert all(c == columns for *_, c in stages[:-1])
    assert stages[-1][2] == [*columns, "slot", "_shard"]


def test_language_stage_drops_texts_without_letters_only(stages):
    before, after, _ = stages[0]
    want = collections.Counter((r.doc_id, r.text) for r in before if r.text and any(c.isalpha() for c in r.text))
    assert collections.Counter((r.doc_id, r.text) for r in after) == want
    assert all(r.lang is not None for r in after)


def jaccard(a, b):
    """Of shingles with their counts."""
    x, y = (collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for w in (a.lower().split(), b.lower().split()))
    return (x & y).total() / (x | y).total()


def test_near_duplicate_stage_keeps_one_of_each_class(stages):
    before, after, _ = stages[1]
    kept = [r for r in after if r.doc_id is not None]
    assert len({r.doc_id for r in kept}) == len(kept)
    assert sum(r.doc_id is None for r in after) == sum(r.doc_id is None for r in before)
    for i, a in enumerate(kept):
        for b in kept[:i]:
            assert jaccard(a.text, b.text) < 0.84
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    for d in gone:  # what went is like some other document
        assert any(jaccard(r.text, q.text) >= 0.76 for r in before if r.doc_id == d for q in before if q.doc_id is not None and q.doc_id != d)


def test_decontamination_stage_drops_holders_of_items(stages, folder):
    before, after, _ = stages[2]
    items = [t.lower().split() for _, t in folder[1]]

    def holds(text):
        w = text.lower().split()
        return any(w[k : k + len(i)] == i for i in items for k in range(len(w) - len(i) + 1))

    assert not [r.doc_id for r in after if r.doc_id is not None and holds(r.text)]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert gone and all(any(set(w) & set(r.text.lower().split()) for w in items) for r in before if r.doc_id in gone)


def test_mixing_stage_meets_targets(stages):
    before, after, _ = stages[3]
    names = sorted({r.source for r in before if r.source is not None}) + [None] * any(r.source is None for r in before)
    sizes = [sum(len(r.text.split()) for r in before if r.source == s) for s in names]
    for s, aim in zip(names, brute_targets(sizes, mixing.WEIGHTS, 1.5, 2), strict=True):
        taken = sum(len(r.text.split()) for r in after if r.source == s)
        assert abs(taken - aim) <= 1


def test_sharding_stage_places_by_key(stages):
    before, after, _ = stages[4]
    table = sharding.lookup_table(sharding.shard_names(sharding.SHARDS), sharding.TABLE_SIZE)
    assert len(before) == len(after)
    for r in after:
        key = str(r.doc_id) if r.doc_id is not None else r.text
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % sharding.TABLE_SIZE
        assert (r.slot, r["_shard"]) == (slot, table[slot])


def test_run_is_the_stages(spark, folder, stages):
    got = corpus_pipeline.run(spark, folder[0])
    assert collections.Counter((r.doc_id, r.text, r.slot) for r in got.collect()) == collections.Counter((r.doc_id, r.text, r.slot) for r in stages[-1][1])


def test_stages_on_no_rows(spark, folder):
    empty = corpora.empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder[0]).count() == 0

"""The pipeline, stage by stage, against the brute-force statements of the
operators' own tests."""

import zlib
from collections import Counter

import pytest

import corpus_pipeline as P
from tabsieve.llm import language_id
from test_decontaminate import brute as leaks
from test_decontaminate import items_of
from test_jaccard import brute as groups


@pytest.fixture(scope="module")
def stages(spark, sf, sf_docs):
    docs, out = sf_docs, {}
    for name, stage in P.STAGES:
        given = docs
        docs = P.written(stage(spark, given, sf), name)
        out[name] = (given, docs)
    return out


def test_names_and_columns(stages, sf_docs):
    assert [n for n, _ in P.STAGES] == ["language_id", "near_duplicates", "decontamination", "source_mix", "sharding"]
    for name in list(stages)[:-1]:
        assert stages[name][1].dtypes == sf_docs.dtypes


def test_language_stage(stages, sf_rows):
    given, kept = stages["language_id"]
    model = language_id.fit(language_id.training_rows(given))
    got = {r.doc_id for r in kept.collect()}
    assert got == {r.doc_id for r in language_id.identify(given, model).filter("not rejected").collect()}
    assert len(got) > 0.97 * len(sf_rows)


def test_near_duplicate_stage(stages):
    given, kept = stages["near_duplicates"]
    want = groups([(r.doc_id, r.text) for r in given.collect()])
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _, c in want if d == c)


def test_decontamination_stage(stages, spark, sf):
    given, kept = stages["decontamination"]
    rows = [(r.doc_id, r.text) for r in given.collect()]
    got = {r.doc_id for r in kept.collect()}
    gone = [r for r in rows if r[0] not in got]
    items = items_of(spark, sf)
    assert gone and {d for d, _ in leaks(gone, items)} == {d for d, _ in gone}
    assert not leaks([r for r in rows if r[0] in got][:80], items)
    texts = [" ".join(f"{q} {a}".split()) for _, q, a in items]
    assert not [r for r in rows if r[0] in got and any(t in " ".join(r[1].split()) for t in texts)]


def test_mix_stage(stages):
    given, mixed = stages["source_mix"]
    n, sizes = Counter(r.doc_id for r in mixed.collect()), Counter()
    for r in given.collect():
        sizes[r.source] += len(r.text.split())
        assert n[r.doc_id] <= 3
    assert len(n) < given.count() and max(n.values()) > 1


def test_shard_stage(stages):
    given, placed = stages["sharding"]
    rows = placed.collect()
    shards = {}
    for r in rows:
        assert r.text_crc32 == zlib.crc32(r.text.encode()) and r.size == len(r.text.encode()) + 1
        shards.setdefault(r.shard, []).append(r.slot)
    counts = [len(shards[k]) for k in range(16)]
    assert max(counts) - min(counts) <= 1 and all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in given.collect())


def test_run_and_edges(spark, tmp_path, make_docs):
    words = "of the and that in er is was with on it be "
    rows = [(None, None), (1, None), (2, ""), (3, words * 9), (3, words * 9), (4, words * 9 + "x"), (5, "the " * 4000), (6, "12 34")]
    docs = make_docs([(d, t, "en" if d else None, None if d == 4 else "s") for d, t in rows])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "alpha beta gamma delta"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = P.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {3, 5} and all(0 <= r.shard < 16 for r in got)
    empty = tmp_path / "empty"
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert P.run(spark, str(empty)).collect() == []

"""Inverted lists and sparse retrieval against brute force."""

import math
import random
import re
from collections import Counter, defaultdict
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from paths import SF_MID
from tabsieve.operators import ivf, retrieve, sparse


def test_recall_over_the_whole_table(spark):
    emb = spark.read.parquet(f"{SF_MID}/embeddings.parquet")
    asked = emb.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    exact = {(r.qid, r.vec_id): r.dist for r in retrieve.nearest(emb, asked, 5, "vec_id", "qid").collect()}
    index = ivf.build(emb, "vec_id")
    assert index.rows.count() == emb.count()
    found = {(r.qid, r.vec_id): r.dist for r in ivf.search(index, asked, 5, "qid", "embedding").collect()}
    both = exact.keys() & found.keys()
    assert len(both) >= 0.9 * len(exact)
    assert all(found[p] == pytest.approx(exact[p]) for p in both)


def test_all_probes_give_the_exact_answer(spark, monkeypatch):
    monkeypatch.setattr(ivf, "PART_ROWS", 40)
    monkeypatch.setattr(ivf, "QUERY_ROWS", 7)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(150)] + [(200 + i, [1.0, 2.0, 3.0]) for i in range(150)]
    rows += [(400, [float("nan"), 0.0, 0.0]), (401, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    asked = df.filter("id % 9 = 0").select(F.col("id").alias("qid"), "v")
    want = sorted(tuple(r) for r in retrieve.nearest(df, asked, 4, "id", "qid", vec_col="v").collect())
    index = ivf.build(df, "id", "v", lists=9)
    got = sorted(tuple(r) for r in ivf.search(index, asked, 4, "qid", "v", probes=9).collect())
    assert [g[:3] for g in got] == [w[:3] for w in want]


def slots(text):
    return [int(hashlib.md5(w.encode()).hexdigest()[:4], 16) for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower()) if w]


def test_sparse_top_k_is_exact(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "über"]
    pick = lambda n: " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(62)], k=n))
    docs = [(i, pick(rng.randrange(1, 40))) for i in range(250)] + [(900, None), (901, ""), (902, "...")]
    queries = [(i, pick(rng.randrange(1, 8))) for i in range(30)] + [(50, "unseen words"), (51, None)]
    df = defaultdict(int)
    for _, t in docs:
        for s in set(slots(t)):
            df[s] += 1

    def vector(t):
        v = {s: n * (math.log((1 + len(docs)) / (1 + df.get(s, 0))) + 1) for s, n in Counter(slots(t)).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {s: x / norm for s, x in v.items()}

    want = []
    for q, text in queries:
        qv = vector(text)
        scored = [(-round(sum(x * dv[s] for s, x in qv.items() if s in dv), 9), d) for d, t in docs for dv in [vector(t)] if qv.keys() & dv.keys()]
        want += [(q, r, d, -s) for r, (s, d) in enumerate(sorted(scored)[:5], 1)]
    got = sorted(tuple(r) for r in sparse.retrieve(spark.createDataFrame(docs, "id long, text string"),
                                                   spark.createDataFrame(queries, "qid long, text string"), 5, ["id"], "qid").collect())
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
    assert np.allclose([g[3] for g in got], [w[3] for w in sorted(want)], atol=1e-8)

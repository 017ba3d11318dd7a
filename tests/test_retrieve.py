"""Exact nearest-neighbour retrieval against a NumPy brute force, in one
broadcast batch and split into many hash batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsieve.operators import retrieve as R

K = 5


def _brute(corpus_pdf, query_pdf):
    v = np.stack([np.asarray(x, dtype="float64") for x in corpus_pdf["embedding"]])
    ids = corpus_pdf["vec_id"].to_numpy()
    out = {}
    for qid, qv in zip(query_pdf["qid"], query_pdf["embedding"]):
        d = ((v - np.asarray(qv, dtype="float64")) ** 2).sum(axis=1)
        order = np.lexsort((ids, d))[:K]
        out[int(qid)] = [(int(ids[i]), round(float(d[i]), 6)) for i in order]
    return out


def _spark_hits(hits):
    got = {}
    for r in hits.orderBy("qid", "rank").collect():
        got.setdefault(int(r["qid"]), []).append((int(r["vec_id"]), round(float(r["dist"]), 6)))
    return got


def test_nearest_single_and_batched_match_brute_force(tables_small):
    emb = tables_small.embeddings
    # every vector, shifted, as a query set
    queries = emb.select(F.col("vec_id").alias("qid"),
                         F.transform("embedding", lambda x: x + F.lit(0.01)).alias("embedding"))
    want = _brute(emb.toPandas(), queries.toPandas())
    single = R.nearest(emb, queries, K, "vec_id", "qid")
    batched = R.nearest(emb, queries, K, "vec_id", "qid", max_query_rows=37)
    assert _spark_hits(single) == want
    assert _spark_hits(batched) == want


def test_ties_copies_and_broken_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, 2.0]) for i in range(10_000)] + [(20_000 + i, [float(x) for x in rng.normal(size=2)]) for i in range(50)]
    rows += [(-1, [float("nan"), 0.0]), (-2, None), (-3, [float("inf"), 0.0]), (-4, [None, 1.0])]
    emb = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    queries = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, None)], "qid long, embedding array<double>")
    got = _spark_hits(R.nearest(emb, queries, K, "vec_id", "qid"))
    ok = emb.filter("vec_id >= 0").toPandas()
    assert got == _brute(ok, queries.filter("qid < 3").toPandas())
    assert [i for i, _ in got[1]] == [0, 1, 2, 3, 4]


def test_repeated_query_ids_are_refused(spark):
    from tabsieve.operators.publish import DuplicateKeyError

    emb = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0]), (1, [2.0])], "qid long, embedding array<double>")
    with pytest.raises(DuplicateKeyError):
        R.nearest(emb, queries, K, "vec_id", "qid")


def test_query_batches_cover_each_query_once(tables_small):
    q = tables_small.embeddings.select(F.col("vec_id").alias("qid"), "embedding")
    parts = list(R.query_batches(q, "qid", "embedding", 40))
    ids = [i for names, _ in parts for i in names]
    sizes = [len(m) for _, m in parts]
    assert sorted(ids) == sorted(r["qid"] for r in q.select("qid").collect())
    assert max(sizes) <= 40


def test_partitions_do_not_matter(tables_small):
    emb = tables_small.embeddings
    queries = emb.select(F.col("vec_id").alias("qid"),
                         F.transform("embedding", lambda x: x * F.lit(0.5)).alias("embedding"))
    want = _brute(emb.toPandas(), queries.toPandas())
    assert _spark_hits(R.nearest(emb.repartition(16), queries, K, "vec_id", "qid")) == want


def test_every_row_finds_its_nearest_others(tables_small):
    from tabsieve.plans import retrieval as RV

    pdf = tables_small.embeddings.toPandas()
    v, ids, label = np.stack(pdf["embedding"]).astype("float64"), pdf["vec_id"].to_numpy(), pdf["label"].to_numpy()
    want = {}
    for i in range(len(ids)):
        d = ((v - v[i]) ** 2).sum(axis=1)
        near = [j for j in np.lexsort((ids, d)) if j != i][:K]
        exact = any(d[j] == 0 for j in near)
        votes = {}
        for j in near:
            votes[label[j]] = votes.get(label[j], 0.0) + (float(d[j] == 0) if exact else 1 / d[j])
        best = min(votes, key=lambda k: (-votes[k], k))
        want[int(ids[i])] = (best, pytest.approx(votes[best], abs=2e-6))
    assert {r.qid: (r.predicted, r.votes) for r in RV.knn_distance_all(tables_small).collect()} == want

"""Attention MIL: features and scores against a direct computation, numeric
gradients, held-out accuracy."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tabsieve.llm import quality_mil as Q
from tabsieve.llm import queries

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def passages(text):
    b = (text or "").encode()
    return [[m.span() for m in list(WORD.finditer(b))[i:i + Q.PASSAGE]] for i in range(0, len(WORD.findall(b)), Q.PASSAGE)], b


def test_features():
    texts = ["one one two ONE two\n\nTHREE!! | 12", "", None, "é x", " \n ", "w " * 130 + "end"]
    (_, x, first), = Q.bags(pa.array(texts))
    assert list(np.diff(first)) == [1, 0, 0, 1, 0, 3]
    words = texts[0].split()
    assert x[0][Q.D + Q.KINDS] == pytest.approx(1 / len(words))
    assert x[0][Q.D + Q.KINDS + 1] == pytest.approx(2 / len(words))     # one, two; ONE is another word
    assert x[0][Q.D + Q.KINDS + 2] == pytest.approx(2 / len(words))
    assert x[0][Q.D + Q.KINDS + 3] == pytest.approx(np.mean([len(w) for w in words]) / 16)
    assert np.allclose(np.linalg.norm(x[:, :Q.D], axis=1), 1, atol=1e-5)
    assert np.allclose(x[:, Q.D:Q.D + Q.KINDS].sum(1), 1, atol=1e-5)


def toy(seed=0, bags=6):
    rng = np.random.default_rng(seed)
    x = [rng.normal(size=(rng.integers(1, 5), Q.WIDTH)).astype(np.float32) for _ in range(bags)]
    return x, np.arange(bags) % 2.0, np.concatenate([[0], np.cumsum([len(b) for b in x])])


def loss(model, x, first, y):
    p = model.forward(x, first)["y"]
    return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))


def test_gradients():
    x, y, first = toy()
    every = np.concatenate(x)
    model = Q.Model(np.random.default_rng(1), every.mean(0), every.std(0), 0.5)
    model.p = {k: v.astype(float) for k, v in model.p.items()}
    g = model.gradients(model.forward(every, first), first, y)
    for name, v in model.p.items():
        at = tuple(0 for _ in v.shape)
        keep = v[at].copy()
        v[at] = keep + 1e-5
        up = loss(model, every, first, y)
        v[at] = keep - 1e-5
        down = loss(model, every, first, y)
        v[at] = keep
        assert np.asarray(g[name])[at] == pytest.approx((up - down) / 2e-5, abs=1e-6), name


def test_scores_bag_by_bag():
    x, y, first = toy(2)
    model = Q.train(x, y)
    p = model.p
    for b, got in zip(x, model.scores(np.concatenate(x), first)):
        h = np.tanh((b - model.mean) / model.scale @ p["W"].T + p["b"])
        s = (np.tanh(h @ p["V"].T) / (1 + np.exp(-h @ p["U"].T))) @ p["w"]
        a = np.exp(s) / np.exp(s).sum()
        assert got == pytest.approx(1 / (1 + np.exp(-(a @ h @ p["c"] + p["d"]))), abs=1e-4)
    assert ((model.scores(np.concatenate(x), first) > 0.5) == y).all()


def test_query_held_out(spark, sf, sf_rows):
    got = {r.doc_id: r for r in queries.QUERIES["op2_attention_mil_quality"](spark, sf).collect()}
    assert len(got) == len(sf_rows)
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    for d, text, *_ in sf_rows:
        assert got[d].n_passages == len(passages(text)[0])
    out = [(got[r.doc_id].predicted, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert np.mean([a == b for a, b in out]) >= 0.9


def test_edges(spark, make_docs):
    rows = [(1, None), (2, ""), (3, "good words here"), (3, "good words here"), (None, "x " * 500), (4, "BAD!! BAD!!"), (5, "y" * 9000)]
    labels = spark.createDataFrame([(3, 1), (3, 1), (4, 0), (1, 0), (9, 1), (None, 1), (2, None)], "doc_id long, quality int")
    model = Q.fit(make_docs(rows), labels)
    got = Q.score_quality(make_docs(rows), model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert Q.score_quality(make_docs([]), model).collect() == []
    assert Q.fit(make_docs([]), labels) is None and Q.fit(make_docs(rows), labels.limit(0)) is None
    assert {r.score for r in Q.score_quality(make_docs(rows), None).collect()} == {0.5}

"""Stupid-backoff scores against a direct statement with dictionaries."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from tabsieve.llm import lm_score as L

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, order=2, a=0.4):
    texts = [WORD.findall((t or "").translate(LOW)) for _, t in rows]
    own = [Counter(tuple(w[i:i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)) for w in texts]
    every = Counter()
    for c in own:
        every.update(c)
    total = sum(map(len, texts))
    out = []
    for (d, _), w, mine in zip(rows, texts, own):
        c = lambda *g: every[g] - mine[g]
        n, s, b = max(1, total - len(w)), 0.0, 0
        for i in range(len(w)):
            for k in range(min(order, i + 1), 0, -1):
                g = tuple(w[i - k + 1:i + 1])
                if c(*g) > 0:
                    s += math.log(c(*g) / (c(*g[:-1]) if k > 1 else n))
                    break
                b += 1
                s += math.log(a)
            else:
                s += -math.log(n)
        out.append((d, len(w), s, s / len(w) if w else None, b))
    return out


def close(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[2], 6))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g[0], g[1], g[4]) == (w[0], w[1], w[4])
        assert g[2] == pytest.approx(w[2], abs=1e-6) and (g[3] is None) == (w[3] is None)
        assert w[3] is None or g[3] == pytest.approx(w[3], abs=1e-9)


def test_whole_table(sf_docs, sf_rows):
    close(L.score_documents(sf_docs).collect(), brute([(r[0], r[1]) for r in sf_rows]))


def test_third_order_many_parts(make_docs, monkeypatch):
    plain = L.make_blocks
    monkeypatch.setattr(L, "make_blocks", lambda d, i, t: plain(d, i, t, block_bytes=60))
    rows = [(i, " ".join("abcd"[(i * j + j * j) % 4] for j in range(i % 7 + 3))) for i in range(40)]
    close(L.score_documents(make_docs(rows), order=3, part_bytes=100).collect(), brute(rows, 3))


def test_registered_query_scores_from_two_words(spark, sf, sf_rows):
    from tabsieve.llm.queries import QUERIES

    rows = [(r[0], r[1]) for r in sf_rows]
    want = brute(rows, 3)
    close(QUERIES["op1_stupid_backoff"](spark, sf).collect(), want)
    assert [w[2] for w in want] != pytest.approx([w[2] for w in brute(rows, 2)])


def test_edges(make_docs):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (4, "one TWO"), (None, "two one"), (5, "alone"), (6, "é " * 3000), (7, "x" * 4000)]
    close(L.score_documents(make_docs(rows)).collect(), brute(rows))
    assert L.score_documents(make_docs([])).collect() == []
    close(L.score_documents(make_docs([(1, "a b a")])).collect(), brute([(1, "a b a")]))


def test_sorted_packing():
    h = np.sort(np.random.default_rng(0).integers(0, 2**63, 999).astype(np.uint64) * np.uint64(2))
    assert (L.unpack_sorted(L.pack_sorted(h)) == h).all()

"""Repeated passages against a direct statement of the rule."""

import random
import re

import numpy as np

from tabsieve.llm import substring_dedup as S
from tabsieve.llm.words import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k=S.WINDOW):
    big = float("inf")
    least, split = {}, []
    for d, text in rows:
        w = WORD.findall(text or "")
        split.append(w)
        for i in range(len(w) - k + 1):
            key = tuple(w[i:i + k])
            least[key] = min(least.get(key, big), big if d is None else d)
    out = []
    for (d, _), w in zip(rows, split):
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if least[tuple(w[i:i + k])] < (big if d is None else d):
                gone[i:i + k] = [True] * k
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=repr)


def found(df, **options):
    return sorted([tuple(r) for r in S.remove_repeats(df, **options).collect()], key=repr)


def test_whole_table(sf_docs, sf_rows):
    want = brute([(r[0], r[1]) for r in sf_rows])
    assert found(sf_docs) == want
    assert sum(x[2] for x in want) > 1000


def test_many_buckets_small_blocks_and_hot_minimisers(sf_docs, sf_rows, monkeypatch):
    monkeypatch.setattr(S, "make_blocks", lambda d, i, t: S_make(d, i, t, block_bytes=50_000))
    assert found(sf_docs, bucket_bytes=100_000, sample=1) == brute([(r[0], r[1]) for r in sf_rows])


S_make = S.make_blocks


def test_every_window_dealt_alone(make_docs, monkeypatch):
    rng = random.Random(5)
    passage = " ".join(rng.choice("abcdef") + str(rng.randrange(9)) for _ in range(30))
    rows = [(i, " ".join(rng.choice("xyz") for _ in range(rng.randrange(9))) + "  " + passage + "\n" + str(i)) for i in range(60)]
    monkeypatch.setattr(S, "hot_minimisers", lambda b, n, s: np.sort(all_minimisers(rows)))
    assert found(make_docs(rows), bucket_bytes=500) == brute(rows)


def all_minimisers(rows):
    got = []
    for _, t in rows:
        data = np.frombuffer(t.encode(), np.uint8)
        s = S.Strings(data, np.array([0, len(data)]), 1, np.zeros(0, np.uint64))
        got.append(s.key)
    return np.unique(np.concatenate(got))


def test_edges(make_docs):
    a = " ".join(f"w{i}" for i in range(13))
    b = " ".join(f"v{i}" for i in range(40))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, a), (5, a + " tail"), (6, "é " + a), (6, "é " + a), (None, a), (None, b),
            (7, "same " * 100), (8, "same " * 40), (9, b.replace(" ", "\n\t")), (10, b[:-1]), (11, "x" * 5000 + " " + b), (0, "short")]
    assert found(make_docs(rows)) == brute(rows)


def test_empty_table(make_docs):
    assert found(make_docs([])) == []


def test_equal_hashes_are_compared_by_bytes(monkeypatch):
    rng = np.random.default_rng(1)
    text = " ".join(rng.choice(["a", "bb", "c"], 300)) + " "
    data = np.frombuffer(text.encode(), np.uint8)
    start, end, _ = words(data, np.array([0, len(data)]))
    at = np.arange(len(start) - S.WINDOW + 1)
    monkeypatch.setattr(S, "window_hashes", lambda h, k: np.zeros(len(h) - k + 1, np.uint64))
    cls = S.window_classes(data, start, end, at)
    w = text.split()
    key = [tuple(w[i:i + S.WINDOW]) for i in at]
    assert len(set(zip(cls, key))) == len(set(cls)) == len(set(key))

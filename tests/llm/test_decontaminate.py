"""Decontamination against a direct scoring of every passage and item."""

import math
import random
import re
from collections import Counter

import pytest

from tabsieve.llm import decontaminate as D

TERM = re.compile(r"[0-9A-Za-z\u0080-\U0010FFFF]+")
LOW = str.maketrans({c: c.lower() for c in map(chr, [*range(65, 91), *range(0xC0, 0xDF)]) if c != "×"})


def split(text):
    return TERM.findall((text or "").translate(LOW))


def items_of(spark, sf):
    return [tuple(r) for r in D.with_parts(spark.read.parquet(f"{sf}/benchmark.parquet")).collect()]


def brute(rows, items, threshold=D.THRESHOLD, overlap=D.OVERLAP):
    items = [i for i in sorted(items, key=lambda i: i[0]) if split(f"{i[1]} {i[2]}")]
    entries = []
    for k, (_, q, a) in enumerate(items):
        w = split(f"{q} {a}")
        n = max(1, -(-len(w) // D.PASSAGE))
        entries += [(k, [x for s, x in enumerate(w) if s * n // len(w) == e]) for e in range(n)]
    df = Counter(t for _, w in entries for t in set(w))
    mean = sum(len(w) for _, w in entries) / max(1, len(entries))
    impact = []
    for _, w in entries:
        s = {t: math.log(1 + (len(entries) - df[t] + 0.5) / (df[t] + 0.5)) * tf * (D.K1 + 1)
             / (tf + D.K1 * (1 - D.B + D.B * len(w) / mean)) for t, tf in Counter(w).items()}
        impact.append({t: v / sum(s.values()) for t, v in s.items()})
    gram = lambda w, n: [tuple(w[i:i + n]) for i in range(len(w) - n + 1)]
    out = {}
    for d, text in rows:
        w = split(text)
        half = D.PASSAGE // 2
        for at in range(-half, len(w), half):
            inside = set(w[max(0, at):at + D.PASSAGE])
            for (k, _), imp in zip(entries, impact):
                score = sum(v for t, v in imp.items() if t in inside)
                if score < threshold - 1e-9:
                    continue
                _, q, a = items[k]
                n = len(split(f"{q} {a}"))
                around = w[max(0, at - n):at + D.PASSAGE + n]
                over = []
                for part in (split(q), split(a)):
                    g = min(D.GRAM, len(part))
                    have = set(gram(around, g)) if g else ()
                    want = set(gram(part, g)) if g else ()
                    over.append(sum(x in have for x in want) / len(want) if want else 1.0)
                if min(over) >= overlap:
                    out[d, items[k][0]] = max(out.get((d, items[k][0]), 0), score)
    return out


def found(df, bench, **options):
    return {(r.doc_id, r.item_id): r.score for r in D.find_leaks(df, bench, **options).collect()}


def test_whole_table(spark, sf, sf_docs, sf_rows):
    items = items_of(spark, sf)
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = found(sf_docs, bench)
    texts = {i: f"{q} {a}" for i, q, a in items}
    planted = {(r[0], i) for r in sf_rows for i, t in texts.items() if " ".join(t.split()) in " ".join(r[1].split())}
    assert planted and planted <= set(got)
    some = [r for r in sf_rows if r[0] in {d for d, _ in got}] + sf_rows[:120]
    want = brute([(r[0], r[1]) for r in some], items)
    assert want == pytest.approx({k: v for k, v in got.items() if k[0] in {r[0] for r in some}})
    kept = D.drop_leaks(sf_docs, bench)
    assert kept.columns == sf_docs.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in sf_rows} - {d for d, _ in got}


def words(rng, n, name="w"):
    return [f"{name}{rng.randrange(10**5)}" for _ in range(n)]


def test_altered_partial_long_and_clean(spark, make_docs):
    rng = random.Random(8)
    items = [(k, " ".join(words(rng, n, "q")), " ".join(words(rng, m, "a"))) for k, (n, m) in enumerate([(20, 3), (30, 10), (5, 1), (300, 40), (1, 1)])]
    bench = spark.createDataFrame([*items, (9, "", ""), (10, None, None), (11, "?!", "-")], "item_id long, question string, answer string")
    pad = lambda n: " ".join(words(rng, n, "z"))
    rows = [(k, f"{pad(90)} {q.upper()}!\n\n{a} {pad(77)}") for k, q, a in items]
    w = f"{items[1][1]} {items[1][2]}".split()
    w[5] = w[22] = "changed"
    rows += [(20, f"{pad(31)} {' '.join(w)} {pad(5)}"),                                  # a near copy
             (21, f"{pad(40)} {items[0][1]} {pad(200)}"),                                # question without its answer
             (22, f"{items[0][2]} {pad(40)}"), (23, None), (24, ""), (25, pad(4000)), (None, f"{items[0][1]} {items[0][2]}"),
             (26, pad(30_000) + f" {items[1][1]} {items[1][2]} " + pad(30_000)), (27, "x" * 9000)]
    got = found(make_docs(rows), bench)
    assert set(got) == {(k, k) for k in range(5)} | {(20, 1), (None, 0), (26, 1)}
    assert got == pytest.approx(brute(rows, items))
    split_index = found(make_docs(rows), bench, index_bytes=400)
    assert set(split_index) == set(got)
    assert sorted((r.doc_id or -1) for r in D.drop_leaks(make_docs(rows), bench).collect()) == [21, 22, 23, 24, 25, 27]


def test_one_changed_word_at_every_place(spark, make_docs):
    rng = random.Random(5)
    whole = {k: words(rng, n, "i") for k, n in enumerate([8, 12, 15, 24, 59])}
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in whole.items()], "item_id long, text string")
    rows = [(100 * k + at, " ".join([*words(rng, 40, "z"), *w[:at], "changed", *w[at + 1:], *words(rng, 40, "z")]))
            for k, w in whole.items() for at in range(len(w))]
    rows += [(1000 + k, " ".join(w[:-(len(w) // 4)] + words(rng, 80, "z"))) for k, w in whole.items()]   # without the last quarter
    assert set(found(make_docs(rows), bench)) == {(d, d // 100 if d < 1000 else d - 1000) for d, _ in rows}
    pairs = {k: (words(rng, 30, "q"), words(rng, n, "a")) for k, n in enumerate([3, 4, 6, 9, 10])}
    bench = spark.createDataFrame([(k, " ".join(q), " ".join(a)) for k, (q, a) in pairs.items()], "item_id long, question string, answer string")
    rows = [(100 * k + at, " ".join([*words(rng, 40, "z"), *(q + a)[:at], "changed", *(q + a)[at + 1:], *words(rng, 40, "z")]))
            for k, (q, a) in pairs.items() for at in range(len(q + a))]
    rows += [(1000 + k, " ".join(q + words(rng, 40, "z") + a[:1])) for k, (q, a) in pairs.items()]       # one word of the answer
    assert set(found(make_docs(rows), bench)) == {(d, d // 100) for d, _ in rows if d < 1000}


def test_items_with_one_part(spark, make_docs):
    rng = random.Random(6)
    q, a = " ".join(words(rng, 20, "q")), " ".join(words(rng, 12, "a"))
    bench = spark.createDataFrame([(1, q, None), (2, None, a), (3, None, None)], "item_id long, question string, answer string")
    rows = [(k, " ".join([*words(rng, 50, "z"), t, *words(rng, 50, "z")])) for k, t in enumerate([q, a, "clean"], 1)]
    assert set(found(make_docs(rows), bench)) == {(1, 1), (2, 2)}
    assert [r.doc_id for r in D.drop_leaks(make_docs(rows), bench).collect()] == [3]


def test_long_texts_in_pieces(spark, make_docs, monkeypatch):
    rng = random.Random(2)
    bench = spark.createDataFrame([(1, " ".join(words(rng, 30)))], "item_id long, text string")
    item = bench.first().text
    rows = [(k, " ".join(words(rng, k * 37, "y")) + f" {item} " + " ".join(words(rng, 2000, "x"))) for k in range(25)]
    monkeypatch.setattr(D, "PIECE_BYTES", 4000)
    out = {tuple(x[:2]) for x in D._batch_matches(D.Index([(1, item, "")]), D.pa.array([t for _, t in rows]), 0.5, 0.6)}
    assert out == {(k, 0) for k in range(25)}


def test_empty_tables(spark, make_docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert found(make_docs([(1, "some words here")]), bench) == {}
    assert D.drop_leaks(make_docs([(1, "some words here")]), bench).count() == 1
    assert found(make_docs([]), spark.createDataFrame([(1, "one two three")], "item_id long, text string")) == {}

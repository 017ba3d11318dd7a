"""Near-duplicate components against all pairs of shingle sets."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsieve.llm import blocks
from tabsieve.llm import jaccard_join as J
from tabsieve.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= 80 * (len(a) + len(b) - both):
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [x for x in least[find(i)] if x is not None]
        out.append((d, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=repr)


def found(df, **options):
    rows = J.near_duplicates(df, **options).collect()
    stay = [r.component_id for r in rows if r.kept and r.n_shingles]
    assert len([c for c in stay if c is not None]) >= len({r.component_id for r in rows if r.n_shingles} - {None})
    assert all(r.component_id == r.doc_id for r in rows if r.kept)
    return sorted([tuple(r)[:3] for r in rows], key=repr)


def test_whole_table(sf_docs, sf_rows):
    want = brute([(r[0], r[1]) for r in sf_rows])
    assert found(sf_docs) == want
    assert len({c for _, _, c in want}) < len(want)


def near_copies(seed, n, words, change):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(change + 1)):
            w[rng.randrange(words)] = f"z{rng.randrange(10**6)}"
        yield " ".join(w[rng.randrange(4):])


def test_chains_and_many_near_copies(make_docs):
    texts = [*near_copies(1, 60, 60, 3), *near_copies(2, 40, 25, 1), *near_copies(3, 30, 200, 9), *near_copies(4, 30, 9, 1)]
    rng = random.Random(9)
    rng.shuffle(texts)
    rows = list(enumerate(texts + texts[:20]))
    assert found(make_docs(rows), block_sets=7, part_bytes=300) == brute(rows)


def test_a_block_gives_fewer_links_than_members():
    """Near copies mostly just below 0.8: pairs grow with the square, what
    leaves a block does not, and its components are those of all pairs."""
    texts = list(near_copies(5, 400, 120, 9))
    sets = [np.unique(np.array([hash(g) & (2**64 - 1) for g in shingles(t)], np.uint64)) for t in texts]
    n = np.array([len(s) for s in sets])
    node, tile = np.arange(len(sets)), int(J.band_of(n).max())
    assert J.band_of(n).min() >= tile - 1
    fits = lambda i, j: 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (n[i] + n[j])
    pairs = [(i, j) for i in node for j in range(i) if max(J.band_of(n[[i, j]])) == tile and fits(i, j)]

    def parts(links):
        root = node.copy()
        for a, b in links:
            root[root == root[b]] = root[a]
        return {frozenset(np.flatnonzero(root == r)) for r in set(root)}

    block = J._Block(node, n, np.full(len(n), 3), tile, np.stack([J.bitmap(s, tile) for s in sets]))
    one_tile = [frozenset({5})] * len(n)
    assert set(np.flatnonzero(block.passing_members(node, 5, one_tile))) >= {i for p in pairs for i in p}
    assert not block.passing_members(node, 5, [frozenset({3, 5})] * len(n)).any()       # compared under anchor 3
    links = block.joining_links(node.copy(), sets)
    assert len(links) < len(n) and len(pairs) > 4 * len(n) and parts(links) == parts(pairs)


def test_near_copies_leave_few_rows(make_docs):
    texts = list(near_copies(6, 400, 120, 9))
    df = make_docs(list(enumerate(texts)))
    rows = J.document_sets(df, "doc_id", "text", None)
    sets = rows.select(F.col("row").alias("node"), "n", "shingles").filter("shingles is not null")
    tiles = J.make_tiles(sets)
    roots = components(J.linked(J.hub_pairs(tiles), sets))
    members = tiles.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).groupBy("anchor", "band").agg(
        F.count("node").alias("k"), F.countDistinct("root").alias("roots")).filter("roots > 1").agg(F.sum("k")).first()[0] or 0
    assert J.open_links(tiles, roots, sets, J.BLOCK_SETS).count() <= 2 * members
    assert found(df) == brute(list(enumerate(texts)))


def test_shared_passage_in_unlike_texts(make_docs):
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 40)))) for i in range(80)]
    assert found(make_docs(rows), block_sets=9) == brute(rows)


def test_edges(make_docs):
    a = " ".join(f"w{i}" for i in range(50))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two three four"), (7, "one two  three\tfour"),
            (8, a), (8, a + " more"), (None, a.upper()), (9, "x " * 100), (10, "x " * 5000), (None, "only null"), (None, "only null"),
            (11, "É a b c d e"), (12, "é a b c d e"), (13, "y" * 3000)]
    assert found(make_docs(rows)) == brute(rows)
    assert found(make_docs([])) == []


def test_one_of_each_group_stays(make_docs):
    a, b = (" ".join(f"{k}{i}" for i in range(60)) for k in "ab")
    rows = [(5, a), (3, a + " x"), (9, a + " y"), (4, b), (4, b), (None, b), (6, None), (7, ""), (None, "no id"), (4, "other text")]
    df = make_docs(rows)
    kept = J.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(
        [(3, a + " x"), (4, b), (6, None), (7, ""), (None, "no id"), (4, "other text")], key=repr)


def test_rows_without_words_stay_each(make_docs):
    rows = [(None, None), (None, None), (None, ""), (None, ""), (3, " "), (3, " "), (4, "one two"), (4, "one two")]
    kept = [(r.doc_id, r.text) for r in J.keep_one(make_docs(rows)).collect()]
    assert sorted(kept, key=repr) == sorted(rows[:-1], key=repr)


def test_null_text_and_ids_of_one_row(make_docs):
    assert found(make_docs([(None, None)])) == [(None, 0, None)]


@pytest.mark.parametrize("n", [1, 4, 5, 39, 40, 10**6])
def test_sets_two_bands_apart_cannot_link(n):
    b = int(J.band_of(n))
    assert 4 * int(J.BANDS[b + 2]) > 5 * n


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {x: x for l in links for x in l if l[0] != l[1]}
    for _ in range(500):
        for x, y in links:
            if x != y:
                root[x] = root[y] = min(root[x], root[y])
    assert got == root


def test_bitmaps_never_bound_below_the_overlap():
    rng = np.random.default_rng(2)
    x = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
    y = np.unique(np.concatenate([x[:250], rng.integers(0, 2**63, 30).astype(np.uint64)]))
    b = int(J.band_of(len(x)))
    p, q = J.bitmap(x, b), J.bitmap(y, b)
    most = min(len(x) - np.bitwise_count(p & ~q).sum(), len(y) - np.bitwise_count(q & ~p).sum())
    assert len(np.intersect1d(x, y)) <= most


def test_blocks_and_parts_grow_together(monkeypatch):
    def unit(size):
        monkeypatch.setattr(blocks, "estimated_bytes", lambda df: size)
        return blocks.unit_bytes(None)

    assert unit(0) == unit(1 << 30) == unit(32 << 30) == 4 << 20
    for size in (64 << 30, 1 << 40, 8 << 40):
        a = unit(size)
        # pieces that a block has for a part: its bytes by the number of parts
        assert a * a / size >= 0.99 * (4 << 20) ** 2 / (32 << 30) and a <= 64 << 20
    assert unit(100 << 40) == 64 << 20

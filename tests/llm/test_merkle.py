"""The Merkle manifest against a direct statement of its rules."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tabsieve.llm import merkle

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    doc_id, text, lang, source, n_chars = row
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def grow(nodes):
    """All levels of a tree."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i:i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def path(tree, pos):
    out = []
    for level in tree[:-1]:
        run = level[pos // 16 * 16:pos // 16 * 16 + 16]
        out.append(("".join(run[:pos % 16]), "".join(run[pos % 16 + 1:])))
        pos //= 16
    return out


def direct(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: grow([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names}
    upper = grow([trees[s][-1][0] for s in names])
    out = []
    for i, s in enumerate(names):
        for pos, (_, _, digest, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            steps = path(trees[s], pos) + path(upper, i)
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            root = leaf((r[0], r[1].translate(FOLD) if r[1] is not None else None, *r[2:])) if changed else digest
            for left, right in steps:
                root = h(left + root + right)
            out.append((r[0], digest, trees[s][-1][0], upper[-1][0], h("".join(a + b for a, b in steps)), root, root == upper[-1][0]))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frame(make_docs, rows):
    n_chars = F.when(F.col("text").isNotNull(), F.length("text"))
    df = make_docs([r[:4] for r in rows]).withColumn("n_chars", n_chars.cast("long"))
    return df.withColumns({c: F.lit(-1) for c in ("key", "pos", "n", "digest", "run", "part", "tie", "path", "leaf")})


def with_chars(rows):
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


@pytest.mark.parametrize("size", [1, 16, 17, 257])
def test_sizes(make_docs, size):
    rows = with_chars([(i * 7 % size, f"Text {i} É", "en", "one") for i in range(size)])
    assert rows_of(merkle.audit(frame(make_docs, rows))) == direct(rows)


def test_edges(make_docs):
    rng = random.Random(1)
    rows = [(i, rng.choice(["A b", "", None, "é" * 9, "x" * 50_000, "Z"]), rng.choice(["en", None]), rng.choice(["hot", "hot", None, "", "é", "z", "-"]))
            for i in range(150)]
    rows += [(None, "A", "en", "hot"), (None, None, None, None), (None, "A", "en", "hot")]
    rows += [(3, "again", "en", "hot"), (3, "again", "en", "hot"), (3, "Other", "en", "hot")]
    rows += [(200 + i, "lone", "en", f"s{i:03d}") for i in range(40)]         # a tree over more than 16 sources
    rows = with_chars(rows)
    assert rows_of(merkle.audit(frame(make_docs, rows))) == direct(rows)


def test_empty_table_has_no_root(make_docs):
    df = make_docs([])
    assert merkle.audit(df).collect() == [] and merkle.build(df).root is None


def test_manifest_names_changed_sources(make_docs):
    rows = with_chars([(i, f"t {i}", "en", f"s{i % 3}") for i in range(60)])
    before = merkle.build(frame(make_docs, rows))
    after = merkle.build(frame(make_docs, [(r[0], "T", *r[2:]) if r[0] == 7 else r for r in rows]))
    was, now = ({r.source: r.subroot for r in m.subroots.collect()} for m in (before, after))
    assert before.root != after.root and {s for s in was if was[s] != now[s]} == {"s1"}

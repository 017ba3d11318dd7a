"""Exact dedup, mixing, chat rendering and sharding against direct
statements of their rules."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tabsieve.llm import chat, exact_dedup, mixing, queries, sharding

EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, " "), (5, "a  b"), (6, "a\tb"), (6, "a\tb"), (None, "a b"), (None, "z"),
         (7, "a b"), (8, "x" * 20_000), (9, "x" * 20_000), (10, " a b"), (11, "A b"), (12, "é" * 50)]


def copies(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (d, _), n in zip(rows, norm):
        ids = [e for (e, _), m in zip(rows, norm) if m == n]
        keep = min([e for e in ids if e is not None], default=None)
        out.append((d, keep, len(ids), d == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=repr)


def marked(df, **options):
    return sorted([tuple(r)[:5] for r in exact_dedup.mark_copies(df, **options).collect()], key=repr)


def test_copies(make_docs):
    assert marked(make_docs(EDGES)) == copies(EDGES)
    assert marked(make_docs([])) == []
    rows = EDGES + [(5, "other"), (2, "other")]
    kept = exact_dedup.drop_copies(make_docs(rows))
    assert kept.columns == make_docs(rows).columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((r[0] for r in copies(rows) if r[3]), key=repr)


def test_collisions_are_chained_and_buckets_split(make_docs):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(1, 6)))) for i in range(300)]
    few = F.shiftleft(F.length("norm").cast("long"), 59)         # a handful of keys for all texts
    assert marked(make_docs(rows), key=few) == copies(rows)
    _, index = exact_dedup.build_index(make_docs(rows), key=few)
    assert index.agg(F.max("link")).first()[0] > 10
    _, index = exact_dedup.build_index(make_docs(rows), capacity=20)
    held = {r.bucket: (r.n, r.depth) for r in index.groupBy("bucket").agg(
        F.countDistinct("key").alias("n"), F.max("depth").alias("depth")).collect()}
    assert len(held) > 4 and all(n <= 20 for n, _ in held.values()) and len({d for _, d in held.values()}) >= 1


def targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}


def test_mix(make_docs):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(30), "en", rng.choice(["a", "b", "B", "é", "hot", "hot", "hot", None])) for i in range(900)]
    rows += [(950, None, "en", "empty"), (951, "", "en", "empty"), (None, "w w", "en", "tiny"), (5, "w", "en", "tiny")]
    df = make_docs(rows)
    r = mixing.repetitions(df).collect()
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len((t or "").split())
    want = targets(sizes)
    taken = Counter()
    for x in r:
        assert x.mix_target == pytest.approx(want[x.source]) and x.mix_source_size == sizes[x.source]
        assert 0 <= x.mix_copies <= 3
        taken[x.source] += x.mix_size * x.mix_copies
    assert len(r) == len(rows) and sum(want.values()) == pytest.approx(sum(sizes.values()))
    for s in ("a", "b", "B", "é", "hot", None):
        assert abs(taken[s] - want[s]) < 0.25 * want[s] + 60
    out = mixing.mix(df)
    assert out.columns == df.columns
    assert Counter(x.doc_id for x in out.collect()) == Counter({k: v for k, v in _sum(r).items() if v})
    assert mixing.mix(make_docs([])).collect() == []


def _sum(rows):
    out = Counter()
    for x in rows:
        out[x.doc_id] += x.mix_copies
    return out


def test_mix_comes_near_its_targets(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "source")
    r = mixing.repetitions(rows).groupBy("source").agg(F.sum(F.col("mix_size") * F.col("mix_copies")).alias("t"), F.first("mix_target").alias("w")).collect()
    assert all(abs(x.t - x.w) < 0.15 * x.w for x in r)


def placed(df, **options):
    return sharding.place(df, **options).collect()


def check_shards(rows, n):
    shards = defaultdict(list)
    for r in rows:
        shards[r.shard].append(r)
    counts = [len(shards[k]) for k in range(n)]
    assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1
    for k, s in shards.items():
        assert sorted(r.slot for r in s) == list(range(len(s)))
    assert sorted(r.position for r in rows) == list(range(len(rows)))
    return shards


def test_shards_match_the_mixture(make_docs):
    rng = random.Random(3)
    rows = [(i, f"t{i}", "en", rng.choice(["hot"] * 6 + ["b", "c", None])) for i in range(2000)]
    df = make_docs(rows)
    got = placed(df, n_shards=16, cell_rows=50)
    assert set(df.columns) < set(got[0].asDict())
    every = Counter(r[3] for r in rows)
    for s in check_shards(got, 16).values():
        for source, k in Counter(r.source for r in s).items():
            assert abs(k - every[source] / 16) <= 2
    again = {r.doc_id: (r.shard, r.slot) for r in placed(make_docs(rows, 7), n_shards=16, cell_rows=333)}
    assert again == {r.doc_id: (r.shard, r.slot) for r in got}     # whatever the cells and partitions


@pytest.mark.parametrize("cell_rows", [40, 20_000])
def test_order_is_that_of_the_fractional_ranks(make_docs, cell_rows):
    rng = random.Random(5)
    df = make_docs([(i, f"t{i}", "en", rng.choice(["hot"] * 6 + ["b", "c", None])) for i in range(1500)]
                   + [(2000 + i, None, "en", "few") for i in range(3)])
    hashes = df.select("doc_id", "source", F.xxhash64(F.lit(sharding.SEED), F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))),
                       F.xxhash64(F.lit(sharding.SEED), F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))))
    of_source = defaultdict(list)
    for doc_id, source, h, s in hashes.collect():
        of_source[source].append((h % 2 ** 64, doc_id, s))
    order = sorted((Fraction(2 * r + 1, 2 * len(rows)), s, doc_id) for rows in of_source.values() for r, (_, doc_id, s) in enumerate(sorted(rows)))
    total, want, seen = len(order), {}, Counter()
    for position, (_, _, doc_id) in enumerate(order):
        shard = position * 16 // total
        want[doc_id] = (shard, seen[shard], position)
        seen[shard] += 1
    assert {r.doc_id: (r.shard, r.slot, r.position) for r in placed(df, n_shards=16, cell_rows=cell_rows)} == want


def test_shard_edges(make_docs):
    rows = [(None, None, None, None), (1, "", "en", "s"), (1, "", "en", "s"), (2, "x" * 9000, "en", "=")]
    check_shards(placed(make_docs(rows)), 16)
    check_shards(placed(make_docs([(7, "same", "en", "s")] * 50), cell_rows=5), 16)
    assert placed(make_docs([])) == []


def test_shard_query(spark, sf, sf_rows):
    got = queries.QUERIES["op8_stratified_interleave"](spark, sf).collect()
    text = {r[0]: (r[1] or "").encode() for r in sf_rows}
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {d: (len(t) + 1, zlib.crc32(t)) for d, t in text.items()}
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(r.law == "rows" and r.grown_shard is None for r in got)


def render(turns, part=64):
    out, convs = [], defaultdict(Counter)
    for c, t, r, x in turns:
        convs[c][(t, r or "unknown", x or "")] += 1
    for c, seen in convs.items():
        said = sorted(seen, key=lambda u: ((u[0] is not None, u[0] or 0), u[1].encode(), u[2].encode()))
        for who in sorted({u[1] for u in said} - {"system"}):
            for p in range(0, len(said), part):
                text, spans, rows = "", [], 0
                for u in said[p:p + part]:
                    head = "<|assistant|>\n" if u[1] == who else "<|system|>\n" if u[1] == "system" else f"<|user:{u[1]}|>\n"
                    seg = head + u[2] + "<|end|>\n"
                    if u[1] == who:
                        spans.append(f"{len(text) + len(head)}-{len(text) + len(seg) - 1}")
                    text += seg
                    rows += seen[u]
                out.append((c, who, p // part, text, ",".join(spans), len(said[p:p + part]), len(spans), rows))
    return sorted(out, key=repr)


def test_chat(spark):
    rng = random.Random(6)
    turns = [(rng.randrange(9), rng.randrange(30), rng.choice(["user", "assistant", "system", "Zoë"]), f"t{rng.randrange(6)} é") for _ in range(400)]
    turns += [(None, 0, "user", "a"), (None, None, None, None), (50, 0, "system", "alone"), (51, 0, "user", ""), (51, 0, "user", ""), (52, 1, "b", "x" * 9000)]
    turns += [(99, t, "ab"[t % 2], f"turn {t}") for t in range(500)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("index", F.lit(1))
    assert sorted([tuple(r) for r in chat.render(df, turns_per_part=8).collect()], key=repr) == render(turns, 8)
    assert chat.render(df.limit(0)).collect() == []


def test_rows_without_ids_are_drawn_apart(make_docs):
    rows = [(None, "w " * (1 + i % 9) + str(i), "en", "b") for i in range(1500)] + [(i, "w " * 9, "en", "a") for i in range(900)]
    r = mixing.repetitions(make_docs(rows)).filter("source = 'b'").collect()
    taken = sum(x.mix_size * x.mix_copies for x in r)
    assert abs(taken - r[0].mix_target) < 0.1 * r[0].mix_target

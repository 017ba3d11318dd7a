"""Work and memory that grow with the input and no faster."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tabsieve.operators import sparse


def test_sparse_retrieval_joins_no_pairs_with_postings(spark):
    """Candidate pairs are scored where the index is scanned: no join of
    pairs with all postings of their documents (51,282 documents gave 6.1
    million pairs, each with 307 postings)."""
    docs = spark.createDataFrame([(i, 0, f"the of a w{i % 7} x{i % 11}") for i in range(60)], "id long, part int, text string")
    asked = spark.createDataFrame([(i, f"the of w{i}") for i in range(9)], "qid long, text string")
    found = sparse.retrieve(docs, asked, 3, ["id", "part"], "qid")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Explode" not in plan
    best = {q: [(r["id"], r["part"]) for r in sorted(found.filter(f"qid = {q}").collect(), key=lambda r: r["rank"])] for q in (2, 6)}
    # equal scores by the ids
    want = {q: sorted(i for i in range(60) if i % 7 == q) for q in best}
    assert all(len(v) == 3 and {i for i, _ in v} <= set(want[q]) for q, v in best.items())


def test_sparse_batches_of_queries_answer_all(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"the w{i % 5} of x{i % 13}") for i in range(50)], "id long, text string")
    asked = spark.createDataFrame([(i, f"w{i % 5} the x{i}") for i in range(23)], "qid long, text string")
    whole = sorted(map(tuple, sparse.retrieve(docs, asked, 4, ["id"], "qid").collect()))
    monkeypatch.setattr(sparse, "BATCH_QUERIES", 4)
    monkeypatch.setattr(sparse, "BLOCK_ENTRIES", 30)
    assert sorted(map(tuple, sparse.retrieve(docs, asked, 4, ["id"], "qid").collect())) == whole and len(whole) == 4 * 23


def test_products_are_those_of_shared_slots():
    """As many products as postings and terms share a slot."""
    query, slot = np.array([0, 0, 1, 2]), np.array([5, 9, 5, 7])
    terms = sparse.Terms.of(query, slot, np.array([1.0, 2.0, 3.0, 4.0]))
    at, product = terms.products(np.array([0, 0, 1]), np.array([5, 6, 7]), np.array([0.5, 1.0, 0.25]), 3)
    assert sorted(zip(at.tolist(), product.tolist())) == [(0, 0.5), (1, 1.5), (5, 1.0)]


def test_sparse_retrieval_derives_the_texts_once(spark):
    """The texts of sparse_context are chunks: cut once, not once more to be counted."""
    seen = spark.sparkContext.accumulator(0)

    def derived(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    docs = spark.range(40).selectExpr("id", "concat('the w', id % 7) AS text").mapInArrow(derived, "id long, text string")
    asked = spark.createDataFrame([(1, "the w3")], "qid long, text string")
    assert sparse.retrieve(docs, asked, 3, ["id"], "qid").count() == 3 and seen.value == 40


def test_words_of_a_piece_are_looked_up_once(monkeypatch):
    """The texts of sparse_context are a quarter longer as chunks; a word's
    slot is asked for once a piece and not once a word."""
    asked = []

    class Slots(sparse._Slots):
        def __getitem__(self, word):
            asked.append(word)
            return super().__getitem__(word)

    monkeypatch.setattr(sparse, "_Slots", Slots)
    texts = [b"The w1, of--w2! " * 500, None, b"", b" .,", b"w1\x00w1 caf\xc3\xa9 \xff\xff", b"of"]
    rows = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts, pa.binary())], ["id", "__text"])
    got = pa.Table.from_batches(sparse._count(["id"])(iter([rows.slice(0, 3), rows.slice(3)]))).to_pydict()
    assert len(asked) <= 8
    slot = sparse._Slots()
    for text, slots, tf in zip(texts, got["slots"], got["tf"]):
        words = bytes(c if chr(c).isalnum() or c > 0x7F else 0x20 for c in text or b"").split()
        want = {}
        for w in words:
            want[slot[w]] = want.get(slot[w], 0) + 1
        assert dict(zip(slots, tf)) == want and slots == sorted(want)


def test_strip_is_pythons(spark):
    """Only the ends of a text are looked at for whitespace, and give what
    Python's strip gives."""
    from tabsieve.functions.text import py_strip

    white = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
    texts = [None, "", " ", white, "x", "\U0001F600", f"{white}a{white}b\U0001F600{white}", f"a{white}", f"{white}\U0001F600", "\u200b x\n", "a\n\nb", "$1\\ "]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", py_strip("t").alias("t")).collect()
    assert {r["i"]: r["t"] for r in got} == {i: t and t.strip() for i, t in enumerate(texts)}


def held(run, batches) -> int:
    """The most bytes that Python holds while a task's batches go through."""
    tracemalloc.start()
    try:
        for _ in run(iter(batches)):
            pass
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("min_chars", [0, 100])
def test_chunker_holds_a_piece_and_not_a_batch(min_chars):
    from tabsieve.operators.chunk import _chunker

    text = "A sentence of some words. " * 160
    batch = lambda n: pa.RecordBatch.from_pydict({"id": list(range(n)), "text": [text] * n})
    run = _chunker(["id"], "text", 1000, 200, False, min_chars)
    small, large = held(run, [batch(500)]), held(run, [batch(5000)])
    assert large < 1.5 * small and large < 16 << 20


def test_chunker_keeps_null_ids_and_types(spark):
    from tabsieve.operators.chunk import chunk_documents

    rows = [(1, None, "a" * 1500), (None, "s", "short"), (3, "s", None), (4, "s", "")]
    got = chunk_documents(spark.createDataFrame(rows, "id int, source string, text string"), ["id", "source"])
    assert sorted(map(str, got.select("id", "source", "chunk_index", "n_chunks", "start", "end").collect())) == sorted(
        f"Row(id={i}, source={s}, chunk_index={c}, n_chunks={n}, start={a}, end={e})" for i, s, c, n, a, e in [
            (1, None, 0, 2, 0, 1000), (1, None, 1, 2, 800, 1500), (None, "'s'", 0, 1, 0, 5), (4, "'s'", 0, 1, 0, 0)])
    assert dict(got.dtypes)["id"] == "int"


@pytest.mark.parametrize("probes", [1, 40])
def test_lists_hold_a_block_and_not_a_batch(probes):
    from types import SimpleNamespace

    from tabsieve.operators.ivf import _nearest_lists

    rng = np.random.default_rng(1)
    c = rng.normal(size=(400, 16))
    rows = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array(rng.normal(size=(10_000, 16)).tolist())], ["id", "v"])
    run = _nearest_lists(SimpleNamespace(value=c), "v", probes)
    out = list(run(iter([rows])))
    assert sum(b.num_rows for b in out) == 10_000 * probes and max(b.nbytes for b in out) < 16 << 20
    assert held(run, [rows]) < 48 << 20


def test_small_files_share_tasks(spark, tmp_path):
    """One file per row, read in a bounded number of tasks, all of them read."""
    from tabsieve.sources import io

    n = 400
    for i in range(n):
        (tmp_path / f"{i}.txt").write_text(f"text {i}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8m")
    try:
        files = io.binary_files(spark, str(tmp_path), "*.txt")
        texts = io.extract_documents(files, lambda _, b: b.decode())
        assert files.rdd.getNumPartitions() > 100 and texts.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
        assert sorted(r["text"] for r in texts.collect()) == sorted(f"text {i}" for i in range(n))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")

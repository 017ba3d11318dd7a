"""Language-model scores by stupid backoff over the corpus's own n-gram counts.

Every block of documents (``blocks``) explodes its texts into the n-grams of
an order and sends each distinct one once, with its count, to the n-gram's
hash partition. There the counts of all blocks are summed into the count
table and joined back to the n-grams that were sent; each block gets the
corpus counts of its own n-grams of all orders and sums the scores per
document. An n-gram that a third of all documents hold is one entry per block,
not per row. One order is counted at a time and its answers are written, so
that no two orders lie on the disks as sent n-grams.

A document is scored by what the *other* documents hold: its own counts are
taken off every count. For the word w after the context u:

    S(w | u) = c(u w) / c(u)            if c(u w) > 0
               BACKOFF * S(w | u')      otherwise (u' drops u's first word)
    S(w)     = c(w) / N                 N = words of all other documents
               BACKOFF / N              for a word that no other document holds
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import NO_ID, make_blocks, pack, read_block, unit_bytes, unpack
from .common import word_count, written
from .words import LOWER, U, mix64, window_hashes, word_hashes, words

ORDER = 2
QUERY_ORDER = 3    # of the registered query
BACKOFF = 0.4

MESSAGE = "part long, block long, grams binary, counts binary"
ANSWER = "block long, part long, totals binary"
SCORES = "doc_id long, n_words long, log_score double, mean_log_score double, n_backoffs long"


def pack_sorted(h: np.ndarray) -> bytes:
    """Ascending 64-bit values as compressed byte planes of their gaps."""
    return pack(np.ascontiguousarray(np.diff(h, prepend=U(0)).view(np.uint8).reshape(-1, 8).T))


def unpack_sorted(b: bytes) -> np.ndarray:
    planes = unpack(b).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(U).ravel(), dtype=U)


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(first, hashes, inside): for each order n, the hashes of all runs of n
    words, and which of them lie inside one text."""
    data = LOWER[data]
    start, end, first = words(data, offsets)
    h = word_hashes(data, start, end)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    each = [mix64(window_hashes(h, n) + U(n)) for n in range(1, order + 1)]
    return first, each, [doc[:len(g)] == doc[n:] if n else np.ones(len(g), bool) for n, g in enumerate(each)]


def _parts(h: np.ndarray, parts: int) -> np.ndarray:
    """The hash range (of ``parts`` equal ones) of each hash; ascending in it."""
    return (((h >> U(32)) * U(parts)) >> U(32)).astype(np.int64)


def _send(batches: Iterator[pa.RecordBatch], order: int, parts: int) -> Iterator[pa.RecordBatch]:
    names = ["part", "block", "grams", "counts"]
    for batch in batches:
        for row in batch.to_pylist():
            _, data, offsets = read_block(row)
            _, each, inside = grams(data, offsets, order)
            kinds, counts = np.unique(each[-1][inside[-1]], return_counts=True)
            part = _parts(kinds, parts)
            cuts = np.flatnonzero(np.diff(part)) + 1
            out = [(int(part[i]), row["block"], pack_sorted(kinds[i:j]), pack(counts[i:j].astype(np.int32)))
                   for i, j in zip([0, *cuts], [*cuts, len(part)]) if i < j]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
                    zip(*out), [pa.int64(), pa.int64(), pa.binary(), pa.binary()])], names)


def _total(key: tuple, table: pa.Table) -> pa.Table:
    """The count table of a hash partition of an order, joined to what was sent to it."""
    rows = table.to_pylist()
    sent = [unpack_sorted(r["grams"]) for r in rows]
    kinds, at = np.unique(np.concatenate(sent), return_inverse=True)
    totals = np.zeros(len(kinds), np.int64)
    np.add.at(totals, at, np.concatenate([unpack(r["counts"], np.int32) for r in rows]))
    cuts = np.cumsum([0, *[len(s) for s in sent]])
    return pa.table([pa.array([r["block"] for r in rows], pa.int64()), pa.array([r["part"] for r in rows], pa.int64()),
                     pa.array([pack(totals[at[i:j]]) for i, j in zip(cuts, cuts[1:])], pa.binary())], ["block", "part", "totals"])


def _score(block: pa.Table, replies: pa.Table, order: int, backoff: float, total: int) -> pa.Table:
    row = block.to_pylist()[0]
    ids, data, offsets = read_block(row)
    first, each, inside = grams(data, offsets, order)
    n_words, n = np.diff(first), int(first[-1])
    by_part = sorted((r["n"], r["part"], r["totals"]) for r in replies.to_pylist())
    doc = np.repeat(np.arange(len(n_words)), n_words)
    seen = []      # by order, the count in other documents of the run that begins at each word
    for m, (g, i) in enumerate(zip(each, inside), 1):
        kinds, at = np.unique(g[i], return_inverse=True)
        totals = np.concatenate([np.zeros(0, np.int64), *[unpack(t, np.int64) for k, _, t in by_part if k == m]])
        pair, inverse, own = np.unique(doc[:len(g)][i] * len(kinds) + at, return_inverse=True, return_counts=True)
        c = np.zeros(n, np.int64)
        c[np.flatnonzero(i)] = totals[at] - own[inverse]
        seen.append(c)
    rest = np.maximum(1, total - n_words[doc]).astype(float)
    unknown = seen[0][:n] == 0
    score = np.where(unknown, backoff, seen[0]) / rest
    backoffs = unknown.astype(np.int64)
    for m in range(2, order + 1):                     # the run of m words that ends at word k begins at k - m + 1
        end = np.flatnonzero(inside[m - 1]) + m - 1
        hit = seen[m - 1][end - m + 1]
        context = seen[m - 2][end - m + 1]
        score[end] = np.where(hit > 0, hit / np.maximum(1, context), backoff * score[end])
        backoffs[end] = np.where(hit > 0, 0, backoffs[end] + 1)
    logs = np.concatenate([[0.0], np.log(score)])
    where = np.minimum(first, n)
    filled = n_words > 0
    sums, steps = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
    if n:
        sums[filled] = np.add.reduceat(logs[1:], where[:-1][filled])
        steps[filled] = np.add.reduceat(backoffs, where[:-1][filled])
    return pa.table([pa.array(ids, mask=ids == NO_ID), pa.array(n_words.astype(np.int64)), pa.array(sums),
                     pa.array(sums / np.maximum(1, n_words), mask=~filled), pa.array(steps)],
                    ["doc_id", "n_words", "log_score", "mean_log_score", "n_backoffs"])


def _answers(blocks: DataFrame, n: int, parts: int) -> DataFrame:
    """(block, part, totals, n): the counts of each block's runs of ``n`` words, written."""
    sent = blocks.mapInArrow(partial(_send, order=n, parts=parts), MESSAGE)
    out = written(sent.groupBy("part").applyInArrow(_total, ANSWER).withColumn("n", F.lit(n)), "counts")
    del sent
    gc.collect()                                   # Spark drops the shuffle files of plans that nobody holds
    blocks.sparkSession.sparkContext._jvm.System.gc()
    return out


def score_documents(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, id_col: str = "doc_id",
                    text_col: str = "text", part_bytes: int | None = None) -> DataFrame:
    """One row per input row: doc_id, n_words, log_score (sum of the natural
    logs of its words' scores), mean_log_score (per word) and n_backoffs
    (back-off steps taken). Words are lower-cased (A-Z).

    A null or empty text has no words, log_score 0 and a null mean. A copy
    counts as another document, repeated rows too. A null doc_id stays null.
    A corpus of one document scores every word as unknown with N = 1. Extra
    columns are not read; an empty table gives an empty result.
    """
    blocks = make_blocks(docs, id_col, text_col)
    total = docs.agg(F.sum(word_count(F.col(text_col)))).first()[0] or 0
    size = blocks.agg(F.sum("size")).first()[0] or 0
    parts = max(1, -(-size // (part_bytes or unit_bytes(docs))))    # hash partitions of the count tables
    replies = _answers(blocks, 1, parts)
    for n in range(2, order + 1):
        replies = replies.unionByName(_answers(blocks, n, parts))
    score = lambda b, r: _score(b, r, order, backoff, total)
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(score, SCORES)

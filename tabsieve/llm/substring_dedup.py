"""Repeated passages by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words. Its minimiser is the least hash
among its runs of ``MINIMISER`` words; consecutive windows that share it
travel as one packed string (their words, once) to the minimiser's bucket,
so a window is always sent to the same bucket and most words are sent about
three times instead of thirteen. In the bucket all windows are sorted by
hash, equal hashes are compared byte by byte, and each distinct window gets
the least doc_id it starts in.

Blocks of documents (``blocks``) combine equal strings before they are sent
and get back only windows that start in a smaller document elsewhere, so a
passage or copy held by a third of all documents costs one string per block.
Minimisers that would overfill a bucket (a passage that many different
texts continue) are found on a sample of blocks; their windows are dealt
one by one by their own hash instead. The sample decides only the route.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import NO_ID, make_blocks, pack, read_block, unit_bytes, unpack
from .common import checkpointed
from .words import U, mix64, single_spaced, slices, spread, window_hashes, word_hashes, words

WINDOW = 13            # words
MINIMISER = 3          # words
HOT_MOST = 1 << 20      # minimisers whose windows are dealt one by one, fewer than this
SAMPLE = 32            # one block in so many looks for overfull minimisers
COMPARE_BYTES = 4 << 20

MESSAGE = "bucket long, block long, strings binary, windows binary, least binary"
REPLY = "block long, bucket long, window binary, least binary"
CLEANED = "doc_id long, n_words long, n_removed long, kept string"


def sliding_least(g: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    out, have = g, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[:len(g) - width + 1], out[width - have:]) if width > have else out


class Strings:
    """The super-k-mers of a block: ``text`` (single-spaced words), the
    windows' first words ``at`` in order, and for each string its first
    window ``lead``, number of windows ``count``, bucket and ``code`` (equal
    strings have equal codes)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, buckets: int, hot: np.ndarray):
        start, end, self.first = words(data, offsets)
        self.text, self.start, self.end = single_spaced(data, start, end)
        n = np.maximum(np.diff(self.first) - (WINDOW - 1), 0)
        self.at = spread(self.first[:-1], n)
        self.doc = np.repeat(np.arange(len(n)), n)
        if not len(self.at):
            self.lead = self.count = self.bucket = self.code = np.zeros(0, np.int64)
            self.key = np.zeros(0, U)
            return
        h = word_hashes(self.text, self.start, self.end)
        least = sliding_least(window_hashes(h, MINIMISER), WINDOW - MINIMISER + 1)[self.at]
        alone = np.isin(least, hot) if len(hot) else np.zeros(len(least), bool)
        route = least
        if alone.any():
            route = np.where(alone, window_hashes(h, WINDOW)[self.at], least)
        cut = np.ones(len(route), bool)
        cut[1:] = (route[1:] != route[:-1]) | (self.at[1:] != self.at[:-1] + 1) | alone[1:]
        self.lead = np.flatnonzero(cut)
        self.count = np.diff(np.append(self.lead, len(route)))
        self.key = least[self.lead]
        self.bucket = (mix64(route[self.lead]) % U(buckets)).astype(np.int64)
        low = self.start[self.at[self.lead]]
        size = self.end[self.at[self.lead] + self.count + WINDOW - 2] - low
        bytes_ = slices(self.text, low, size)
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [
            None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.py_buffer(bytes_)])
        self.code = column.dictionary_encode().indices.to_numpy().astype(np.int64)

    def distinct(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each code in order of bucket: the number of a string that has
        it, and the least id it occurs in."""
        if not len(self.code):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        least = np.full(self.code.max() + 1, NO_ID)
        np.minimum.at(least, self.code, ids[self.doc[self.lead]])
        _, one = np.unique(self.code, return_index=True)
        one = one[np.argsort(self.bucket[one], kind="stable")]
        return one, least[self.code[one]]


def _messages(s: Strings, ids: np.ndarray, block: int) -> Iterator[tuple]:
    one, least = s.distinct(ids)
    cuts = np.flatnonzero(np.diff(s.bucket[one])) + 1
    for i, j in zip([0, *cuts], [*cuts, len(one)]):
        if i < j:
            w, count = s.at[s.lead[one[i:j]]], s.count[one[i:j]]
            low = s.start[w]
            strings = slices(s.text, low, s.end[w + count + WINDOW - 2] + 1 - low)   # each with the space behind it
            yield int(s.bucket[one[i]]), block, pack(strings, 3), pack(count.astype(np.int32)), pack(least[i:j])


def _send(batches: Iterator[pa.RecordBatch], buckets: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in MESSAGE.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    for batch in batches:
        for row in batch.to_pylist():
            ids, data, offsets = read_block(row)
            out, size = [], 0
            for m in _messages(Strings(data, offsets, buckets, hot), ids, row["block"]):
                out.append(m)
                size += len(m[2])
                if size > COMPARE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def _equal(text: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether text[a:a + size] equals text[b:b + size], for each triple."""
    out = np.ones(len(a), bool)
    step = max(1, COMPARE_BYTES // max(1, int(size.max(initial=1))))
    for i in range(0, len(a), step):
        k = size[i:i + step]
        same = slices(text, a[i:i + step], k) == slices(text, b[i:i + step], k)
        out[i:i + step] = np.logical_and.reduceat(same, np.cumsum(k) - k)
    return out


def window_classes(text: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A class number for each window (by its first word), equal for equal
    word sequences: windows are sorted by hash; those of one hash are
    compared with the first of them, and what differs is sorted again."""
    h = window_hashes(word_hashes(text, start, end), WINDOW)[at]
    low, size = start[at], end[at + WINDOW - 1] - start[at]
    cls = np.full(len(at), -1, np.int64)
    todo, base = np.arange(len(at)), 0
    while len(todo):
        todo = todo[np.argsort(h[todo], kind="stable")]
        new = np.ones(len(todo), bool)
        new[1:] = h[todo[1:]] != h[todo[:-1]]
        group = np.cumsum(new) - 1
        head = todo[np.flatnonzero(new)][group]
        other = np.flatnonzero(~new)
        same = np.ones(len(todo), bool)
        a, b = todo[other], head[other]
        fits = size[a] == size[b]
        fits[fits] = _equal(text, low[a[fits]], low[b[fits]], size[a[fits]])
        same[other] = fits
        cls[todo[same]] = base + group[same]
        base += int(group[-1]) + 1
        todo = todo[~same]
    return cls


def _answer(key: tuple, table: pa.Table) -> pa.Table:
    """In a bucket: the least id of every window, sent back where a block
    does not know it: (number of the window in the message, id)."""
    rows = table.to_pylist()
    parts = [unpack(r["strings"]) for r in rows]
    counts = [unpack(r["windows"], np.int32).astype(np.int64) for r in rows]
    text, count = np.concatenate(parts), np.concatenate(counts)
    known = np.repeat(np.concatenate([unpack(r["least"], np.int64) for r in rows]), count)
    end = np.flatnonzero(text == 0x20)
    start = np.concatenate([[0], end[:-1] + 1])
    n = count + WINDOW - 1
    at = spread(np.cumsum(n) - n, count)
    cls = window_classes(text, start, end, at)
    least = np.full(cls.max() + 1, NO_ID)
    np.minimum.at(least, cls, known)
    least = least[cls]
    tell = np.flatnonzero(least < known)
    edges = np.concatenate([[0], np.cumsum([c.sum() for c in counts])])
    cut = np.searchsorted(tell, edges)
    out = [(r["block"], r["bucket"], pack((tell[i:j] - e).astype(np.int32)), pack(least[tell[i:j]]))
           for r, e, i, j in zip(rows, edges, cut, cut[1:]) if i < j]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    columns = zip(*out) if out else [[]] * 4
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["block", "bucket", "window", "least"])


def _clean(block: pa.Table, replies: pa.Table, buckets: int, hot: np.ndarray) -> pa.Table:
    """A block's documents without the words of repeated windows."""
    row = block.to_pylist()[0]
    ids, data, offsets = read_block(row)
    s = Strings(data, offsets, buckets, hot)
    gone = np.zeros(len(s.start) + 1, np.int64)
    if len(s.code):
        one, least = s.distinct(ids)
        bucket, count = s.bucket[one], s.count[one]
        begin = np.cumsum(count) - count                   # of each distinct string, its windows in order of bucket
        window_least = np.repeat(least, count)
        for r in replies.to_pylist():
            base = begin[np.searchsorted(bucket, r["bucket"])]
            window_least[base + unpack(r["window"], np.int32)] = unpack(r["least"], np.int64)
        of = np.zeros(s.code.max() + 1, np.int64)
        of[s.code[one]] = begin
        known = window_least[spread(of[s.code], s.count)]  # of every window of the block
        repeat = s.at[known < ids[s.doc]]
        np.add.at(gone, repeat, 1)
        np.add.at(gone, repeat + WINDOW, -1)
    removed = np.cumsum(gone)[:-1] > 0
    size = s.end + 1 - s.start
    kept_bytes = s.text[np.repeat(~removed, size)]
    kept_at = np.concatenate([[0], np.cumsum(size * ~removed)])[s.first]
    n_removed = np.diff(np.concatenate([[0], np.cumsum(removed)])[s.first])
    raw = kept_bytes.tobytes()
    kept = [raw[i:max(i, j - 1)] for i, j in zip(kept_at, kept_at[1:])]
    return pa.table([pa.array(ids, mask=ids == NO_ID), pa.array(np.diff(s.first)), pa.array(n_removed),
                     pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def hot_minimisers(blocks: DataFrame, buckets: int, sample: int) -> np.ndarray:
    """Minimisers that hold more than a quarter of a mean bucket's windows in
    the sampled blocks, or more than one part in ``HOT_MOST`` of all: fewer
    than 4 x ``buckets`` hashes and than ``HOT_MOST`` (8 MB)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, data, offsets = read_block(row)
                s = Strings(data, offsets, buckets, np.zeros(0, U))
                one, _ = s.distinct(ids)
                key, to = np.unique(s.key[one], return_inverse=True)
                n = np.bincount(to, s.count[one], len(key)).astype(np.int64) if len(key) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

    some = blocks.filter(F.pmod(F.xxhash64("block"), F.lit(sample)) == 0)
    found = checkpointed(some.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    total = found.agg(F.sum("n")).first()[0] or 0
    hot = found.filter(F.col("n") * min(4 * buckets, HOT_MOST) > total).filter(F.col("n") > WINDOW).select("key").collect()
    return np.sort(np.array([r[0] for r in hot], np.int64).view(U))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int | None = None,
                   sample: int = SAMPLE) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, and ``kept``, the
    words that stay joined by one space. A word goes if a window of
    consecutive words over it also starts in a document with a smaller id.

    Null and empty texts have no words; texts of fewer than 13 words have no
    window and stay. Rows with the same id do not remove each other's words;
    a null id counts as greater than any other. Extra columns are not read;
    an empty table gives an empty result.
    """
    blocks = make_blocks(docs, id_col, text_col)
    total = blocks.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, -(-total // (bucket_bytes or unit_bytes(docs))))
    hot = docs.sparkSession.sparkContext.broadcast(hot_minimisers(blocks, buckets, sample))
    sent = blocks.mapInArrow(lambda batches: _send(batches, buckets, hot.value), MESSAGE)
    replies = sent.groupBy("bucket").applyInArrow(_answer, REPLY)
    clean = lambda b, r: _clean(b, r, buckets, hot.value)
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(clean, CLEANED)

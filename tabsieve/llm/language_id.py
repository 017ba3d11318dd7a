"""Language identification by nearest centroids.

A text is a TF-IDF vector of its hashed character trigrams (square-root
frequencies, unit length). Every language has several centroids, found by
spherical k-means over its training texts; a text gets the language of the
centroid with the greatest cosine, and is rejected if it lies farther from
it than texts of that length do.

Document frequencies are counted over all training texts. The centroids and
the distance limits are fitted on at most ``SAMPLE`` training texts of each
language (chosen by a hash of the id), as one grouped task per language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_id_text, held_out, trimmed
from .words import runs, text_bytes

BITS = 13              # trigrams are hashed to 2 ** BITS counters
CENTROIDS = 4          # per language
SAMPLE = 1000          # training texts per language for centroids and limits, at most
LANGUAGES = 256        # learned: those with the most training texts (about 33 MB of centroids)
UNKNOWN = "und"
SLACK = 0.5            # a text is rejected below this share of the low similarities at its length
LOW = 0.02             # quantile of the similarities that counts as low
BLOCK_TEXTS, BLOCK_BYTES = 64, 1 << 18   # counting takes about 70 times a run's bytes
FITTED = pa.schema([("lang", pa.string()), ("centroids", pa.binary()), ("limits", pa.binary())])

D = 1 << BITS
# ASCII letters lower-cased, bytes beyond ASCII kept, the rest is space
_LETTER = np.full(256, 0x20, np.uint8)
_LETTER[0x80:] = np.arange(0x80, 0x100)
_LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTER[0x41:0x5B] = np.arange(0x61, 0x7B)


def trigrams(data: np.ndarray, offsets: np.ndarray, before: int = 0, after: int = 0) -> np.ndarray:
    """Counts of hashed trigrams, a row per text. A trigram has a letter in
    the middle; the ends of a text count as spaces. Of a piece of one text,
    the first ``before`` and the last ``after`` bytes are only neighbours."""
    n = len(offsets) - 1
    text = _LETTER[data]
    if len(text):
        capital = (text[:-1] == 0xC3) & (text[1:] >= 0x80) & (text[1:] <= 0x9E) & (text[1:] != 0x97)
        text[1:][capital] += 0x20
    of = np.repeat(np.arange(n), np.diff(offsets))
    line = np.full(len(text) + n + 1, 0x20, np.uint8)          # one space before, between and after the texts
    line[np.arange(len(text)) + of + 1] = text
    mid = np.flatnonzero(line[1 + before:len(line) - 1 - after] != 0x20) + 1 + before
    code = line.astype(np.uint32)
    code = (code[mid - 1] << 16) | (code[mid] << 8) | code[mid + 1]
    slot = ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)
    owner = np.zeros(len(line), np.int64)
    owner[np.arange(len(text)) + of + 1] = of
    row = owner[mid]
    return np.bincount(row * D + slot, minlength=n * D).reshape(n, D)


def _piece(text: np.ndarray, at: int) -> np.ndarray:
    """The counts of the trigrams whose middles are the ``BLOCK_BYTES`` bytes
    of a text from ``at``."""
    lo, hi = max(0, at - 2), min(len(text), at + BLOCK_BYTES + 1)      # a capital's lower case needs the byte before
    return trigrams(text[lo:hi], np.array([0, hi - lo]), at - lo, hi - min(len(text), at + BLOCK_BYTES))


def counted(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the first text, trigram counts) for runs of texts; a text
    longer than a run is counted in pieces."""
    data, offsets = text_bytes(column)
    for i, j in runs(offsets, BLOCK_BYTES):
        for k in range(i, j, BLOCK_TEXTS):
            m = min(j, k + BLOCK_TEXTS)
            lo, hi = int(offsets[k]), int(offsets[m])
            if m - k == 1 and hi - lo > BLOCK_BYTES:
                yield k, sum(_piece(data[lo:hi], at) for at in range(0, hi - lo, BLOCK_BYTES))
            else:
                yield k, trigrams(data[lo:hi], offsets[k:m + 1] - lo)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts, dtype=np.float32) * idf
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of the texts (one column) each counter is not zero, and
    the number of texts. Tasks send one row per counter."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(D, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, counts in counted(batch.column(0)):
                df += (counts > 0).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(D), -1)), pa.array(np.append(df, n))], ["slot", "n"])

    out, n = np.zeros(D, np.int64), 0
    for slot, k in texts.mapInArrow(partial(trimmed, count), "slot long, n long").groupBy("slot").agg(F.sum("n")).collect():
        if slot < 0:
            n = k
        else:
            out[slot] = k
    return out, n


def length_bin(counts: np.ndarray) -> np.ndarray:
    """Number of trigrams, as a power of two."""
    return np.minimum(31, np.log2(1 + counts.sum(1)).astype(np.int64))


def sum_of(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """x[rows].sum(0), row by row and so without a copy of the rows."""
    out = x[rows[0]].copy()
    for i in rows[1:]:
        out += x[i]
    return out


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of unit vectors; the first is the mean, each next one
    starts at the vector farthest from those before."""
    start = [x.mean(0)]
    for _ in range(min(k, len(x)) - 1):
        near = np.max([x @ (c / max(1e-12, np.linalg.norm(c))) for c in start], axis=0)
        start.append(x[int(np.argmin(near))])
    c = np.array(start)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        at = (x @ c.T).argmax(1)
        c = np.array([sum_of(x, np.flatnonzero(at == i)) if (at == i).any() else c[i] for i in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def learned_vectors(texts: pa.ChunkedArray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vector and length bin of every text that has a trigram. Only the
    vectors are held for all texts; counts are those of one run."""
    x, bins, n = np.empty((len(texts), D), np.float32), np.empty(len(texts), np.int64), 0
    for _, counts in counted(texts):
        counts = counts[counts.any(1)]
        m = n + len(counts)
        x[n:m], bins[n:m], n = vectors(counts, idf), length_bin(counts), m
    return x[:n], bins[:n]


def _fit(group: pa.Table, idf: np.ndarray, k: int) -> pa.Table:
    """Centroids of a language and its least usual similarity by length: the
    low quantile at each length, of at least 20 texts of this or neighbouring
    lengths, and no greater than for a longer text."""
    x, bins = learned_vectors(group.sort_by("h")["text"], idf)
    if not len(x):                                      # no text of the language has a letter
        return FITTED.empty_table()
    c = k_means(x, k)
    near = (x @ c.T).max(1)
    limits = np.zeros(32)
    for b in range(32):
        width = next((w for w in range(32) if (abs(bins - b) <= w).sum() >= min(20, len(x))), 32)
        limits[b] = np.quantile(near[abs(bins - b) <= width], LOW)
    limits = np.minimum.accumulate(limits[::-1])[::-1] * SLACK
    return pa.table([[group["lang"][0].as_py()], [c.astype(np.float32).tobytes()], [limits.tobytes()]], FITTED)


class Model:
    """``names``: the languages; ``centroids`` with ``of`` (the language of
    each), ``limits`` by language and length, ``idf``."""

    def __init__(self, rows: list[tuple], idf: np.ndarray):
        rows = sorted(rows)
        self.names = [r[0] for r in rows]
        each = [np.frombuffer(r[1], np.float32).reshape(-1, D) for r in rows]
        self.centroids = np.concatenate(each) if each else np.zeros((0, D), np.float32)
        self.of = np.repeat(np.arange(len(rows)), [len(c) for c in each])
        self.limits = np.array([np.frombuffer(r[2]) for r in rows]).reshape(-1, 32)
        self.idf = idf

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, cosine, rejected) of each text."""
        n = len(column)
        lettered = np.asarray(pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False), bool)
        lang, score, rejected = [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
        if not len(self.names):
            return lang, score, rejected
        for i, counts in counted(column):
            cos = vectors(counts, self.idf) @ self.centroids.T
            best = cos.argmax(1)
            to, s = self.of[best], np.clip(cos[np.arange(len(cos)), best], 0, 1)
            far = s < self.limits[to, length_bin(counts)]
            for k in np.flatnonzero(lettered[i:i + len(to)]):
                lang[i + k], score[i + k], rejected[i + k] = self.names[to[k]], s[k], far[k]
        return lang, score, rejected


def fit(labelled: DataFrame, centroids: int = CENTROIDS, sample: int = SAMPLE) -> Model:
    """A model from (doc_id, text, lang); rows without language or text are
    left out. Of each language the ``sample`` texts with the least hashes of
    id and text are learned from; a draw by that hash, for about four texts
    of each wanted, comes before their ranking."""
    rows = labelled.select("doc_id", "text", "lang").filter("lang is not null and text is not null")
    df, n = document_frequencies(rows.select("text"))
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    named = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), "lang").limit(LANGUAGES)
    share = F.broadcast(named.select("lang", F.least(F.lit(1.0), 4.0 * sample / F.col("k")).alias("share")))      # at most LANGUAGES rows
    drawn = rows.withColumn("h", F.xxhash64(doc_id_text(F.col("doc_id")), "text")).join(share, "lang").filter(
        F.pmod("h", F.lit(1 << 20)) < F.col("share") * (1 << 20))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("h"), "h"))
    some = drawn.withColumn("rank", rank).filter(F.col("rank") <= sample).select("lang", "h", "text")
    model = some.groupBy("lang").applyInArrow(lambda g: _fit(g, idf, centroids), "lang string, centroids binary, limits binary")
    return Model([tuple(r) for r in model.collect()], idf)


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from."""
    return docs.filter(~held_out(F.col("doc_id")))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score (cosine to the nearest
    centroid) and rejected.

    A null text and one without a letter are ``und``, score 0, rejected, and
    so is everything if no language was learned. Repeated rows are predicted
    each; a null id stays null. Extra columns are not read; an empty table
    gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)     # languages x centroids x 2 ** BITS floats
    kind = docs.schema[id_col].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, rejected = shared.value.predict(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)],
                                             ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(
        partial(trimmed, predict), f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns) that are not rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~shared.value.predict(batch.column(at))[2]))

    return docs.mapInArrow(partial(trimmed, keep), docs.schema)

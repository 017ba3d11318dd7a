"""Benchmark decontamination: BM25 retrieval of test items by every training
passage, with block-max WAND, then a check of question and answer overlap.

The inverted index holds the benchmark's items. Its items lie in blocks; for
each term the index keeps the term's greatest impact over all items and the
greatest in each block. A passage is a query of ``PASSAGE`` words, and the
next begins half a passage later, over the whole text. An item scores the sum
of its impacts for the passage's distinct terms, as a share of the score of
its own text, and everything at or above ``THRESHOLD`` is retrieved:

* WAND: the sum of the terms' greatest impacts bounds every item's score; a
  passage below the threshold is done.
* Block-max: the sums of the terms' block impacts bound each block's items;
  only blocks at or above the threshold are scored, item by item.

A retrieved item counts as contained if enough of its question's and of its
answer's word 3-grams occur in the text around the passage. One changed word
breaks up to three of them, so of a part of under ``SHORT`` words it is also
enough that as large a share of its words stand close together. Without
question and answer columns an item's whole text is its question.

The index is read by every task, so it is split by its measured size: items
are dealt to index parts of at most ``INDEX_BYTES`` of text and every passage
queries each part.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import trimmed
from .words import U, mix64, runs, spread, text_bytes, window_hashes, word_hashes, words

PASSAGE = 64          # words of a query; the next begins PASSAGE / 2 later
THRESHOLD = 0.5       # of the item's score for its own text
K1, B = 1.2, 0.75
ITEM_BLOCK = 16       # items of a block-max block
OVERLAP = 0.6         # share of 3-grams that must occur, of question and answer each
GRAM = 3
SHORT = 10            # words; of a part with fewer, the words are looked for too
INDEX_BYTES = 16 << 20
BOUNDS = 4 << 20      # block bounds held at once
PIECE_BYTES, LAP_BYTES = 1 << 20, 1 << 16  # text bytes looked at together, and of neighbouring pieces besides the items'

# ASCII letters and digits and all bytes beyond ASCII make terms, lower-cased; the rest parts them
_TERM = np.full(256, 0x20, np.uint8)
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _TERM[_low:_high + 1] = np.arange(_low, _high + 1)
_TERM[0x41:0x5B] += 32


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of the texts' terms. Of two-byte letters, the Latin
    capitals with accents are lower-cased too."""
    data = _TERM[data]
    if len(data):
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        data[1:][capital] += 0x20
    start, end, first = words(data, offsets)
    return word_hashes(data, start, end), first


class Index:
    """Postings of the items' entries (an item of more than ``PASSAGE`` terms
    has several, of equal length), impacts as shares of each entry's own
    score. ``vocabulary``: ascending term hashes; the postings of term t lie
    at ``post[t]:post[t + 1]`` in ``entry`` and ``impact``."""

    def __init__(self, items: Sequence[tuple]):
        texts = [(q or "", a or "") for _, q, a in items]
        self.ids = [i for i, _, _ in items]
        data, offsets = text_bytes(pa.array([q + " " + a for q, a in texts], pa.string()))
        self.longest = int(np.diff(offsets).max(initial=0))
        h, first = terms(data, offsets)
        self.length = np.diff(first)
        entries = np.maximum(1, -(-self.length // PASSAGE))
        self.item_of = np.repeat(np.arange(len(items)), entries)
        of = np.repeat(np.arange(len(items)), self.length)
        step = np.arange(len(h)) - first[of]
        of = (np.cumsum(entries) - entries)[of] + step * entries[of] // np.maximum(1, self.length[of])
        n, size = len(self.item_of), np.bincount(of, minlength=len(self.item_of))
        self.vocabulary, at = np.unique(h, return_inverse=True)
        pair, tf = np.unique(at * max(1, n) + of, return_counts=True)
        term, self.entry = pair // max(1, n), pair % max(1, n)
        df = np.bincount(term, minlength=len(self.vocabulary))
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        score = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[self.entry] / max(1.0, size.mean() if n else 1)))
        self.impact = score / np.bincount(self.entry, score, n)[self.entry]
        self.post = np.searchsorted(term, np.arange(len(self.vocabulary) + 1))
        self.blocks = -(-n // ITEM_BLOCK)
        block = self.entry // ITEM_BLOCK                       # ascending within a term
        lead = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
        self.greatest = np.maximum.reduceat(self.impact, self.post[:-1]) if len(pair) else np.zeros(0)
        self.block_impact = np.maximum.reduceat(self.impact, lead) if len(pair) else np.zeros(0)
        self.block_of = block[lead]
        self.block_post = np.searchsorted(term[lead], np.arange(len(self.vocabulary) + 1))
        self.parts = []                                        # of each item, (3-grams, words if few) of question and answer
        part_data, part_offsets = text_bytes(pa.array([p for pair_ in texts for p in pair_], pa.string()))
        ph, pf = terms(part_data, part_offsets)
        self.part_terms = np.diff(pf).reshape(-1, 2)
        for i in range(len(items)):
            halves = [ph[pf[2 * i + s]:pf[2 * i + s + 1]] for s in (0, 1)]
            self.parts.append([(np.unique(grams(t)), np.unique(t) if len(t) < SHORT else t[:0]) for t in halves])
        self.table = np.full(1 << 16, False)                  # quick test for hashes outside the vocabulary
        self.table[(self.vocabulary & U(0xFFFF)).astype(np.int64)] = True

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, terms): which of the hashes are terms of the index."""
        at = np.flatnonzero(self.table[(h & U(0xFFFF)).astype(np.int64)])
        if not len(self.vocabulary):
            return at[:0], at[:0]
        t = np.minimum(np.searchsorted(self.vocabulary, h[at]), len(self.vocabulary) - 1)
        hit = self.vocabulary[t] == h[at]
        return at[hit], t[hit]

    def retrieve(self, passage: np.ndarray, term: np.ndarray, threshold: float) -> Iterator[tuple[int, int, float]]:
        """(passage, entry, score) at or above the threshold, from the
        distinct (passage, term) pairs, ascending by passage."""
        names, at = np.unique(passage, return_inverse=True)
        live = np.bincount(at, self.greatest[term], len(names)) >= threshold
        keep = live[at]
        place = np.cumsum(live) - 1
        at, term, names = place[at[keep]], term[keep], names[live]
        step = max(1, BOUNDS // max(1, self.blocks))
        cuts = np.searchsorted(at, np.arange(0, len(names) + step, step))
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            p, t = at[lo:hi] - at[lo], term[lo:hi]
            n = int(p[-1]) + 1
            count = self.block_post[t + 1] - self.block_post[t]
            b = spread(self.block_post[t], count)
            most = np.bincount(np.repeat(p, count) * self.blocks + self.block_of[b], self.block_impact[b], n * self.blocks)
            open_ = (most >= threshold).reshape(n, self.blocks)
            some = open_.any(1)[p]
            p, t = p[some], t[some]
            count = self.post[t + 1] - self.post[t]
            q, post = np.repeat(p, count), spread(self.post[t], count)
            scored = open_[q, self.entry[post] // ITEM_BLOCK]           # blocks below the threshold are skipped
            q, post = q[scored], post[scored]
            pair, to = np.unique(q * len(self.item_of) + self.entry[post], return_inverse=True)
            score = np.bincount(to, self.impact[post], len(pair))
            for k in np.flatnonzero(score >= threshold):
                yield int(names[at[lo] + pair[k] // len(self.item_of)]), int(pair[k] % len(self.item_of)), float(score[k])


def grams(h: np.ndarray) -> np.ndarray:
    """Hashes of the runs of ``GRAM`` terms; of fewer terms, of all together."""
    return window_hashes(h, GRAM) if len(h) >= GRAM else mix64(window_hashes(h, len(h))) if len(h) else np.zeros(0, U)


def close_words(few: np.ndarray, around: np.ndarray, n_terms: int) -> float:
    """The greatest share of a part's words found in a run of ``GRAM - 1``
    terms more than the part has."""
    run = min(len(around), n_terms + GRAM - 1)
    seen = np.zeros(len(around) - run + 1, np.int64)
    for word in few:
        to = np.concatenate([[0], np.cumsum(around == word)])
        seen += to[run:] > to[:len(to) - run]
    return float(seen.max() / len(few))


def contained(part: np.ndarray, few: np.ndarray, around: np.ndarray, n_terms: int) -> float:
    """Share of a part's grams, or of its words if they are few and more of
    them are found, in the terms around a passage."""
    if not len(part):
        return 1.0
    found = grams(around)
    if n_terms < GRAM:
        found = mix64(window_hashes(around, n_terms)) if len(around) >= n_terms else found[:0]
    share = float(np.isin(part, found).mean())
    return max(share, close_words(few, around, n_terms)) if len(few) else share


def matches(index: Index, data: np.ndarray, offsets: np.ndarray, threshold: float, overlap: float) -> Iterator[tuple]:
    """(text, item, score, question overlap, answer overlap) of the verified
    items of each text, the best passage of each."""
    h, first = terms(data, offsets)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    place, term = index.look_up(h)
    if not len(place):
        return
    half = PASSAGE // 2
    step = (np.arange(len(h)) - first[doc])[place] // half    # half passages of the text
    base = np.concatenate([[0], np.cumsum(-(-np.diff(first) // half) + 1)])
    passage = base[doc[place]] + step                         # passage k covers half passages k - 1 and k
    pair = np.unique(np.concatenate([passage, passage + 1]) * len(index.vocabulary) + np.concatenate([term, term]))
    best: dict[tuple, tuple] = {}
    for p, entry, score in index.retrieve(pair // len(index.vocabulary), pair % len(index.vocabulary), threshold):
        item = int(index.item_of[entry])
        d = int(np.searchsorted(base, p, "right")) - 1
        at = first[d] + (p - base[d] - 1) * half
        around = h[max(first[d], at - index.length[item]):min(first[d + 1], at + PASSAGE + index.length[item])]
        q, a = index.parts[item]
        if best.get((d, item), (-1.0,))[0] >= score:
            continue
        over = contained(*q, around, index.part_terms[item][0]), contained(*a, around, index.part_terms[item][1])
        if min(over) >= overlap:
            best[d, item] = score, *over
    for (d, item), found in best.items():
        yield d, item, *found


def pieces(data: np.ndarray, offsets: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, bytes, offsets) of texts taken together; a
    text longer than a piece comes alone, in pieces that overlap by twice the
    ``longest`` item and more, so that an item lies whole in one of them."""
    lap = 2 * longest + LAP_BYTES
    size = PIECE_BYTES + lap
    for i, j in runs(offsets, PIECE_BYTES):
        lo, hi = int(offsets[i]), int(offsets[j])
        if j - i > 1 or hi - lo <= size:
            yield i, data[lo:hi], offsets[i:j + 1] - lo
            continue
        for at in range(lo, hi, PIECE_BYTES):
            piece = data[at:min(hi, at + size)]
            yield i, piece, np.array([0, len(piece)])
            if at + size >= hi:
                break


def with_parts(benchmark: DataFrame) -> DataFrame:
    """(item_id, question, answer) of the items; a single text is all question,
    and a null part is empty."""
    if {"question", "answer"} <= set(benchmark.columns):
        return benchmark.select("item_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("question", "answer")])
    return benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("question"), F.lit("").alias("answer"))


def index_parts(benchmark: DataFrame, index_bytes: int = INDEX_BYTES) -> Iterator[list[tuple]]:
    """The items with any term, in parts of bounded size (by a hash of the
    id), one part at a time on the driver."""
    items = with_parts(benchmark).filter(F.concat("question", F.lit(" "), "answer").rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"))
    size = items.agg(F.sum(F.octet_length("question") + F.octet_length("answer") + 64)).first()[0] or 0
    n = max(1, -(-size // index_bytes))
    for k in range(n):
        yield [tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).orderBy("item_id").collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP,
               id_col: str = "doc_id", text_col: str = "text", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of each
    document and each benchmark item it contains.

    Null and empty texts contain nothing; items without a term are not
    looked for; a question or answer without a term counts as contained.
    Repeated rows and items are reported each; a null doc_id
    stays null. Extra columns are not read; an empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    schema = f"doc_id {kind}, item_id {item_kind}, score double, question_overlap double, answer_overlap double"
    found = spark.createDataFrame([], schema)
    for items in index_parts(benchmark, index_bytes):
        index = spark.sparkContext.broadcast(Index(items))

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = _batch_matches(index.value, batch.column(1), threshold, overlap)
                cols = list(zip(*out)) if out else [[]] * 5
                ids = pa.array([index.value.ids[i] for i in cols[1]], item_type)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(cols[0], pa.int64())), ids, *[pa.array(c, pa.float64()) for c in cols[2:]]],
                    ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        found = found.unionByName(docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(partial(trimmed, search), schema))
    return found


def _batch_matches(index: Index, column: pa.Array, threshold: float, overlap: float) -> list[tuple]:
    """The matches of a batch's texts, one for each text and item."""
    best: dict[tuple, tuple] = {}
    data, offsets = text_bytes(column)
    for i, piece, at in pieces(data, offsets, index.longest):
        for d, item, *found in matches(index, piece, at, threshold, overlap):
            best[i + d, item] = max(best.get((i + d, item), (-1.0,)), tuple(found))
    return [(*k, *v) for k, v in sorted(best.items())]


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP,
               text_col: str = "text", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The rows of ``docs`` (all columns) that contain no benchmark item."""
    at = docs.columns.index(text_col)
    for items in index_parts(benchmark, index_bytes):
        index = docs.sparkSession.sparkContext.broadcast(Index(items))

        def keep(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leak = np.zeros(batch.num_rows, bool)
                leak[[m[0] for m in _batch_matches(index.value, batch.column(at), threshold, overlap)]] = True
                yield batch.filter(pa.array(~leak))

        docs = docs.mapInArrow(partial(trimmed, keep), docs.schema)
    return docs

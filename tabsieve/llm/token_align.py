"""Alignment of two tokenizers' tokens over a corpus.

Both tokenizers encode a space and the text. Where the joined bytes of both
token lists are those bytes, the tokens cover the same ground: byte offsets
at which a token of each ends cut them into groups, and tokens whose byte
ranges overlap are linked. Over the corpus, the links of a pair of ids are
counted.

Byte-level BPE is encoded by a merge-by-rank implementation with the ranks of
its own file, where that file is nothing more (``ranked_bpe``).

1. *Windows.* A shared end before a token that starts with a space in both
   lists is an anchor. Anchors split a document into windows, mostly a word
   each; a window's groups and links depend on its two tuples of ids alone,
   so a block's distinct windows are aligned once, all together.
2. *Blocks.* Each task packs the documents it reads into blocks: every
   document as numbers of windows, and each distinct window once with its
   groups and links. Blocks are written to the shared folder, so texts are
   encoded once and nothing is lost with an executor.
3. *Counts.* A block gives each of its distinct pairs with its number of
   links; pairs are summed over all blocks with partial sums, and the
   greatest count of each B id is taken.
4. *Answers.* The counts of a block's pairs return to it: sums over its
   distinct windows, then over its documents' windows, need no text again.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import NO_ID, pack, unpack
from .common import written

TOKENIZER_A = "/opt/tokenizers/byte_bpe_50k.json"
TOKENIZER_B = "/opt/tokenizers/piece_bpe_32k.model"
BLOCK_BYTES = 8 << 20      # text bytes of a block
BATCH_BYTES = 1 << 20      # text bytes encoded in one call
STRETCH = 1 << 16          # tokens spelt at once

BLOCKS = ("block long, ids binary, n_a binary, n_b binary, n_windows binary, windows binary, "
          "n_links binary, n_groups binary, links binary, codes binary, counts binary, names binary")
FOUND = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary:
    printable bytes for themselves, the others by the characters from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


# Fixed value: how byte-level BPE splits a text before it merges bytes.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def ranked_bpe(file: bytes):
    """The byte-level BPE of a tokenizer file as one that merges by rank,
    which gives the same ids in a third of the time; None unless the file is
    no more than that: the usual split, no normaliser, ids in order of the
    merges."""
    import tiktoken

    spec = json.loads(file)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    extra = {t["id"] for t in spec.get("added_tokens", [])}
    if (model["type"], split.get("type"), split.get("use_regex"), split.get("add_prefix_space"), spec.get("normalizer")) != (
            "BPE", "ByteLevel", True, False, None):
        return None
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    of = _byte_alphabet()
    ranks = {bytes(of[c] for c in token): i for token, i in model["vocab"].items() if i not in extra}
    return tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}) if len(ranks) == 256 + len(merges) else None


class Tokenizers:
    """Both tokenizers, from the contents of their files, with the bytes of
    every id."""

    def __init__(self, a: bytes, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"       # Spark deals out the work
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a.decode())
        self.a.encode_special_tokens = True
        self.ranked = ranked_bpe(a)
        self.b = SentencePieceProcessor(model_proto=b)
        of = _byte_alphabet()
        special = {i: t.content for i, t in self.a.get_added_tokens_decoder().items()}
        self.a_bytes = [b""] * (1 + max([*self.a.get_vocab().values(), *special]))
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = special[i].encode() if i in special else bytes(of[c] for c in token)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.IsByte(i) else p.replace("▁", " ").encode()
                        for i, p in ((i, self.b.IdToPiece(i)) for i in range(self.b.GetPieceSize()))]
        self.a_size, self.b_size = (np.array([len(t) for t in x], np.int32) for x in (self.a_bytes, self.b_bytes))
        # ids as they stand in a group's text: before a token of the same list, the other list, the next group, the next window
        self.n_ids = max(len(self.a_bytes), len(self.b_bytes))
        self.decimals = [f"{i}{sign}" for sign in ",|;\n" for i in range(self.n_ids)]
        self.a_space, self.b_space = (np.array([t[:1] == b" " for t in x]) for x in (self.a_bytes, self.b_bytes))

    def encode_a(self, texts: list[str]) -> Iterator[list[int]]:
        if self.ranked:
            return map(self.ranked.encode_ordinary, texts)
        return (e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False))

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]] | None]:
        """The ids of each text by both, None where it has no tokens: a null
        or empty text, or one that either joins to other bytes."""
        given = [t for t in texts if t]
        if not given:
            yield from (None for _ in texts)
            return
        a = iter(self.encode_a([" " + t for t in given]))
        b = iter(self.b.encode(given, num_threads=1))
        for t in texts:
            if not t:
                yield None
                continue
            ids_a, ids_b = next(a), next(b)
            want = b" " + t.encode("utf-8", "surrogatepass")
            same = b"".join(map(self.a_bytes.__getitem__, ids_a)) == want and b"".join(map(self.b_bytes.__getitem__, ids_b)) == want
            yield (ids_a, ids_b) if same else None


@lru_cache(maxsize=2)
def tokenizers(a: bytes, b: bytes) -> Tokenizers:
    """One pair for each Python worker."""
    return Tokenizers(a, b)


def _marks(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """For each byte offset up to the last of both ascending lists: 1 for one
    in A's, 2 for one in B's, 3 for one in both."""
    out = np.zeros(1 + max(ends_a.max(initial=0), ends_b.max(initial=0)), np.uint8)
    out[ends_a] = 1
    out[ends_b] += 2
    return out


def _before_spaces(ids: np.ndarray, size: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that a token with a space follows, and where they end."""
    at = np.flatnonzero(space[ids[1:]])
    return at, np.cumsum(size[ids])[at]


def anchors(a: np.ndarray, b: np.ndarray, t: Tokenizers) -> tuple[np.ndarray, np.ndarray]:
    """The windows' first tokens in both lists, and the lists' lengths last."""
    at_a, off_a = _before_spaces(a, t.a_size, t.a_space)
    at_b, off_b = _before_spaces(b, t.b_size, t.b_space)
    both = _marks(off_a, off_b) == 3
    return tuple(np.concatenate([[0], at[both[off]] + 1, [len(x)]]) for at, off, x in ((at_a, off_a, a), (at_b, off_b, b)))


def _window_numbers(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> pa.DictionaryArray:
    """Every window as the ids of its tokens, A's, -1 and B's, distinct ones
    once in the order they come."""
    n = len(cut_a) - 1
    sizes = np.ones((n, 3), np.int64)
    sizes[:, 0], sizes[:, 2] = np.diff(cut_a), np.diff(cut_b)
    part = np.repeat(np.tile(np.arange(3, dtype=np.uint8), n), sizes.ravel())
    del sizes
    ids = np.full(len(part), -1, np.int32)
    ids[part == 0], ids[part == 2] = a, b
    del part
    ends = 4 * (cut_a + cut_b + np.arange(n + 1))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids)]).dictionary_encode()


def align_windows(distinct: pa.LargeBinaryArray, t: Tokenizers) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """(groups as text with a line for each window, numbers of groups,
    numbers of links, codes of the links) of all distinct windows together:
    their tokens follow each other, and both lists cover the same bytes. A
    link's code is A's id * 2 ** 32 + B's id."""
    if not len(distinct):
        return "", *(np.zeros(0, np.int64) for _ in range(3))
    _, ends, data = distinct.buffers()
    ends, ids = np.frombuffer(ends, np.int64, len(distinct) + 1) // 4, np.frombuffer(data, np.int32)
    ids = ids[:ends[-1]]
    split = np.flatnonzero(ids == -1)
    second = np.arange(len(ids)) > np.repeat(split, np.diff(ends))
    a, b = ids[~second & (ids >= 0)], ids[second]
    end_a, end_b = np.cumsum(t.a_size[a]), np.cumsum(t.b_size[b])
    last = end_b[np.cumsum(ends[1:] - split - 1) - 1]                # where windows end
    # each stretch between two ends of either list links the tokens that cover it
    kind = _marks(end_a, end_b)
    stretch = np.flatnonzero(kind)
    kind = kind[stretch]
    in_a, in_b, shared = (kind & 1).astype(bool), (kind & 2).astype(bool), kind == 3
    codes = a[np.cumsum(in_a) - in_a].astype(np.int64) << 32 | b[np.cumsum(in_b) - in_b]
    of = np.searchsorted(stretch, last) + 1
    n_links, n_groups = np.diff(of, prepend=0), np.diff(np.cumsum(shared)[of - 1], prepend=0)
    # the tokens by group, A's before B's, and what stands behind each
    place = np.cumsum(shared) - shared
    side = np.concatenate([2 * place[in_a], 2 * place[in_b] + 1])
    order = np.argsort(side, kind="stable")
    side = side[order]
    closes = np.zeros(side[-1] // 2 + 1, np.int64)
    closes[np.cumsum(n_groups) - 1] = 1
    group = side[:-1] // 2
    behind = np.where(side[1:] == side[:-1], 0, np.where(side[1:] // 2 == group, 1, 2 + closes[group]))
    spelt = np.append(behind, 3) * t.n_ids + np.concatenate([a, b])[order]
    names = "".join("".join(map(t.decimals.__getitem__, spelt[i:i + STRETCH].tolist())) for i in range(0, len(spelt), STRETCH))
    return names[:-1], n_groups, n_links, codes


class Block:
    """The documents of a block as numbers of windows. ``memo`` is not read:
    the windows of a block are aligned together."""

    def __init__(self, t: Tokenizers, memo: dict | None = None):
        self.t = t
        self.ids, self.n_a, self.n_b, self.a, self.b = [], [], [], [], []
        self.size = 0

    def add(self, doc_id: int, text_bytes: int, tokens: tuple[list[int], list[int]] | None) -> None:
        self.size += text_bytes
        self.ids.append(doc_id)
        a, b = tokens or ((), ())
        self.n_a.append(len(a))
        self.n_b.append(len(b))
        self.a.append(np.array(a, np.int32))
        self.b.append(np.array(b, np.int32))

    def _windows(self) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The windows, and how many each document has: the documents' tokens
        follow each other, and as every document begins with a space in both
        lists, a window begins with it."""
        a, b = np.concatenate(self.a), np.concatenate(self.b)
        cut_a, cut_b = anchors(a, b, self.t) if len(a) else (np.zeros(1, np.int64),) * 2
        starts = np.searchsorted(cut_a, np.cumsum([0, *self.n_a]))
        return _window_numbers(a, b, cut_a, cut_b), np.diff(starts)

    def row(self, block: int) -> pa.RecordBatch:
        found, n_windows = self._windows()
        windows = found.indices.to_numpy().astype(np.int32)
        names, n_groups, n_links, flat = align_windows(found.dictionary, self.t)
        times = np.repeat(np.bincount(windows, minlength=len(n_links)), n_links)
        codes, at = np.unique(flat, return_inverse=True)
        counts = np.bincount(at, weights=times, minlength=len(codes)).astype(np.int64)
        cells = [np.array(self.ids, np.int64), np.array(self.n_a, np.int64), np.array(self.n_b, np.int64), n_windows.astype(np.int64),
                 windows, n_links.astype(np.int64), n_groups.astype(np.int64), at.astype(np.int32), codes, counts]
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *[pa.array([pack(c)], pa.binary()) for c in cells],
                                           pa.array([pack(names.encode())], pa.binary())], [c.split()[0] for c in BLOCKS.split(", ")])


def encode_blocks(docs: DataFrame, files: tuple[bytes, bytes], id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The blocks of all documents, read back from the shared folder; a
    longer document is a block of its own."""
    shared = docs.sparkSession.sparkContext.broadcast(files)         # two vocabulary files

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(*shared.value)
        number, block = TaskContext.get().partitionId() << 32, Block(t)
        for batch in batches:
            ids = batch.column(0).cast(pa.int64()).fill_null(NO_ID).to_pylist()
            texts = batch.column(1)
            lo = 0
            while lo < len(ids):
                some, size = [], 0
                while lo + len(some) < len(ids) and (not some or size < BATCH_BYTES):
                    some.append(texts[lo + len(some)].as_py())
                    size += len(some[-1] or "")
                for k, tokens in enumerate(t.encode(some)):
                    text_bytes = len((some[k] or "").encode("utf-8", "surrogatepass"))
                    if block.ids and block.size + text_bytes > block_bytes:
                        yield block.row(number)
                        number, block = number + 1, Block(t)
                    block.add(ids[lo + k], text_bytes, tokens)
                lo += len(some)
        if block.ids:
            yield block.row(number)

    return written(docs.select(id_col, text_col).mapInArrow(write, BLOCKS), "token-blocks")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, codes, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "codes", "counts"))):
            codes, counts = unpack(codes, np.int64), unpack(counts, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), block)), pa.array(codes), pa.array(counts)], ["block", "code", "n"])


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(code, n, best): links of every pair of ids, and whether no pair of
    the same B id has more. A window holds the pairs of one B id, at most as
    many as A has ids."""
    total = pairs.groupBy("code").agg(F.sum("n").alias("n"))
    of_b = Window.partitionBy(F.col("code").bitwiseAND(F.lit(0xFFFFFFFF)))
    return total.withColumn("best", F.col("n") == F.max("n").over(of_b))


def _sums(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``count`` values."""
    total = np.concatenate([[0], np.cumsum(values)])
    end = np.cumsum(count)
    return total[end] - total[end - count]


def _answer(block: pa.Table, answers: pa.Table, text: bool) -> pa.Table:
    row = block.to_pylist()[0]
    ids, n_a, n_b, n_windows, n_links, n_groups = (unpack(row[c], np.int64) for c in ("ids", "n_a", "n_b", "n_windows", "n_links", "n_groups"))
    windows, links = unpack(row["windows"], np.int32), unpack(row["links"], np.int32)
    order = np.argsort(answers.column("code").to_numpy())
    n, best = (answers.column(c).to_numpy(zero_copy_only=False)[order].astype(np.int64) for c in ("n", "best"))
    per_window = [n_groups, n_links, _sums(best[links], n_links), _sums(n[links], n_links)]
    per_doc = [_sums(v[windows], n_windows) for v in per_window]
    names = np.array(unpack(row["names"]).tobytes().decode().split("\n"), object)
    cut = np.cumsum(n_windows)
    groups = [";".join(names[windows[j - k:j]]) for j, k in zip(cut, n_windows)]
    sha = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
    cells = [pa.array(ids, mask=ids == NO_ID), *[pa.array(c) for c in (n_a, n_b, *per_doc)], pa.array(sha, pa.string())]
    return pa.table(cells + ([pa.array(groups, pa.string())] if text else []),
                    [c.split()[0] for c in FOUND.split(", ")] + (["groups"] if text else []))


def read_files(a: str, b: str) -> tuple[bytes, bytes]:
    """The contents of both vocabulary files, which only the driver needs."""
    return Path(a).read_bytes(), Path(b).read_bytes()


def align(docs: DataFrame, tokenizer_a: str = TOKENIZER_A, tokenizer_b: str = TOKENIZER_B, id_col: str = "doc_id", text_col: str = "text",
          block_bytes: int = BLOCK_BYTES, groups: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_a and n_b (tokens), n_groups,
    n_links, n_best (links whose pair is its B id's most frequent, ties
    included), count_sum (of the pairs' counts over the links) and
    groups_sha256; with ``groups`` also the groups themselves, as
    ``a1,a2|b1;a3|b2,b3``.

    Null and empty texts, and texts that either tokenizer doesn't give back
    byte for byte, have no tokens: all numbers are 0 and both texts empty.
    Repeated rows are documents each and count each; null ids stay null;
    extra columns are not read; an empty table gives an empty result.
    """
    blocks = encode_blocks(docs, read_files(tokenizer_a, tokenizer_b), id_col, text_col, block_bytes)
    pairs = blocks.select("block", "codes", "counts").mapInArrow(_pairs, "block long, code long, n long")
    answers = pairs.select("block", "code").join(pair_counts(pairs), "code")
    schema = FOUND + (", groups string" if groups else "")
    finish = lambda b, r: _answer(b, r, groups)
    return blocks.drop("codes", "counts").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, schema)

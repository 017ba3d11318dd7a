"""Words of Arrow text columns as NumPy arrays: positions and 64-bit hashes,
without a Python object per word."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
_KEEP = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], dtype=U)  # low bytes of a 64-bit load
LONG_WORD = 256   # bytes; longer words are hashed one by one
STEP_BYTES = 1 << 18


def mix64(h: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values (in place on a fresh array)."""
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(29)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(32)
    return h


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = pc.fill_null(column.cast(pa.large_binary()), b"")
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], width)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows with at most ``most`` bytes together (a
    larger row stands alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte ranges of all words in order; the words of
    text i are numbers first[i] to first[i + 1] - 1."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = (data != 0x20) & (data - np.uint8(0x09) > 4)
    edge = solid.copy()
    edge[1:] &= ~solid[:-1]
    inner = offsets[:-1][(offsets[:-1] < n)]
    edge[inner] = solid[inner]          # a text begins a word even if the text before ends in one
    start = np.flatnonzero(edge)
    solid[:-1] &= ~solid[1:] | edge[1:]
    end = np.flatnonzero(solid) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    size = end - start
    if not len(start):
        return np.zeros(0, U)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    load = lambda at, left: eight[at].view(U).ravel() & _KEEP[np.minimum(left, 8)]
    h = mix64(load(start, size) ^ (size.astype(U) * U(0x9E3779B97F4A7C15) + U(seed)))
    done = 8
    rest = np.flatnonzero(size > done)
    while len(rest) and done < LONG_WORD:
        h[rest] = mix64(h[rest] * U(0x9FB21C651E98DF25) ^ load(start[rest] + done, size[rest] - done))
        done += 8
        rest = rest[size[rest] > done]
    for i in rest:
        digest = hashlib.blake2b(data[start[i]:end[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest()
        h[i] = int.from_bytes(digest, "little")
    return h


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` consecutive words (by order of words;
    len(h) - width + 1 of them)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    out = h[:n].copy()
    for k in range(1, width):
        out *= U(0x9E3779B97F4A7C15)
        out += h[k:k + n]
    return mix64(out)


def single_spaced(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words joined by one space (and one after the last): the new bytes
    and the words' new ranges."""
    size = end - start + 1
    new_end = np.cumsum(size) - 1
    out = slices(np.append(data, np.uint8(0x20)), start, size)
    out[new_end] = 0x20
    return out, new_end + 1 - size, new_end


def slices(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """data[start:start + size] of every pair, one behind the other (copied
    in steps, so that the index stays small)."""
    end = np.cumsum(size)
    out = np.empty(int(end[-1]) if len(end) else 0, data.dtype)
    i, done = 0, 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(end, done + STEP_BYTES, "right")))
        out[done:end[j - 1]] = data[spread(start[i:j], size[i:j])]
        i, done = j, int(end[j - 1])
    return out


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), first[1], ..."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    begin = np.cumsum(count) - count
    return np.repeat(np.asarray(first, np.int64) - begin, count) + np.arange(total)

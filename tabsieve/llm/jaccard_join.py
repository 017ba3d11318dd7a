"""Near-duplicate groups by an exact n-gram Jaccard join.

A document's set holds the hashes of its distinct 5-word shingles; two
documents link when their sets' Jaccard similarity is at least 0.8. The
result is each document's component under these links, so no list of all
pairs of a group is ever made.

1. *Classes.* Equal sets are one class (128-bit sum of scrambled hashes).
2. *Shared shingles.* A set can only link to another if at least 0.8 of its
   own shingles occur in a second document. Blocks of documents (``blocks``)
   send short fingerprints of their distinct shingles to hash partitions and
   learn which occur twice; equal fingerprints of different shingles only
   keep a set that could have been left out. Sets below 0.8 are done.
3. *Tiles.* Of the rest, linked sets share one of their n - ceil(0.8 n) + 1
   least shingles and lie in the same or in neighbouring size bands (widths
   of 1.25). The sets that hold such a shingle are gathered under the first
   of them, its anchor; a tile is one anchor and two neighbouring bands, so
   the many shingles that near copies share make few tiles.
4. *Hubs.* Every tile names one hub; each set is compared with one hub of
   its tiles. This ties large groups of near copies together with one
   comparison per set.
5. *Bitmaps.* Tiles whose sets are all in one component are settled. In the
   others every set outside the tile's largest component meets all sets of
   other components, in square blocks of bounded size: hashed bitmaps, sized
   by the band, bound the overlap from above by bit counts. The sets of a
   block that pass with any other go to the same block once more, now with
   their sorted arrays, which are intersected there. A link joins its two
   components inside the block, so that no later pair of them is looked at,
   and only such links leave the block: fewer than it has members. Pairs are
   never written.
6. The components of all links give each document its smallest doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import bounded_broadcast
from .blocks import NO_ID, make_blocks, pack, read_block, unit_bytes, unpack
from .common import checkpointed, trimmed, written
from .graph import components
from .words import LOWER, U, mix64, window_hashes, word_hashes, words

SHINGLE = 5            # words
BLOCK_SETS = 1024      # sets on each side of a bitmap block
PREFIX_ROWS = 200_000  # rows of a batch
BITS = 16              # of a bitmap, for each member
BLOCK_BYTES = 8 << 20  # bytes of sets on each side of a bitmap block, about
GROUP_BYTES = 16 << 20  # bytes of sets in one call
STEP = 64              # sets that one is intersected with at once

# The similarity 0.8 stands in the code as the ratio 4 / 5.
MESSAGE = "part long, block long, prints binary"
REPLY = "block long, part long, shared binary"
SETS = "row long, doc_id long, mark long, n long, class binary, shingles binary"


def bands(most: int) -> np.ndarray:
    """First sizes of the bands: each at least 1.25 times the one before, so
    sets two bands apart cannot link."""
    first = [1]
    while first[-1] <= most:
        first.append(max(first[-1] + 1, -(-first[-1] * 5 // 4)))
    return np.array(first, np.int64)


BANDS = bands(1 << 40)


def band_of(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(BANDS, n, "right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, first): the set of text i, ascending, is values[first[i]:first[i + 1]]."""
    data = LOWER[data]
    start, end, first = words(data, offsets)
    h = word_hashes(data, start, end)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    value = mix64(window_hashes(h, SHINGLE) + U(SHINGLE))
    own = doc[:len(value)][doc[:len(value)] == doc[SHINGLE - 1:]] if len(value) else np.zeros(0, np.int64)
    value = value[doc[:len(value)] == doc[SHINGLE - 1:]] if len(value) else value
    for k in range(1, SHINGLE):                      # fewer words: the whole sequence
        short = np.flatnonzero(n == k)
        if len(short):
            value = np.concatenate([value, mix64(window_hashes(h, k) + U(k))[first[short]]])
            own = np.concatenate([own, short])
    order = np.argsort(value, kind="stable")
    order = order[np.argsort(own[order], kind="stable")]
    value, own = value[order], own[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (own[1:] != own[:-1])
    value, own = value[new], own[new]
    return value, np.searchsorted(own, np.arange(len(n) + 1))


def class_keys(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """16 bytes for each set, equal for equal sets."""
    out = np.zeros((len(first) - 1, 2), U)
    filled = np.diff(first) > 0
    for i, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
        if filled.any():
            out[filled, i] = np.add.reduceat(mix64(value ^ U(salt)), first[:-1][filled])
    return out


def _prints(value: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(part, 32-bit fingerprint), both ascending with the hash: the whole
    part of hash / 2**64 * parts and the leading bits of the fraction."""
    p, low = U(parts), U(0xFFFFFFFF)
    part = ((value >> U(32)) * p + (((value & low) * p) >> U(32))) >> U(32)
    return part.astype(np.int64), ((value * p) >> U(32)).astype(np.uint32)


def _distinct(value: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of a block (ascending) with their part and print."""
    kinds = np.unique(value)
    return (kinds, *_prints(kinds, parts))


def pack_ascending(a: np.ndarray) -> bytes:
    return pack(np.ascontiguousarray(np.diff(a, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T))


def unpack_ascending(b: bytes) -> np.ndarray:
    planes = np.ascontiguousarray(unpack(b).reshape(4, -1).T)
    return np.cumsum(planes.view(np.uint32).ravel(), dtype=np.uint32)


def _send(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            _, data, offsets = read_block(row)
            _, part, prints = _distinct(shingle_sets(data, offsets)[0], parts)
            cuts = np.flatnonzero(np.diff(part)) + 1
            out = [(int(part[i]), row["block"], pack_ascending(prints[i:j])) for i, j in zip([0, *cuts], [*cuts, len(part)]) if i < j]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
                    zip(*out), [pa.int64(), pa.int64(), pa.binary()])], ["part", "block", "prints"])


def _shared(key: tuple, table: pa.Table) -> pa.Table:
    """Which of the sent fingerprints were sent more than once, as bits."""
    rows = table.to_pylist()
    sent = [unpack_ascending(r["prints"]) for r in rows]
    _, at, n = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
    twice = n[at] > 1
    cuts = np.cumsum([0, *[len(s) for s in sent]])
    return pa.table([pa.array([r["block"] for r in rows], pa.int64()), pa.array([r["part"] for r in rows], pa.int64()),
                     pa.array([pack(np.packbits(twice[i:j])) for i, j in zip(cuts, cuts[1:])], pa.binary())], ["block", "part", "shared"])


def _sets(block: pa.Table, replies: pa.Table, parts: int) -> pa.Table:
    """A block's documents: set size and class; the set itself, once for each
    class, where at least 0.8 of it occurs in another document."""
    row = block.to_pylist()[0]
    ids, data, offsets = read_block(row)
    value, first = shingle_sets(data, offsets)
    n = np.diff(first)
    keys = class_keys(value, first)
    kinds, part, _ = _distinct(value, parts)
    twice = np.zeros(len(kinds), bool)
    for r in replies.to_pylist():
        i, j = np.searchsorted(part, [r["part"], r["part"] + 1])
        twice[i:j] = np.unpackbits(unpack(r["shared"]), count=j - i).astype(bool)
    at = np.searchsorted(kinds, value)
    twice |= np.bincount(at, minlength=len(kinds)) > 1        # within the block
    held = np.diff(np.concatenate([[0], np.cumsum(twice[at])])[first])
    raw = [k.tobytes() for k in keys]
    told, sets = set(), []
    for i in range(len(n)):
        send = n[i] > 0 and 5 * held[i] >= 4 * n[i] and raw[i] not in told
        if send:
            told.add(raw[i])
        sets.append(value[first[i]:first[i + 1]].tobytes() if send else None)
    number = (row["block"] >> 32 << 40) + ((row["block"] & 0xFFFFFFFF) << 20) + np.arange(len(n))   # of the row, its own
    return pa.table([pa.array(number), pa.array(ids, mask=ids == NO_ID), pa.array(unpack(row["marks"], np.int64)), pa.array(n.astype(np.int64)), pa.array(raw, pa.binary()),
                     pa.array(sets, pa.binary())], ["row", "doc_id", "mark", "n", "class", "shingles"])


def document_sets(docs: DataFrame, id_col: str, text_col: str, part_bytes: int | None) -> DataFrame:
    """(row, doc_id, mark, n, class, shingles) of every row (steps 1 and 2).
    ``part_bytes``: text bytes per hash partition of the shared-shingle
    test, ``blocks.unit_bytes`` by default."""
    blocks = make_blocks(docs, id_col, text_col)
    size = blocks.agg(F.sum("size")).first()[0] or 0
    parts = max(1, -(-size // (part_bytes or unit_bytes(docs))))
    sent = blocks.mapInArrow(partial(trimmed, partial(_send, parts=parts)), MESSAGE)
    replies = sent.groupBy("part").applyInArrow(_shared, REPLY)
    sets = lambda b, r: _sets(b, r, parts)
    return written(blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(sets, SETS), "sets")


def _prefix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shingle, node, n): the shingles of each set that may make its tiles."""
    def rows(parts):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], ["shingle", "node", "n"])

    for batch in batches:
        out, held = [], 0
        for node, n, raw in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "shingles"))):
            least = np.frombuffer(raw, np.int64)[:n - -(-4 * n // 5) + 1]
            out.append((least, np.full(len(least), node), np.full(len(least), n)))
            held += len(least)
            if held > PREFIX_ROWS:
                yield rows(out)
                out, held = [], 0
        if out:
            yield rows(out)


def band_column(n: Column) -> Column:
    """The size band of a set size (a search in the bands' first sizes)."""
    return F.size(F.filter(F.array(*[F.lit(int(b)) for b in BANDS]), lambda b: b <= n)) - 1


def make_tiles(sets: DataFrame) -> DataFrame:
    """(anchor, band, node, n): the members of every tile."""
    rows = written(sets.mapInArrow(partial(trimmed, _prefix_rows), "shingle long, node long, n long"), "prefixes")
    held = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("anchor")).filter("k > 1")
    met = rows.join(held.select("shingle", "anchor"), "shingle").select("anchor", "node", "n").distinct()
    b = band_column(F.col("n"))
    return written(met.select("anchor", F.explode(F.array(b, b + 1)).alias("band"), "node", "n"), "tiles")


def bitmap(shingles: np.ndarray, band: int) -> np.ndarray:
    """A hashed bitmap with at least ``BITS`` bits for each member of the
    band's smallest set: few members share a bit, so the bound is close."""
    bits = 64
    while bits < BITS * BANDS[band]:
        bits *= 2
    flags = np.zeros(bits, bool)
    flags[(shingles % U(bits)).astype(np.int64)] = True
    return np.packbits(flags).view(U)


def shared(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """The overlap of a sorted set with each of the others."""
    size = np.array([len(y) for y in others])
    flat = np.concatenate(others)
    hit = x[np.minimum(np.searchsorted(x, flat), len(x) - 1)] == flat
    return np.add.reduceat(hit.astype(np.int64), np.cumsum(size) - size)


def _bitmap_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for node, n, raw in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "shingles"))):
            b, s = int(band_of(n)), np.frombuffer(raw, U)
            yield pa.RecordBatch.from_arrays([pa.array([node] * 2, pa.int64()), pa.array([b, b + 1], pa.int32()), pa.array(
                [pack(bitmap(s, b)), pack(bitmap(s, b + 1))], pa.binary())], ["node", "band", "bits"])


def _overlaps(pairs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the pairs with their sets, those that link."""
    for batch in pairs:
        keep = []
        for i, (x, y) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())):
            x, y = np.frombuffer(x, U), np.frombuffer(y, U)
            both = int(shared(x, [y])[0])
            if 100 * both >= 80 * (len(x) + len(y) - both):
                keep.append(i)
        yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))


def sets_of(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """The sets of the named nodes, picked where they are read if the names
    are few enough to be broadcast; else the join that follows on ``node``
    uses the same shuffle."""
    return sets.join(bounded_broadcast(nodes.select("node").distinct()), "node", "left_semi")


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets link."""
    pairs = written(pairs, "pairs")
    one, two = (sets_of(pairs.select(F.col(c).alias("node")), sets).select(F.col("node").alias(c), F.col("shingles").alias(s))
                for c, s in (("a", "x"), ("b", "y")))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(partial(trimmed, _overlaps), "a long, b long")


class _Block:
    """The sets of a block: rows (side 1 or 3) meet columns (2 or 3), in
    pairs of sizes within 0.8 whose greater band is the tile's (a pair of
    two others belongs to another tile)."""

    def __init__(self, node: np.ndarray, n: np.ndarray, side: np.ndarray, tile: int, bits: np.ndarray):
        self.node, self.n, self.tile, self.bits, self.band = node, n, tile, bits, band_of(n)
        self.rows, self.columns = np.flatnonzero(side != 2), np.flatnonzero(side != 1)

    def passing(self, i: int, part: np.ndarray) -> np.ndarray:
        """The columns of other parts whose bitmaps allow the overlap that a
        link with row ``i`` needs, the closest first."""
        j, n = self.columns, self.n
        j = j[(part[j] != part[i]) & (np.maximum(self.band[j], self.band[i]) == self.tile) & (5 * np.minimum(n[j], n[i]) >= 4 * np.maximum(n[j], n[i]))]
        more = np.bitwise_count(self.bits[i] & ~self.bits[j]).sum(1).astype(np.int64)
        less = np.bitwise_count(self.bits[j] & ~self.bits[i]).sum(1).astype(np.int64)
        most = np.minimum(n[i] - more, n[j] - less)
        may = 9 * most >= 4 * (n[i] + n[j])
        return j[may][np.argsort(-most[may], kind="stable")]

    def passing_members(self, part: np.ndarray, anchor: int, anchors: list[frozenset[int]]) -> np.ndarray:
        """Which sets pass with any other, in pairs that meet here first: two
        sets with several anchors in common are compared under the least."""
        out = np.zeros(len(self.n), bool)
        for i in self.rows:
            j = [k for k in self.passing(i, part) if min(anchors[i] & anchors[k]) == anchor]
            out[j] = True
            out[i] |= len(j) > 0
        return out

    def joining_links(self, part: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        """Links that tie all components which links of the block's pairs
        tie: a spanning forest of them."""
        out, n = [], self.n
        for i in self.rows:
            j = self.passing(i, part)
            while len(j):
                some, j = j[:STEP], j[STEP:]
                both = shared(sets[i], [sets[k] for k in some])
                for k in some[9 * both >= 4 * (n[i] + n[some])]:
                    if part[k] != part[i]:
                        out.append((int(self.node[i]), int(self.node[k])))
                        part[part == part[k]] = part[i]
                j = j[part[j] != part[i]]
        return out


CELL = ("anchor", "band", "r", "c")


def _cells(table: pa.Table) -> Iterator[tuple[np.ndarray, dict[str, np.ndarray]]]:
    """(rows of the table, their columns) of each block of a group."""
    col = {c: table.column(c).to_numpy() for c in (*CELL, "node", "n", "root", "side")}
    order = np.lexsort([col[c] for c in reversed(CELL)])
    name = np.stack([col[c][order] for c in CELL])
    cuts = np.flatnonzero((name[:, 1:] != name[:, :-1]).any(0)) + 1
    for at in np.split(order, cuts):
        yield at, {c: v[at] for c, v in col.items()}


def _pass(key: tuple, table: pa.Table) -> pa.Table:
    """The rows of a group's sets that pass with any other of their block."""
    raw, anchors = table.column("bits").to_pylist(), table.column("anchors")
    keep = [np.zeros(0, np.int64)]
    for at, c in _cells(table):
        block = _Block(c["node"], c["n"], c["side"], int(c["band"][0]), np.stack([unpack(raw[k], U) for k in at]))
        met = [frozenset(anchors[k].as_py()) for k in at]
        keep.append(at[block.passing_members(np.unique(c["root"], return_inverse=True)[1], int(c["anchor"][0]), met)])
    return table.drop_columns(["bits", "group", "anchors"]).take(pa.array(np.concatenate(keep)))


def _join(key: tuple, table: pa.Table) -> pa.Table:
    """The joining links of a group's blocks."""
    raw = table.column("shingles").to_pylist()
    out = []
    for at, c in _cells(table):
        tile, sets = int(c["band"][0]), [np.frombuffer(raw[k], U) for k in at]
        block = _Block(c["node"], c["n"], c["side"], tile, np.stack([bitmap(s, tile) for s in sets]))
        out += block.joining_links(np.unique(c["root"], return_inverse=True)[1], sets)
    a, b = zip(*out) if out else ((), ())
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def hub_pairs(tiles: DataFrame) -> DataFrame:
    """(a, b): each set with one hub of its tiles that its size allows."""
    rank = F.xxhash64("node")
    hubs = tiles.groupBy("anchor", "band").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct(rank, "node", "n")).alias("hub"))
    met = tiles.join(hubs.filter("k > 1"), ["anchor", "band"]).filter(
        (F.col("node") != F.col("hub.node")) & (5 * F.least("n", "hub.n") >= 4 * F.greatest("n", "hub.n")))
    return met.groupBy(F.col("node").alias("a")).agg(F.min("hub").alias("hub")).select("a", F.col("hub.node").alias("b"))


def open_links(tiles: DataFrame, roots: DataFrame, sets: DataFrame, block_sets: int) -> DataFrame:
    """(a, b): links that tie the components of unsettled tiles."""
    t = tiles.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    own = t.withColumn("own", band_column(F.col("n")) == F.col("band"))
    parts = own.groupBy("anchor", "band", "root").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"),
                                                    F.max("own").alias("own"))
    tile = parts.groupBy("anchor", "band").agg(F.count(F.lit(1)).alias("roots"), F.max("own").alias("own"), F.sum("k").alias("k"), F.sum("n").alias("n"),
                                                F.max(F.struct("k", "n", "root")).alias("top"))
    # block rows or columns for k sets of n members together
    blocks = lambda k, n: F.greatest(F.ceil(k / block_sets), F.ceil(n * 8 / BLOCK_BYTES)).cast("int")
    # a tile whose sets are all of the lesser band has no pair: they meet in that band's own tile
    unsettled = tile.filter("roots > 1 and own").select(
        "anchor", "band", "n", F.col("top.root").alias("top"), blocks(F.col("top.k"), F.col("top.n")).alias("of_top"),
        blocks(F.col("k") - F.col("top.k"), F.col("n") - F.col("top.n")).alias("of_rest"))
    # bytes of sets in all blocks, a little over
    size = unsettled.agg(F.sum(F.col("n") * 8 * (F.col("of_rest") + F.col("of_top")))).first()[0] or 0
    groups = max(1, -(-int(size) // GROUP_BYTES))
    t = t.join(unsettled.drop("n"), ["anchor", "band"])
    # outside the largest component: block row i and column i; inside: a column of every block row
    rest = F.col("root") != F.col("top")
    i = F.pmod(F.xxhash64("node"), F.when(rest, F.col("of_rest")).otherwise(F.col("of_top"))).cast("int")
    cell = lambda r, c, side: F.struct(r.alias("r"), c.alias("c"), F.lit(side).alias("side"))
    t = t.withColumn("i", i).withColumn("cells", F.when(rest, F.concat(
        F.transform(F.sequence(F.lit(0), F.col("of_rest") - 1), lambda x: F.when(
            x == F.col("i"), cell(x, x, 3)).when(x > F.col("i"), cell(F.col("i"), x, 1)).otherwise(cell(x, F.col("i"), 2))),
        F.transform(F.sequence(F.lit(0), F.col("of_top") - 1), lambda x: cell(F.col("i"), -1 - x, 1)))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("of_rest") - 1), lambda x: cell(x, -1 - F.col("i"), 2))))
    t = written(t.select("anchor", "band", "node", "n", "root", F.inline("cells")), "cells")
    cells = "anchor long, band int, node long, n long, root long, r int, c int, side int"
    group = F.pmod(F.xxhash64(*CELL), F.lit(groups)).alias("group")
    maps = sets_of(t, sets).mapInArrow(partial(trimmed, _bitmap_rows), "node long, band int, bits binary")
    anchors = t.groupBy("node").agg(F.collect_set("anchor").alias("anchors"))
    t = t.join(anchors, "node").join(maps, ["node", "band"]).select(*[c.split()[0] for c in cells.split(", ")], "anchors", "bits", group)
    passed = written(t.groupBy("group").applyInArrow(_pass, cells), "passed")
    passed = passed.join(sets_of(passed, sets).select("node", "shingles"), "node").withColumn("group", group)
    return passed.groupBy("group").applyInArrow(_join, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int | None = None,
                    block_sets: int = BLOCK_SETS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest
    doc_id reachable by links, its own included), ``kept`` (true for one row
    of each component, one with that id) and ``mark`` (hash of the text).

    Null texts, empty ones and those without words have no shingle, link to
    nothing and are their own component; fewer than five words make one
    shingle of the whole sequence. Every row is a document of its own, also
    where ids repeat. A null id is reached through like any other, but never
    the smallest; a component without any id has a null component_id. Extra
    columns are not read; an empty table gives an empty result.
    """
    rows = document_sets(docs, id_col, text_col, part_bytes)
    classes = written(rows.filter("n > 0").groupBy("class").agg(
        F.min("row").alias("node"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least"),
        F.first("n").alias("n"), F.first("shingles", ignorenulls=True).alias("shingles")), "classes")
    sets = classes.filter("shingles is not null").select("node", "n", "shingles")
    tiles = make_tiles(sets)
    first = checkpointed(linked(hub_pairs(tiles), sets))
    roots = components(first)
    roots = components(first.union(open_links(tiles, roots, sets, block_sets)))
    named = classes.select("class", "least", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = written(named, "named")
    least = named.groupBy("root").agg(F.min("least").alias("least"))
    place = named.select("class", "root").join(least, "root").select(
        "class", F.col("least.doc_id").alias("component_id"), F.col("least.row").alias("stays"))
    found = rows.select("row", "doc_id", "mark", "n", "class").join(place, "class", "left")
    words_ = F.col("n") > 0
    return found.select("doc_id", F.col("n").alias("n_shingles"),
                        F.when(words_, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
                        F.when(words_, F.col("row") == F.col("stays")).otherwise(F.lit(True)).alias("kept"), "mark")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns) that stay: one of each group of near
    duplicates. Rows are found again by id and hash of the text; those equal
    in both are one document and stay once. Rows without a word have no
    duplicates and stay each.

    What goes is broadcast behind a check of its size (no text is shuffled);
    beyond the bound both sides are shuffled."""
    found = near_duplicates(docs, id_col, text_col).filter("n_shingles > 0").select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("__id"), F.col("mark").alias("__mark"), "kept")
    keys = found.groupBy("__id", "__mark").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("rows"))
    keys = written(keys.filter("not stays or rows > 1"), "gone")
    gone, again = (bounded_broadcast(keys.filter(c).select("__id", "__mark")) for c in ("not stays or rows > 1", "stays and rows > 1"))
    rows = docs.withColumns({"__id": F.coalesce(F.col(id_col), F.lit(NO_ID)), "__mark": F.xxhash64(text_col)})
    once = rows.join(gone, ["__id", "__mark"], "left_anti")
    repeated = rows.join(again, ["__id", "__mark"], "left_semi").dropDuplicates(["__id", "__mark"])
    return once.unionByName(repeated).select(*[F.col(f"`{c}`") for c in docs.columns])

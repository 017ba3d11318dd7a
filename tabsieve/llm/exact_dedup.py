"""Exact duplicates through an extendible-hash index on shared files.

Every text gets a 64-bit key. The index is a directory over the keys'
leading bits: a bucket that holds more than ``capacity`` distinct keys is
split in two by one more bit, and where that bit is beyond the directory's
depth, the directory doubles. A bucket is therefore a key range, its depth
(number of leading bits) chosen by its own load. Copies of one text are one
key, so a text held by a third of all rows fills no bucket.

1. *Entries* (doc_id, key, digest; no text) are written to the shared folder.
2. *Directory*: distinct keys are counted by leading bits; each cell takes
   the least depth at which its range is not overfull.
3. *Chains*: rows are grouped by (key, text) - Spark compares the bytes of
   texts with equal hashes - with partial groups before the shuffle, so a
   hot text leaves each task as one row. Different texts under one key are
   the links of that key's chain.
4. *Index files*: links (key, digest, position in the chain, doc_id that
   stays, size; no text) are written sorted, dealt by key range, bucket by
   bucket.
5. Each entry finds its link by key and digest (skewed keys are split by AQE).

A chain with two links of one digest would make step 5 ambiguous: the job
stops with an error in that case rather than merge different texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, hash_cell, power_of_two, written

BUCKET_CAPACITY = 16_384   # distinct keys a bucket may hold before it is split


def normalised(text: Column) -> Column:
    """Null is empty; each run of white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def directory(keys: DataFrame, max_depth: int, capacity: int) -> DataFrame:
    """(cell, bucket, depth) for every cell (the leading ``max_depth`` bits)
    that holds a key of ``keys`` (distinct, column ``key``). ``bucket`` is
    the first cell of its key range; depth is the least one whose range holds
    at most ``capacity`` keys (``max_depth`` where none does: such a bucket
    overflows, which costs time but no row)."""
    cells = keys.groupBy(hash_cell(F.col("key"), 1 << max_depth).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    ranges = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("depth")).withColumn(
        "low", F.expr(f"shiftleft(shiftright(cell, {max_depth} - depth), {max_depth} - depth)"))
    load = ranges.groupBy("depth", "low").agg(F.sum("n").alias("held")).filter(
        (F.col("held") <= capacity) | (F.col("depth") == max_depth))
    return (ranges.select("cell", "depth", "low").join(load, ["depth", "low"])
            .groupBy("cell").agg(F.min(F.struct("depth", "low")).alias("b"))
            .select("cell", F.col("b.low").alias("bucket"), F.col("b.depth").alias("depth")))


def build_index(docs: DataFrame, key: Column | None = None, capacity: int = BUCKET_CAPACITY,
                id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The entries (doc_id, key, text_sha256) of all rows and the index
    (bucket, depth, key, text_sha256, link, keep_id, group_size), both read
    back from the shared folder. ``key`` (of column ``norm``) replaces the
    64-bit hash, for tests with many collisions."""
    key = F.xxhash64("norm") if key is None else key
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm")).withColumn("key", key)
    entries = written(rows.select("doc_id", "key", F.sha2("norm", 256).alias("text_sha256")), "entries")
    cells = power_of_two(entries.count() / capacity) * 8
    depth = cells.bit_length() - 1
    links = rows.groupBy("key", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    links = links.select("key", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    chain = Window.partitionBy("key").orderBy("text_sha256")
    links = links.withColumn("link", F.row_number().over(chain) - 1).withColumn(
        "ambiguous", F.lag("text_sha256").over(chain).eqNullSafe(F.col("text_sha256")))
    links = links.withColumn("text_sha256", F.when(~F.col("ambiguous"), F.col("text_sha256")).otherwise(
        F.raise_error(F.concat(F.lit("two texts share the digest "), "text_sha256"))))
    where = directory(entries.select("key").distinct(), depth, capacity)
    index = (links.withColumn("cell", hash_cell(F.col("key"), cells)).join(where, "cell")
             .select("bucket", "depth", "key", "text_sha256", "link", "keep_id", "group_size"))
    index = written(index.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key"), "index")
    return entries, index


def mark_copies(docs: DataFrame, key: Column | None = None, capacity: int = BUCKET_CAPACITY,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256,
    and the index's bucket, depth and link.

    Null texts count as empty, and empty texts are copies of one another. A
    null doc_id stays only in a group without other ids, then with keep_id
    null. Of repeated rows with the kept id, each is marked kept. Extra
    columns are not read; an empty table gives an empty result.
    """
    entries, index = build_index(docs, key, capacity, id_col, text_col)
    return entries.join(index, ["key", "text_sha256"]).select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "bucket", "depth", "link")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay (all of its columns), found again by id
    and digest."""
    gone = mark_copies(docs, id_col=id_col, text_col=text_col).filter(~F.col("kept"))
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).distinct()
    rows = docs.withColumn("__digest", F.sha2(normalised(F.col(text_col)), 256))
    same = rows[id_col].eqNullSafe(gone["__id"]) & (rows["__digest"] == gone["__sha"])
    return rows.join(gone, same, "left_anti").drop("__digest")

"""Sharding by proportional stratified interleaving.

Rows are ranked within their source in a seeded random order; the fractional
rank (rank + 1/2) / (rows of the source) spreads each source evenly over
[0, 1). Sorted by it, any stretch of the table holds the sources in their
overall proportions, so cutting the sorted rows into equal counts gives
shards that match the mixture. Law ``rows``: counts are at most one apart.

No window holds a source or the table. Both orders are cut into cells by
their own sort key - leading bits of the random order inside a source, then
ranges of the fractional rank - whose row counts are even whatever the
source's share; a small table of counts per cell gives each its offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, doc_id_text, hash_cell, power_of_two

CELL_ROWS = 20_000   # rows a window sorts, about
SEED = 11


def range_offsets(per_source: DataFrame, ranges: int) -> DataFrame:
    """(__t, __before): rows of all sources whose fractional rank lies below
    range ``__t`` of ``ranges`` equal ranges of [0, 1), from (__s, __n).

    Row r of n lies in range ((2r + 1) * ranges) div 2n, so a source with at
    least ``ranges`` rows gives one count per range and a smaller one a row
    per rank. The prefix sum runs over one row per range."""
    below = "(2 * __n * {t} + {T} - 1) div (2 * {T})"
    each = per_source.select("__n", F.explode(F.sequence(F.lit(0).cast("long"), F.least(
        F.col("__n"), F.lit(ranges).cast("long")) - 1)).alias("__i"))
    few = F.col("__n") < ranges
    held = each.select(
        F.when(few, F.expr(f"((2 * __i + 1) * {ranges}) div (2 * __n)")).otherwise(F.col("__i")).alias("__t"),
        F.when(few, F.lit(1)).otherwise(F.expr(f"{below.format(t='(__i + 1)', T=ranges)} - {below.format(t='__i', T=ranges)}")).alias("__m"))
    before = Window.orderBy("__t").rowsBetween(Window.unboundedPreceding, -1)
    return held.groupBy("__t").agg(F.sum("__m").alias("__m")).select(
        "__t", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__before"))


def place(docs: DataFrame, n_shards: int = 16, seed: int = SEED, cell_rows: int = CELL_ROWS,
          id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` with ``shard`` (0 to n_shards - 1), ``slot`` (gapless from 0
    in each shard) and ``position`` in the whole order (replacing columns of
    these names); all other columns stay.

    A null source is a source of its own; null ids and texts are ranked as
    empty ones. Rows with equal id and text are ordered by source only, so
    wholly equal rows may change places with one another. With fewer rows
    than shards some shards are empty; an empty table gives an empty result.
    """
    keep = [c for c in docs.columns if c not in ("shard", "slot", "position")]
    source = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("-"))
    docs = docs.select(*[F.col(f"`{c}`") for c in keep], source.alias("__s"),
                       F.xxhash64(F.lit(seed), doc_id_text(F.col(id_col)), F.coalesce(F.col(text_col), F.lit(""))).alias("__h"))
    per_source = checkpointed(docs.groupBy("__s").agg(F.count(F.lit(1)).alias("__n")))
    total = per_source.agg(F.sum("__n")).first()[0] or 0
    cells = power_of_two(total / cell_rows)
    rows = docs.withColumn("__c", hash_cell(F.col("__h"), cells))
    # rank within the source: rows of the cells before, then the row's number in its cell
    in_source = Window.partitionBy("__s")
    before = in_source.orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("__s", "__c").agg(F.count(F.lit(1)).alias("__m")).select(
        "__s", "__c", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__before"), F.sum("__m").over(in_source).alias("__n"))
    in_cell = Window.partitionBy("__s", "__c").orderBy(F.col("__h") < 0, "__h", id_col)    # unsigned, as the cells are
    ranked = rows.withColumn("__r", F.row_number().over(in_cell) - 1).join(offsets, ["__s", "__c"])
    ranked = ranked.withColumn("__r", F.col("__before") + F.col("__r")).withColumn(
        "__t", F.expr(f"((2 * __r + 1) * {cells}) div (2 * __n)")).drop("__before")
    # position in the table: rows of the ranges before, then the row's number in its range
    in_range = Window.partitionBy("__t").orderBy((F.col("__r") + F.lit(0.5)) / F.col("__n"),
                                                 F.xxhash64(F.lit(seed), "__s"), "__s")
    placed = ranked.withColumn("__r", F.row_number().over(in_range) - 1).join(range_offsets(per_source, cells), "__t")
    placed = placed.withColumn("position", F.col("__before") + F.col("__r")).withColumn(
        "shard", F.expr(f"cast((position * {n_shards}) div {max(1, total)} as int)"))
    first = F.expr(f"(shard * {total}L + {n_shards} - 1) div {n_shards}")
    return placed.select(*[F.col(f"`{c}`") for c in keep], "shard", (F.col("position") - first).alias("slot"), "position")


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``size`` (UTF-8 bytes and 1), ``text_crc32`` and ``law``,
    computed where the text is read; a null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({"size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(text), "law": F.lit("rows")})

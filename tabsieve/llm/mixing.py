"""Mixing sources to target weights.

Sizes are summed per source; the targets follow from the weights; a source's
repetition rate is target / size. Each document is emitted floor(rate) times
and once more if its own hash, read as a number in [0, 1), is below the
rate's fraction: a Bernoulli draw that depends on the id, the text and the
seed only, so reruns and retried tasks agree and rows with one id (or none)
are drawn apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import bounded_broadcast
from .common import checkpointed, doc_id_text, word_count

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = 7


def draw(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) from id and text: the leading 32 bits of an md5."""
    digest = F.md5(F.concat(doc_id_text(doc_id), F.lit(f":{seed}:"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, weight, target, rate) from (source, source_size).

    Sources in code-point order, null last, take the weights in turn. Each
    gets its weight's share of the total; a target above ``max_repeats``
    times its source stops there, and the excess goes to the others by
    weight until none is above. With the sources ordered by limit / weight
    that end is reached at the first source that stays below its limit when
    all before it are at theirs. A source of size 0 has target and rate 0.
    The windows run over one row per source."""
    pick = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    s = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    s = s.withColumn("weight", pick).withColumn("most", F.col("source_size") * max_repeats)
    fill = Window.orderBy(F.col("most") / F.col("weight"), "place")
    before, every = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = ((F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0))).cast("double")
             / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("double"))
    s = s.withColumn("order", F.row_number().over(fill)).withColumn("level", level)
    s = s.withColumn("level", F.min_by(F.when(F.col("weight") * F.col("level") < F.col("most"), F.col("level")),
                                       F.when(F.col("weight") * F.col("level") < F.col("most"), F.col("order"))).over(every))
    target = F.coalesce(F.least(F.col("most").cast("double"), F.col("weight") * F.col("level")), F.col("most").cast("double"))
    return s.withColumn("target", target).select(
        "source", "source_size", "weight", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"))


def repetitions(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = SEED,
                size: Column | None = None, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``docs`` with ``mix_size``, ``mix_source_size``, ``mix_target`` and
    ``mix_copies`` (how often the mix takes the row).

    Null texts have size 0; a null source is a source; repeated rows count
    in their source's size, and those equal in id and text share one draw; extra columns stay, an
    existing column of one of the four names is replaced. An empty table
    gives an empty result. The per-source table is summed with partial sums,
    checkpointed, and broadcast only behind a check of its size."""
    docs = docs.withColumn("mix_size", word_count(F.col("text")) if size is None else size)
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum("mix_size").alias("source_size"))
    targets = checkpointed(source_targets(sizes, weights, max_repeats))
    t = bounded_broadcast(targets.select(F.col("source").alias("__source"), F.col("source_size").alias("mix_source_size"),
                                         F.col("target").alias("mix_target"), F.col("rate").alias("__rate")))
    docs = docs.drop("mix_source_size", "mix_target", "mix_copies")
    joined = docs.join(t, docs[source_col].eqNullSafe(t["__source"]))
    whole = F.floor("__rate")
    extra = (draw(F.col(id_col), F.col("text"), seed) < F.col("__rate") - whole).cast("long")
    return joined.withColumn("mix_copies", whole + extra).drop("__source", "__rate")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows, with the columns of ``docs``: each as often as taken."""
    r = repetitions(docs, **options)
    each = r.select(*[F.col(f"`{c}`") for c in docs.columns], "mix_copies").filter("mix_copies > 0")
    return each.select(*[F.col(f"`{c}`") for c in docs.columns],
                       F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies"))).alias("__copy")).drop("__copy")

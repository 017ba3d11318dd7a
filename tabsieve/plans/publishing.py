"""Publishing composites on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import round_half_up
from ..operators import publish as PB
from ..sources.tables import Tables


def urgent_updates(t: Tables) -> DataFrame:
    """Update set: customers with urgent orders get a new segment and a
    balance equal to their urgent order value / 1000 (one row per key by
    construction: an aggregate)."""
    o = t.orders.filter(F.col("o_orderpriority") == "1-URGENT")
    return o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        round_half_up(F.sum("o_totalprice") / 1000.0, 2).alias("c_acctbal")).withColumn("c_mktsegment", F.lit("PRIORITY"))


def upsert(t: Tables) -> DataFrame:
    target = t.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return PB.upsert(target, urgent_updates(t), "c_custkey", ["c_acctbal", "c_mktsegment"], check_unique=False)


def match_counts(t: Tables) -> DataFrame:
    updates = t.orders.select(F.col("o_custkey").alias("c_custkey"))
    return PB.match_counts(t.customer, updates, "c_custkey")


def key_check(t: Tables) -> DataFrame:
    return PB.duplicate_keys(t.part, "p_name")

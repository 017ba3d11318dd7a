"""Column preparation and small selections on the driver tables (P4, P6-P10,
P14, F2, F11, J2, A33, O3, O8, T3, X16, M6, NaN inputs)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import kilobytes, megabytes, round_half_up
from ..operators import aggregates as A
from ..operators import filters as Fl
from ..operators import joins as J
from ..operators import learn as L
from ..operators import ordering as O
from ..operators import schema as P
from ..operators.chunk import with_chunk_metadata
from ..operators.correlation import correlation_pairs
from ..sources.tables import Tables
from . import catalogue as C
from . import corpus as K
from . import tabular as T

ALIGNED = ["l_tax", "code", "l_quantity", "not_there"]
NAN_COLUMNS = ["l_quantity", "tax", "discount"]


def aligned_features(t: Tables) -> DataFrame:
    """Columns dropped by name pattern, text coerced to numbers (bad
    values null), numbers kept, aligned to a feature list (absent ones 0),
    missing ones named."""
    li = t.lineitem.withColumn("code", F.when(F.col("l_linenumber") % 3 == 0, F.lit("n/a"))
                               .otherwise(F.col("l_linenumber").cast("string")))
    li = P.coerce_numeric(P.drop_by_patterns(li, ["DATE", "price"]), ["code"])
    li = P.numeric_only(li)
    marked = P.missing_features(li, ALIGNED)
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "missing_count"]
    out = P.align_to_features(marked.withColumn("missing_head", F.array_join("missing_head", ",")), ALIGNED,
                              keep=[*key, "missing_head"])
    return out


def records(t: Tables) -> DataFrame:
    """One JSON object per row."""
    return P.to_records(t.customer.select("c_custkey", "c_name", "c_nationkey"))


def listing_filled(t: Tables) -> DataFrame:
    """Q3 with F2 (true only) and P4 (probabilities folded to a map)."""
    out = C.listing(t, skip=0, limit=80, only_filled=True, include_probabilities=True)
    return out.select("o_orderkey", "is_filled", F.size("probabilities").alias("n_classes"),
                      *[round_half_up(F.col("probabilities")[c], 6).alias(f"p_{c.lower()}") for c in ("FILLED", "OPEN", "PARTIAL_FILL")])


def deep_page(t: Tables) -> DataFrame:
    """O3 far down an order, cut by distributed position."""
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return O.deep_page(li, ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey"], skip=4000, limit=500)


def suffixed_join(t: Tables) -> DataFrame:
    """Both sides have a ``balance``; the right one gets a suffix."""
    left = t.orders.select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("balance"))
    right = t.customer.select("c_custkey", F.col("c_acctbal").alias("balance"))
    return J.left_join(left, right, "o_custkey", "c_custkey")


def top_orders(t: Tables) -> DataFrame:
    """The three dearest orders of every customer."""
    o = t.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    return O.top_k_per_group(o, "o_custkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


def brands(t: Tables) -> DataFrame:
    """Distinct values of a column."""
    return A.distinct_values(t.part, "p_brand")


def best_order(t: Tables) -> DataFrame:
    """The single best row, first by key on ties."""
    return O.best_row(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")


def quarantined_pages(t: Tables) -> DataFrame:
    """pages whose extracted text is shorter than 1,500 characters."""
    return Fl.min_content(K.page_text(t), "text", 1500)[1].select("page_id", "url")


def chunk_metadata(t: Tables) -> DataFrame:
    """Every chunk's metadata, with the caller's own entry."""
    ch = K.corpus(t)
    m = with_chunk_metadata(ch, F.col("type"), "filename", {"origin": "driver"})
    return m.select("doc_id", "chunk_index", *[F.col("metadata")[k].alias(f"m_{k}") for k in (
        "type", "filename", "chunk_index", "total_chunks", "origin")])


def text_sizes(t: Tables) -> DataFrame:
    """UTF-8 bytes of the texts as KB and MB."""
    n = F.octet_length("text")
    return t.documents.select("doc_id", kilobytes(n).alias("kb"), round_half_up(megabytes(n), 9).alias("mb"))


def prepared_features(t: Tables) -> DataFrame:
    """M6: medians fill nulls, then the mean and population deviation of the
    filled column standardise."""
    f = T.feature_frame(t)
    pre = L.Preprocessor.fit(f, T.FEATURES)
    x = f.select("l_orderkey", "l_linenumber", *pre.columns(f))
    return x.select("l_orderkey", "l_linenumber", *[round_half_up(c, 5).alias(c) for c in T.FEATURES])


def nan_frame(t: Tables) -> DataFrame:
    """Features with NaN in place of some values."""
    nan = F.lit(float("nan"))
    return t.lineitem.select("l_quantity", F.when(F.col("l_linenumber") == 7, nan).otherwise(F.col("l_tax")).alias("tax"),
                             F.when(F.col("l_quantity") < 9, nan).otherwise(F.col("l_discount")).alias("discount"))


def nan_describe(t: Tables) -> DataFrame:
    """A10 where NaN counts as null."""
    return A.describe_columns(nan_frame(t), NAN_COLUMNS, digits=6)


def nan_correlation(t: Tables) -> DataFrame:
    """A19 where NaN counts as null."""
    p = correlation_pairs(nan_frame(t), NAN_COLUMNS)
    return p.select("i", "j", "col_i", "col_j", "n", round_half_up("r", 6).alias("r"))

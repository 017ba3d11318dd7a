"""Catalogue composites (Q1-Q5, Q8, Q10) on the driver tables.

The reference's wide object catalogue is stood in for by ``orders`` (objects
with a 3-class label, ``o_orderstatus``) joined to ``customer`` and
``nation`` (host side); its enrichment step by ``lineitem`` objects joined to
``supplier`` hosts through a key derived from a display name.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import (categorize, category_flag, first_token, pc_to_ly, prefer_when_present,
                                round_half_up, row_max, sph_to_cart)
from ..operators import aggregates as A
from ..operators import filters as Fl
from ..operators import ordering as O
from ..operators import schema as P
from ..operators.joins import bounded_broadcast, left_join
from ..sources.tables import Tables

# Label rules of the order catalogue (ordered; the first hit wins).
STATUS_RULES = [("F", True, "FILLED"), ("P", False, "PARTIAL_FILL"), ("O", None, "OPEN")]
# Class names, in the predicted spelling (space form, quirk 1).
CLASSES = ["FILLED", "OPEN", "PARTIAL FILL"]

# Curated projection groups (P1) for the listing and lookup queries.
ALLOW_GROUPS = [
    ["o_orderkey", "o_custkey"],
    ["c_name", "c_mktsegment", "n_name"],
    ["o_totalprice", "order_date", "o_orderpriority", "c_acctbal"],
    ["disposition", "disposition_source", "prediction_confidence", "is_filled"],
    ["actual_disposition", "actual_is_filled"],
    ["prob_FILLED", "prob_OPEN", "prob_PARTIAL_FILL"],
    ["o_comment_str"],
]
DENY = ["o_comment_str"]


def scored_orders(t: Tables) -> DataFrame:
    """Orders with a deterministic stand-in for model output: three scores
    derived from the row, normalised to probabilities, argmax label (space
    spelling), confidence = row max (X8), flag (X5), constant source (P12)."""
    o = t.orders
    s_f = F.lit(1) + F.col("o_orderkey") % 7
    s_o = F.lit(1) + F.col("o_custkey") % 5
    s_p = F.lit(1) + F.floor("o_totalprice") % 3
    tot = s_f + s_o + s_p
    o = o.withColumns({
        "prob_FILLED": s_f / tot, "prob_OPEN": s_o / tot, "prob_PARTIAL_FILL": s_p / tot,
        "disposition": F.when((s_f >= s_o) & (s_f >= s_p), F.lit("FILLED"))
                        .when(s_o >= s_p, F.lit("OPEN")).otherwise(F.lit("PARTIAL FILL")),
        "disposition_source": F.lit("model"),
        "order_date": F.date_format("o_orderdate", "yyyy-MM-dd"),
    })
    return o.withColumns({
        "prediction_confidence": row_max(["prob_FILLED", "prob_OPEN", "prob_PARTIAL_FILL"]),
        "is_filled": category_flag("disposition", ["FILLED"], ["PARTIAL FILL"]),
    })


def labelled_orders(t: Tables) -> DataFrame:
    """Scored objects with the actual columns derived from their status."""
    cat = categorize("o_orderstatus", STATUS_RULES)
    return scored_orders(t).withColumns({"actual_disposition": cat["category"], "actual_is_filled": cat["flag"]})


def with_hosts(t: Tables, o: DataFrame) -> DataFrame:
    """Objects left-joined to ``customer`` and ``nation``. nation is broadcast
    behind its size check; the customer join is left to the planner/AQE."""
    c = t.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment", "c_nationkey")
    n = t.nation.select("n_nationkey", "n_name", "n_regionkey")
    j = o.join(c, o["o_custkey"] == c["c_custkey"], "left")
    return j.join(bounded_broadcast(n, 100_000), j["c_nationkey"] == n["n_nationkey"], "left")


def prepare_catalogue(t: Tables) -> DataFrame:
    """Q10: labelled objects with their host side."""
    return with_hosts(t, labelled_orders(t))


def stats(t: Tables) -> DataFrame:
    """Q5: one aggregate over the catalogue."""
    return A.prediction_stats(prepare_catalogue(t), "disposition", "actual_disposition", CLASSES,
                              coord_cols=["c_acctbal", "n_name", "n_regionkey"], distance_col="c_acctbal",
                              source_col="disposition_source")


def overview(t: Tables) -> DataFrame:
    """Q2: total and predicted counts per class in one pass (scored table
    only: no join is needed for these counts, so none is planned)."""
    s = scored_orders(t)
    return A.conditional_counts(s, {
        "predicted_filled": F.col("disposition") == "FILLED",
        "predicted_partial_fill": F.col("disposition") == "PARTIAL FILL",
        "predicted_open": F.col("disposition") == "OPEN",
    }, total="total")


def listing(t: Tables, skip: int = 0, limit: int | None = 100, disposition: str | None = None,
            only_filled: bool | None = None, include_actual: bool = False,
            include_probabilities: bool = False) -> DataFrame:
    """Q3: optional filters (F1-F3), ordered page (O3), curated projection with
    flags (P1/P2), rename (P3), probabilities folded to a map (P4). The page
    is cut from the objects alone; only its rows are joined to their hosts
    (unique keys, so the join adds no row)."""
    pred = Fl.conjunction([Fl.eq_param("disposition", disposition), Fl.true_only("is_filled", bool(only_filled))])
    rows = O.page(Fl.where(labelled_orders(t), pred), ["o_orderkey"], skip, limit)
    cat = with_hosts(t, rows)
    deny = list(DENY)
    if not include_actual:
        deny += ["actual_disposition", "actual_is_filled"]
    keep_probs = include_probabilities
    if not keep_probs:
        deny += ["prob_FILLED", "prob_OPEN", "prob_PARTIAL_FILL"]
    out = P.curated_select(cat, ALLOW_GROUPS, deny).orderBy("o_orderkey")
    out = P.rename(out, {"prediction_confidence": "confidence"})
    if keep_probs:
        out = P.fold_to_map(out, "prob_", "probabilities")
    return out


def lookup(t: Tables, custkey: int, include_actual: bool = True) -> DataFrame:
    """Q4: every catalogue row of one key, ordered (quirk 8: rows, not one)."""
    cat = prepare_catalogue(t)
    deny = list(DENY) + ([] if include_actual else ["actual_disposition", "actual_is_filled"])
    deny += ["prob_FILLED", "prob_OPEN", "prob_PARTIAL_FILL"]
    out = P.curated_select(cat.filter(F.col("o_custkey") == F.lit(custkey)), ALLOW_GROUPS, deny)
    return out.orderBy("o_orderkey")


def enrich(t: Tables, digits: int = 6) -> DataFrame:
    """Q1: objects (lineitem rows named like 'Supplier#000000042 3') get a host
    key by first token (X1), are left-joined to hosts keeping fan-out (J1)
    with colliding columns renamed (J2), take host coordinates when the host has a distance (P11), and get
    Cartesian position (X2) and light-year distance (X3)."""
    li = t.lineitem.select(
        "l_orderkey", "l_linenumber",
        F.concat(F.lit("Supplier#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0"), F.lit(" "),
                 F.col("l_linenumber").cast("string")).alias("object_name"),
        (F.col("l_discount") * 3600.0).alias("ra"),
        (F.col("l_tax") * 1000.0 - 40.0).alias("dec"))
    li = li.withColumn("host", first_token("object_name"))
    hosts = t.supplier.select(
        F.col("s_name").alias("hostname"),
        F.pmod(F.col("s_acctbal"), F.lit(360.0)).alias("ra"),
        (F.col("s_nationkey") * 7 - 84).cast("double").alias("dec"),
        F.when(F.col("s_acctbal") > 1000, F.col("s_acctbal") / 10.0).alias("sy_dist"))
    hosts = hosts.withColumnsRenamed({"ra": "host_ra", "dec": "host_dec"})
    m = left_join(li, hosts, "host", "hostname", broadcast_right=True)
    m = m.withColumns({
        "use_ra": prefer_when_present("sy_dist", "host_ra", "ra"),
        "use_dec": prefer_when_present("sy_dist", "host_dec", "dec"),
    })
    xyz = sph_to_cart("use_ra", "use_dec", "sy_dist")
    r = lambda c: round_half_up(c, digits)
    return m.select("l_orderkey", "l_linenumber", "host", "hostname", r(F.col("use_ra")).alias("use_ra"),
                    r(F.col("use_dec")).alias("use_dec"), "sy_dist",
                    r(xyz["x"]).alias("x_pc"), r(xyz["y"]).alias("y_pc"), r(xyz["z"]).alias("z_pc"),
                    r(pc_to_ly("sy_dist")).alias("dist_ly"))


def unique_pairs(t: Tables, a: str = "l_returnflag", b: str = "l_linestatus") -> DataFrame:
    """Q8: distinct pairs and their number."""
    return A.distinct_pairs(t.lineitem, a, b)

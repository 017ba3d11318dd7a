"""Distributed global positions and running sums against pandas."""

import numpy as np
from pyspark.sql import functions as F

from tabsieve.operators import ordering as O


def test_global_positions_match_pandas(tables_mid):
    # the key (quantity desc, orderkey, linenumber) has exact duplicates in the
    # synthetic table, so rows are compared in position order, not by key
    keys = ["l_quantity", "l_orderkey", "l_linenumber"]
    li = tables_mid.lineitem.select(*keys, "l_extendedprice")
    got = O.global_positions(li, [F.desc("l_quantity"), F.asc("l_orderkey"), F.asc("l_linenumber")],
                             running=["l_extendedprice"], partitions=13).toPandas()
    got = got.sort_values("position").reset_index(drop=True)
    want = li.toPandas().sort_values(keys, ascending=[False, True, True], kind="stable").reset_index(drop=True)
    assert list(got["position"]) == list(range(1, len(want) + 1))
    assert (got[keys].to_numpy() == want[keys].to_numpy()).all()
    assert np.allclose(got["running_l_extendedprice"], got["l_extendedprice"].cumsum(), rtol=1e-9)
    assert np.isclose(got["running_l_extendedprice"].iloc[-1], want["l_extendedprice"].sum(), rtol=1e-9)


def test_cumulative_share_ends_at_one(tables_small):
    imp = tables_small.part.groupBy("p_brand").agg(F.sum("p_retailprice").alias("v"))
    c = O.cumulative_share(imp, "v", "p_brand").orderBy("position").toPandas()
    assert list(c["position"]) == list(range(1, len(c) + 1))
    assert abs(c["share"].iloc[-1] - 1.0) < 1e-12
    assert (c["v"].diff().dropna() <= 0).all()


def test_deep_page_equals_shallow_page(tables_mid):
    li = tables_mid.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    order = ["l_quantity", "l_orderkey", "l_linenumber", "l_partkey"]
    shallow = [tuple(r) for r in O.page(li, order, skip=1234, limit=300).collect()]
    deep = [tuple(r) for r in O.deep_page(li, order, skip=1234, limit=300).collect()]
    assert deep == shallow and len(deep) == 300
    tail = O.page(li, order, skip=59_990)
    assert tail.count() == li.count() - 59_990


def test_global_positions_without_running_sums(tables_mid):
    keys = ["l_quantity", "l_orderkey", "l_linenumber"]
    li = tables_mid.lineitem.select(*keys, "l_partkey")
    got = O.global_positions(li, [F.desc("l_quantity"), F.asc("l_orderkey"), F.asc("l_linenumber")],
                             partitions=11).toPandas().sort_values("position").reset_index(drop=True)
    want = li.toPandas().sort_values(keys, ascending=[False, True, True], kind="stable").reset_index(drop=True)
    assert list(got["position"]) == list(range(1, len(want) + 1))
    assert (got[keys].to_numpy() == want[keys].to_numpy()).all()


def test_running_sums_with_payload_columns(tables_mid, spark):
    # extra columns the counting branch does not need: the split of rows must
    # still be the one the numbering uses (it is written once)
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        keys = ["l_extendedprice", "l_orderkey", "l_linenumber"]
        li = tables_mid.lineitem.select(*keys, "l_partkey", "l_quantity")
        got = O.global_positions(li, [F.asc(k) for k in keys], running=["l_quantity"], partitions=7).toPandas()
        got = got.sort_values("position").reset_index(drop=True)
        want = li.toPandas().sort_values(keys, kind="stable").reset_index(drop=True)
        assert list(got["position"]) == list(range(1, len(want) + 1))
        assert (got[keys].to_numpy() == want[keys].to_numpy()).all()
        assert np.allclose(got["running_l_quantity"], got["l_quantity"].cumsum())
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")

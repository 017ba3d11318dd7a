"""Plan discipline of the registered queries (planning only, no execution):
no window without a partition key except over the one-row-per-range
summary of ``global_positions``; scans read only the columns a query uses;
the point lookup reaches the scan as a pushed filter."""

import pytest

import __spark_entry__ as E
from tabsieve.plans.suite import QUERIES

LEARNING = {"train_evaluate", "confusion_test", "cv_scores", "model_search", "family_leaderboard",
            "batch_scores", "feature_importance", "tree_metrics", "split_usage", "boosted_history"}


def _nodes(plan):
    """Every physical node, including adaptive plans, broadcast sides and
    subqueries."""
    stack, seen = [plan], []
    while stack:
        p = stack.pop()
        seen.append(p)
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            stack.append(p.executedPlan())
        kids = p.children()
        stack += [kids.apply(i) for i in range(kids.size())]
        subs = p.subqueries()
        stack += [subs.apply(i) for i in range(subs.size())]
    return seen


_PLANS: dict = {}


def _plan(spark, name):
    if name not in _PLANS:
        _PLANS[name] = E.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan()
    return _nodes(_PLANS[name])


@pytest.mark.parametrize("name", [q for q in QUERIES if q not in LEARNING])
def test_no_single_task_window_over_rows(spark, name):
    for n in _plan(spark, name):
        if n.nodeName() == "Window" and n.partitionSpec().size() == 0:
            order = n.orderSpec().toString()
            assert "__p" in order, f"{name}: unkeyed window over {order}"


@pytest.mark.parametrize("name", [q for q in QUERIES if q not in LEARNING])
def test_scans_prune_columns(spark, name):
    for n in _plan(spark, name):
        if n.nodeName().startswith("Scan parquet") or n.nodeName() == "FileSourceScanExec":
            desc = n.toString()
            if "lineitem.parquet" in desc:
                assert "l_shipdate" not in desc, f"{name} reads every lineitem column"
            if "documents.parquet" in desc:
                assert "lang" not in n.output().toString(), f"{name} reads unused document columns"


def test_lookup_key_is_pushed_to_the_scan(spark):
    scans = [n.toString() for n in _plan(spark, "lookup") if "orders.parquet" in n.toString()]
    assert scans and all("EqualTo(o_custkey" in s for s in scans)


def test_reports_join_nothing(spark):
    from tabsieve.plans import tabular as T
    from tabsieve.sources.tables import Tables

    labels = T._scored_labels(Tables(spark, "/root/testdata/sf0.001"))
    assert not any("Join" in n.nodeName() for n in _nodes(labels._jdf.queryExecution().executedPlan()))


def test_listing_is_cut_before_its_joins(spark):
    def joins_above(p, seen):
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            return joins_above(p.executedPlan(), seen)
        if name.startswith("TakeOrdered") or "Limit" in name:
            return [seen]
        kids = p.children()
        return [x for i in range(kids.size()) for x in joins_above(kids.apply(i), seen + ("Join" in name))]

    _plan(spark, "listing")
    assert max(joins_above(_PLANS["listing"], 0)) == 2

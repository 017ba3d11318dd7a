"""Run registry: unequal payloads, completeness, ties, records written twice."""

import pytest

from tabsieve.session import scratch_path
from tabsieve.sources import runs as RN


@pytest.fixture()
def base(spark):
    path = scratch_path(spark, "runs")
    RN.create(spark, path)
    return path


def put(spark, base, run, stamp, **payloads):
    for kind, json in payloads.items():
        RN.append(RN.literal_payload(spark, json), base, run, stamp, kind)


def test_empty_registry(spark, base):
    rec = RN.load(spark, base)
    assert RN.latest_complete(rec).count() == RN.metrics(rec).count() == RN.status(rec).count() == 0


def test_latest_complete_with_ties_nulls_and_broken_payloads(spark, base):
    full = dict(metrics='{"accuracy": 0.9, "a": {"f1": 0.8, "support": 4, "note": "text"}, "extra": [1]}',
                feature_names='["x", "y"]', importances='{"x": 0.25, "y": 0.75, "z": "none"}')
    put(spark, base, "r1", "20240101_000000", **full)
    put(spark, base, "r2", "20240101_000000", **full)
    put(spark, base, "r3", "20250101_000000", **full | {"importances": None})           # null: not complete
    put(spark, base, "r4", "20260101_000000", **full | {"metrics": "{broken"})           # unreadable: not complete
    put(spark, base, "r5", None, **full)
    rec = RN.load(spark, base)
    latest = RN.latest_complete(rec)
    assert {r["run"] for r in latest.collect()} == {"r2"}
    assert {(r["name"], r["metric"]): r["value"] for r in RN.metrics(latest).collect()} == {
        ("accuracy", "value"): 0.9, ("a", "f1"): 0.8, ("a", "support"): 4.0}
    assert [(r["rank"], r["feature"]) for r in RN.importances(latest).orderBy("rank").collect()] == [(1, "y"), (2, "x")]
    st = {r["run"]: r for r in RN.status(rec).collect()}
    assert len(st) == 5 and (st["r2"]["n_features"], st["r2"]["n_classes"], st["r2"]["accuracy"]) == (2, 1, 0.9)
    assert st["r4"]["accuracy"] is None and not st["r3"]["complete"]


def test_a_kind_written_twice_counts_with_its_latest_record(spark, base):
    put(spark, base, "r", "20240101_000000", metrics='{"accuracy": 0.1}')
    put(spark, base, "r", "20240101_000000", metrics='{"accuracy": 0.2}')
    assert [r["value"] for r in RN.metrics(RN.load(spark, base)).collect()] == [0.2]


def test_importances_as_a_list_and_extra_kinds(spark, base):
    put(spark, base, "r", "20240101_000000", metrics="{}", feature_names="[]", plot='{"k": 1}',
        importances='[{"feature": "b", "importance": 0.5}, {"feature": "a", "importance": 0.5}, {"importance": 1}, 3]')
    rec = RN.load(spark, base)
    assert [r["feature"] for r in RN.importances(rec, 2).orderBy("rank").collect()] == ["a", "b"]
    assert RN.runs(rec).first()["complete"]

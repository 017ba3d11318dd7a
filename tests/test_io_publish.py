"""Sources, sinks, snapshot publishing, artefact registry and streaming
ingest, on scratch folders created per run under /tmp."""

import os
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from tabsieve.operators import publish as PB
from tabsieve.operators.schema import MissingColumnsError, align_to_features, fold_to_map, missing_features
from tabsieve.sources import artefacts as AR
from tabsieve.sources import io as IO


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="tabsieve-test-", dir="/tmp")


def test_csv_roundtrip_nan_and_required(spark, scratch):
    p = os.path.join(scratch, "in.csv")
    with open(p, "w") as f:
        f.write("part_id,weight,name\n1,NaN,a\n2,3.5,\n")
    df = IO.read_csv(spark, p, "part_id long, weight double, name string", required=["part_id"])
    rows = df.orderBy("part_id").collect()
    assert rows[0]["weight"] is None and rows[1]["weight"] == 3.5
    with pytest.raises(MissingColumnsError):
        IO.read_csv(spark, p, "part_id long, weight double, name string", required=["height"])
    IO.write_csv(df, os.path.join(scratch, "out"))
    assert spark.read.option("header", True).csv(os.path.join(scratch, "out")).count() == 2


def test_source_fallback(spark, scratch):
    p = os.path.join(scratch, "in.csv")
    with open(p, "w") as f:
        f.write("a,b\n1,2\n")
    df, src = IO.resolve_source(spark, os.path.join(scratch, "missing"), p, "a int, b int")
    assert src == "csv" and df.count() == 1
    IO.write_table(df, os.path.join(scratch, "t"))
    df2, src2 = IO.resolve_source(spark, os.path.join(scratch, "t"), p)
    assert src2 == "table"


def test_snapshot_publish_insert_update_skip(spark, scratch):
    base = os.path.join(scratch, "pub")
    first = spark.createDataFrame([(1, "a", None), (2, "b", None), (3, "c", None)], "k long, name string, pred string")
    assert PB.publish(first, base, "k", ["pred"])["action"] == "insert"
    upd = spark.createDataFrame([(1, "x", "YES"), (3, "y", None), (9, "z", "NO")], "k long, name string, pred string")
    r = PB.publish(upd, base, "k", ["pred"], guard_col="pred")
    assert r["action"] == "update"
    cur = {x["k"]: (x["name"], x["pred"]) for x in PB.read_current(spark, base).collect()}
    assert cur == {1: ("a", "YES"), 2: ("b", None), 3: ("c", None)}
    assert PB.publish(upd, base, "k", ["pred"], guard_col="pred")["action"] == "skipped"


def test_a_lost_pointer_is_no_first_publish(spark, scratch):
    base = os.path.join(scratch, "pub")
    first = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, pred string")
    PB.publish(first, base, "k", ["pred"])
    PB.publish(first.limit(1), base, "k", ["pred"])
    pointers = [f for f in os.listdir(f"{base}/_current") if f.startswith("part-")]
    assert len(pointers) == 2                       # one per version, none replaced
    for f in pointers:
        open(f"{base}/_current/{f}", "w").close()
    with pytest.raises(RuntimeError):
        PB.publish(first.limit(1), base, "k", ["pred"])


def test_rebuild_keeps_every_upload(spark):
    from tabsieve.plans.facts import rebuild_corpus

    old = spark.createDataFrame([("page", "p"), ("pdf", "q"), (None, "r"), ("statistics", "old")], "type string, text string")
    new = spark.createDataFrame([("statistics", "new"), ("parameter", "x")], "type string, text string")
    got = {(r.type, r.text) for r in rebuild_corpus(old, new).collect()}
    assert got == {("page", "p"), ("pdf", "q"), (None, "r"), ("statistics", "new"), ("parameter", "x")}


def test_upsert_rejects_duplicate_keys(spark):
    t = spark.createDataFrame([(1, 1.0)], "k long, v double")
    u = spark.createDataFrame([(1, 2.0), (1, 3.0)], "k long, v double")
    with pytest.raises(PB.DuplicateKeyError):
        PB.upsert(t, u, "k", ["v"])


def test_schema_helpers(spark):
    df = spark.createDataFrame([(1, 0.2, 0.8, None)], "id long, prob_A double, prob_B double, x double")
    m = fold_to_map(df, "prob_", "probabilities").first()["probabilities"]
    assert m == {"A": 0.2, "B": 0.8}
    a = align_to_features(df, ["x", "y"], keep=["id"]).first()
    assert a["y"] == 0.0 and a["x"] is None
    mf = missing_features(df, ["x", "prob_A", "zz"]).first()
    assert mf["missing_count"] == 2 and mf["missing_head"] == ["x", "zz"]


def test_artefact_registry(spark, scratch):
    for stamp in ("20251004_221246", "20251005_101010"):
        for kind in ("model", "scaler", "label_encoder", "feature_names"):
            if stamp.startswith("20251005") and kind == "scaler":
                continue
            with open(os.path.join(scratch, f"{kind}_{stamp}.json"), "w") as f:
                f.write("{}")
            time.sleep(0.01)
    files = AR.listing(spark, scratch, "*.json")
    comp = {r["stamp"]: r["complete"] for r in AR.completeness(files).collect()}
    assert comp == {"20251004_221246": True, "20251005_101010": False}
    assert AR.latest_complete_run(files).first()["stamp"] == "20251004_221246"
    assert AR.latest(files, "model").first()["stamp"] == "20251005_101010"
    rel = AR.related(files, "20251004_221246", "scaler").first()
    assert rel["matched"] and rel["path"].endswith("scaler_20251004_221246.json")
    rel2 = AR.related(files, "20251009_000000", "scaler").first()
    assert not rel2["matched"] and rel2["path"].endswith("scaler_20251004_221246.json")


def test_streaming_corpus_append(spark, scratch, tables_small):
    from tabsieve.streaming.ingest import DOC_SCHEMA, corpus_stream, corpus_status, start_append

    landing = os.path.join(scratch, "landing")
    docs = tables_small.documents
    docs.filter(F.col("doc_id") % 2 == 0).write.parquet(os.path.join(landing, "b1"))
    out, ck = os.path.join(scratch, "corpus"), os.path.join(scratch, "ckpt")
    q = start_append(corpus_stream(spark, landing + "/*", DOC_SCHEMA), out, ck)
    q.awaitTermination(120)
    n1 = corpus_status(spark, out).first()["n_documents"]
    docs.filter(F.col("doc_id") % 2 == 1).write.parquet(os.path.join(landing, "b2"))
    q = start_append(corpus_stream(spark, landing + "/*", DOC_SCHEMA), out, ck)
    q.awaitTermination(120)
    st = corpus_status(spark, out).first()
    assert n1 < st["n_documents"] == docs.count()


def _hinted(df):
    return "broadcast" in df._jdf.queryExecution().analyzed().toString().lower()


def test_bounded_broadcast_checks_rows_and_bytes(tables_small):
    from tabsieve.operators.joins import bounded_broadcast

    n = tables_small.nation
    assert _hinted(bounded_broadcast(n))
    assert not _hinted(bounded_broadcast(n, max_rows=10))
    # 25 names of a few bytes each plus two ints: well over 100 bytes, under 10 kB
    assert not _hinted(bounded_broadcast(n, max_bytes=100))
    assert _hinted(bounded_broadcast(n, max_bytes=10_000))

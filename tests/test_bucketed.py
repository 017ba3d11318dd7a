"""Bucketed layout: untouched files stay, the table is not shuffled, lookups read one bucket."""

import os

import pytest
from pyspark.sql import functions as F

from tabsieve.operators import bucketed as BK
from tabsieve.operators.publish import DuplicateKeyError
from tabsieve.session import scratch_path


@pytest.fixture()
def base(spark):
    path = scratch_path(spark, "bucketed")
    df = spark.range(2000).select(F.col("id").alias("k"), F.lit("old").alias("v"), (F.col("id") * 2).alias("w"))
    BK.create(df.union(spark.createDataFrame([(None, "null", 0)], "k long, v string, w long")), path, "k", n_buckets=16)
    return path


def files(at, buckets):
    return {b: {(f, os.stat(os.path.join(p, f)).st_mtime_ns) for f in os.listdir(p)}
            for b in buckets for p in [at.paths[b].removeprefix("file:")]}


def test_update_rewrites_only_touched_buckets(spark, base):
    before = BK.layout(spark, base)
    stamp = files(before, before.paths)
    upd = spark.createDataFrame([(5, "new"), (900, None), (99999, "nobody"), (None, "none")], "k long, v string")
    touched = BK.upsert(spark, base, upd, ["v"])
    after = BK.layout(spark, base)
    assert 2 <= len(touched) <= 3
    rest = set(before.paths) - set(touched)
    assert {b: before.paths[b] for b in rest} == {b: after.paths[b] for b in rest}
    assert files(after, rest) == {b: stamp[b] for b in rest}
    rows = {r["k"]: (r["v"], r["w"]) for r in after.read(spark).collect()}
    assert len(rows) == 2001 and rows[5] == ("new", 10) and rows[900] == (None, 1800) and rows[None] == ("null", 0)
    assert all(v == ("old", k * 2) for k, v in rows.items() if k not in (5, 900, None))


def test_the_table_is_not_shuffled(spark, base):
    at = BK.layout(spark, base)
    plan = BK.merged(spark, at, spark.createDataFrame([(5, "new")], "k long, v string"), ["v"], [0, 1])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and text.replace("BroadcastExchange", "").count("Exchange") == 0


def test_lookup_reads_one_bucket_and_files_are_sorted(spark, base):
    at = BK.layout(spark, base)
    hit = BK.lookup(spark, base, 77)
    assert hit.collect()[0]["w"] == 154 and BK.lookup(spark, base, -1).count() == 0
    assert len({os.path.dirname(f) for f in hit.inputFiles()}) == 1 < len(at.paths)
    assert "EqualTo(k,77)" in hit._jdf.queryExecution().executedPlan().toString()
    for b in at.paths:
        keys = [r["k"] for r in at.read(spark, [b]).collect() if r["k"] is not None]
        assert keys == sorted(keys)


def test_keys_are_unique(spark, base):
    with pytest.raises(DuplicateKeyError):
        BK.upsert(spark, base, spark.createDataFrame([(5, "a"), (5, "b")], "k long, v string"), ["v"])
    with pytest.raises(DuplicateKeyError):
        BK.create(spark.createDataFrame([(1, "a"), (1, "b")], "k long, v string"), scratch_path(spark, "bucketed"), "k")


def test_empty_table(spark):
    path = scratch_path(spark, "bucketed")
    BK.create(spark.createDataFrame([], "k long, v string"), path, "k", n_buckets=4)
    assert BK.upsert(spark, path, spark.createDataFrame([(1, "a")], "k long, v string"), ["v"]) == []
    assert BK.layout(spark, path).read(spark).count() == 0 and BK.lookup(spark, path, 1).count() == 0

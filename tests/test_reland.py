"""Files landed again, batches killed between their two writes, counts of the current corpus."""

import os

import pytest
from pyspark.errors import StreamingQueryException

from tabsieve.session import scratch_path
from tabsieve.streaming import reland as RL

SCHEMA = "doc long, text string"


@pytest.fixture()
def place(spark):
    base, landing = scratch_path(spark, "relanded").removeprefix("file:"), scratch_path(spark, "landing").removeprefix("file:")
    os.makedirs(landing)

    def land(delivery, name, docs):
        import pandas as pd

        os.makedirs(f"{landing}/{delivery}", exist_ok=True)
        pd.DataFrame(docs, columns=["doc", "text"]).astype({"doc": "int64"}).to_parquet(f"{landing}/{delivery}/{name}.parquet", coerce_timestamps="us")

    def ingest(max_files=100):
        q = RL.start(RL.landed(spark, landing, SCHEMA, max_files=max_files), base, f"{base}/checkpoint", ["doc"])
        q.awaitTermination()

    def texts():
        return sorted((r["file"], r["doc"], r["text"]) for r in RL.current(spark, base, "doc long").collect())

    return land, ingest, texts, base


def test_a_file_landed_again_replaces_its_chunks(spark, place):
    land, ingest, texts, base = place
    assert texts() == [] and RL.status(spark, base, "doc long", "doc").first()["n_files"] == 0
    land("d1", "a", [(1, "first"), (2, "second")])
    land("d1", "b", [(3, "third"), (4, None)])
    ingest()
    land("d2", "a", [(1, "first again"), (5, "fifth")])
    ingest()
    assert texts() == [("a.parquet", 1, "first again"), ("a.parquet", 5, "fifth"), ("b.parquet", 3, "third")]
    st = RL.status(spark, base, "doc long", "doc").first()
    assert (st["n_files"], st["n_documents"], st["n_chunks"]) == (2, 3, 3) and st["last_ingest"] is not None
    ingest()                                                     # nothing new: nothing changes
    assert RL.status(spark, base, "doc long", "doc").first() == st


@pytest.mark.parametrize("max_files", [1, 100])
def test_two_deliveries_of_one_file_in_one_run(place, max_files):
    land, ingest, texts, _ = place
    land("d1", "a", [(1, "old")])
    land("d2", "a", [(1, "new"), (2, "more")])
    ingest(max_files)
    assert texts() == [("a.parquet", 1, "new"), ("a.parquet", 2, "more")]


def test_a_killed_batch_is_invisible_and_repeated(place, monkeypatch):
    land, ingest, texts, base = place
    land("d1", "a", [(1, "first")])
    ingest()
    land("d2", "a", [(1, "second")])
    with monkeypatch.context() as m:
        def killed(*a):
            raise RuntimeError("killed")
        m.setattr(RL, "_write_ledger", killed)
        with pytest.raises(StreamingQueryException):
            ingest()
    assert os.path.isdir(f"{base}/chunks/batch=1")               # written, but not committed
    assert texts() == [("a.parquet", 1, "first")]
    ingest()
    assert texts() == [("a.parquet", 1, "second")]

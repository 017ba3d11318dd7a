"""binary_ingest: one file per page, written and listed without a folder per page."""

import os
from types import SimpleNamespace

import pyarrow as pa
import pytest

from tabsieve.plans import cycles
from tabsieve.sources import io


@pytest.fixture
def scratch(monkeypatch, tmp_path):
    monkeypatch.setattr(cycles, "scratch_path", lambda _, name: f"file://{tmp_path}/{name}")
    return tmp_path


def texts_under(folder) -> dict[str, list[str]]:
    """Folder: its text files."""
    found = {d: [n for n in names if n.endswith(".txt")] for d, _, names in os.walk(folder)}
    return {d: names for d, names in found.items() if names}


def test_pages_are_files_of_few_folders(tables_mid, scratch):
    n = tables_mid.pages.count()
    assert cycles.binary_ingest(tables_mid).count() == 141
    found = texts_under(scratch / "files")
    assert sum(map(len, found.values())) == n == 250 and len(found) <= 8


def test_pages_of_any_id(spark, scratch):
    """Negative, missing and repeated ids; every row is a file and a row."""
    body = "<p>caf\u00e9</p>" * 400
    rows = [(-5, body), (None, body), (7, body), (7, body + "x"), (8, None), (9, "short"), (10, f"{body}\n\n")]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    got = sorted((r["page_id"] or 0, r["n_chars"]) for r in cycles.binary_ingest(SimpleNamespace(spark=spark, pages=pages)).collect())
    assert got == [(-5, 1999), (0, 1999), (7, 1999), (7, 2001), (10, 1999)]
    assert sum(map(len, texts_under(scratch / "files").values())) == len(rows)


def test_folders_at_once(spark, scratch, monkeypatch):
    """The driver lists some folders at a time, and all of them."""
    monkeypatch.setattr(io, "FILES_IN_FOLDER", 4)
    monkeypatch.setattr(io, "FILES_AT_ONCE", 10)
    listed, files_of = [], io.binary_files
    monkeypatch.setattr(io, "binary_files", lambda s, folders, glob: listed.append(files_of(s, folders, glob)) or listed[-1])
    pages = spark.range(50).selectExpr("id AS page_id", "repeat('a b ', 500) AS html")
    got = cycles.binary_ingest(SimpleNamespace(spark=spark, pages=pages))
    assert sorted(r["page_id"] for r in got.collect()) == list(range(50))
    assert len(listed) >= 5 and all(0 < f.count() <= 10 for f in listed)


def test_no_pages(spark, scratch):
    pages = spark.createDataFrame([], "page_id long, html string")
    got = cycles.binary_ingest(SimpleNamespace(spark=spark, pages=pages))
    assert got.count() == 0 and got.dtypes == [("page_id", "bigint"), ("n_chars", "int")]


def test_other_stores_have_a_folder_per_key(spark, scratch, monkeypatch):
    monkeypatch.setattr(io, "_mounted", lambda *_: None)
    pages = spark.createDataFrame([(1, "a" * 1500), (None, "b" * 1501), (2, "c"), (1, "d" * 1502)], "page_id long, html string")
    got = cycles.binary_ingest(SimpleNamespace(spark=spark, pages=pages))
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got.collect()) == [(0, 1501), (1, 1500), (1, 1502)]


def test_one_attempt_of_a_task_is_seen(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(io, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    batch = pa.RecordBatch.from_pydict({"id": [1, 2], "value": ["a", "b"]})

    def broken():
        yield batch
        raise OSError("disk")

    run = io._text_writer(str(tmp_path), "id")
    with pytest.raises(OSError, match="disk"):
        list(run(broken()))
    first, second = (list(run(iter([batch, batch])))[0].to_pylist() for _ in range(2))
    assert first == second == [{"folder": "part-3/0", "n": 4}]
    texts = io.binary_files(spark, str(tmp_path), "*.txt").collect()
    assert sorted(bytes(r["content"]) for r in texts) == [b"a\n", b"a\n", b"b\n", b"b\n"] and os.listdir(tmp_path) == ["part-3"]


def test_pages_are_cleaned_once(tables_small, scratch, monkeypatch):
    """The filter's length and the length that is returned are of one cleaned text."""
    seen, split = [], cycles.min_content
    monkeypatch.setattr(cycles, "min_content", lambda *a: seen.append(split(*a)) or seen[-1])
    cycles.binary_ingest(tables_small)
    kept = seen[0][0].selectExpr("length(text)")
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("<script") == 1


def test_a_task_takes_some_megabytes_of_files(spark, tmp_path):
    """A scan has its largest files first: of few tasks the first would read far more than the others."""
    for i in range(600):
        (tmp_path / f"{i}.txt").write_bytes(b"x" * (100 << 10))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8m")
    try:
        texts = io.extract_documents(io.binary_files(spark, str(tmp_path), "*.txt"), lambda _, b: b.decode())
        assert 24 <= texts.rdd.getNumPartitions() <= 32
        per_task = [r[1] for r in texts.selectExpr("spark_partition_id() AS p", "length(text) AS n").groupBy("p").sum("n").collect()]
        assert sum(per_task) == 600 * (100 << 10) and max(per_task) <= 3 << 20
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")

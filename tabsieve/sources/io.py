"""Sources and sinks.

Explicit schemas are preferred over inference: inference costs an extra
pass over the files and guesses differently per file on a big input.
"""

from __future__ import annotations

import errno
import os
import shutil
import uuid
from typing import Iterable, Iterator, Sequence
from urllib.parse import quote

from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalar import nan_to_null_all
from ..operators.partitioning import gather
from ..operators.schema import require_columns


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None,
             required: Iterable[str] = (), null_values: str = "", nan_to_null: bool = True) -> DataFrame:
    """CSV with header; explicit schema when given (inferred
    otherwise); NaN converted to null in float columns (section 1.3 contract);
    required columns checked (S8)."""
    r = spark.read.option("header", True).option("nullValue", null_values).option("nanValue", "NaN") \
             .option("mode", "PERMISSIVE")
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    df = r.csv(path)
    if nan_to_null:
        df = nan_to_null_all(df)
    return require_columns(df, required)


def read_collection(spark: SparkSession, path: str, drop: Sequence[str] = ("_id",)) -> DataFrame:
    """S3: a stored collection (Parquet), internal id columns dropped."""
    return spark.read.parquet(path).drop(*drop)


def resolve_source(spark: SparkSession, table_path: str | None, csv_path: str | None,
                   schema: StructType | str | None = None) -> tuple[DataFrame, str]:
    """Use the stored table when it exists and is non-empty, else the CSV.
    Returns (frame, source name). ``isEmpty`` reads at most one row."""
    if table_path:
        try:
            df = spark.read.parquet(table_path)
            if not df.isEmpty():
                return df, "table"
        except AnalysisException as e:          # only a missing path falls through
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    if csv_path is None:
        raise FileNotFoundError("no source available")
    return read_csv(spark, csv_path, schema), "csv"


def literal_rows(spark: SparkSession, rows: Sequence[tuple], schema: StructType | str) -> DataFrame:
    """Small literal table (e.g. sample documents with arrays)."""
    return spark.createDataFrame(list(rows), schema)


def read_json_artefact(spark: SparkSession, path: str, schema: StructType | str | None = None,
                       lines: bool = False) -> DataFrame:
    """JSON artefact (metrics, feature list): one value per file over any
    number of lines; with ``lines`` one value per line (what ``write_json``
    writes, read in parallel)."""
    r = spark.read.option("multiLine", not lines)
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """K1: CSV with header, no index column."""
    df.write.mode(mode).option("header", True).csv(path)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: Sequence[str] = ()) -> None:
    """K2 (errorifexists / append) and K4 (overwrite) as Parquet writes."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """K7: JSON lines sink (run records, feature lists, corpora)."""
    df.write.mode(mode).json(path)


def clean_for_write(df: DataFrame) -> DataFrame:
    """K9: NaN -> null in every float column before writing."""
    return nan_to_null_all(df)


FILES_IN_FOLDER = 2_000
FILES_AT_ONCE = 50_000
NO_KEY = "__HIVE_DEFAULT_PARTITION__"       # as Spark's writers name it


def _mounted(spark: SparkSession, path: str) -> str | None:
    """The folder as Python opens it, if its file system is a mounted one."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def _text_writer(folder: str, key: str):
    """A task's rows as files of a folder of its own, which gets its name when
    it is whole: of several attempts of a task one is there, and no part of
    another. Rows out: the inner folders and how many files each has."""
    import pyarrow as pa

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        own = f"{folder}/_attempt-{part}-{uuid.uuid4().hex}"
        try:
            for batch in batches:
                for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    if n % FILES_IN_FOLDER == 0:
                        os.makedirs(inner := f"{own}/{n // FILES_IN_FOLDER}")
                    name = NO_KEY if name is None else quote(str(name), safe="")
                    with open(f"{inner}/{key}={name}-{n}.txt", "wb") as f:
                        if text.is_valid:
                            f.write(text.as_buffer())
                        f.write(b"\n")
                    n += 1
            if n:
                try:
                    os.rename(own, f"{folder}/part-{part}")
                except OSError as e:
                    if e.errno not in (errno.EEXIST, errno.ENOTEMPTY):      # else another attempt was first
                        raise
        finally:
            shutil.rmtree(own, ignore_errors=True)
        starts = range(0, n, FILES_IN_FOLDER)
        yield pa.RecordBatch.from_arrays([pa.array([f"part-{part}/{i // FILES_IN_FOLDER}" for i in starts], pa.string()),
                                          pa.array([min(FILES_IN_FOLDER, n - i) for i in starts], pa.int64())], ["folder", "n"])

    return run


def write_texts(df: DataFrame, path: str, key: str, text: str) -> list[tuple[str, int]]:
    """One file per row, ``<key>=<value>`` in its path, holding the text and a
    line end as the text sink writes them. Returns folders that have all files
    and how many each has (0: not known).

    Spark's writer needs a folder per key, and on a mounted file system Hadoop
    without its native library starts a ``chmod`` process for every folder and
    file, so there the tasks write the files themselves, thousands to a folder."""
    spark, folder = df.sparkSession, _mounted(df.sparkSession, path)
    rows = df.select(F.col(key), F.col(text).alias("value"))
    if folder is None:
        rows.repartition(key).write.partitionBy(key).option("maxRecordsPerFile", 1).text(path)
        return [(path, 0)]
    os.makedirs(folder)
    found = rows.mapInArrow(_text_writer(folder, key), "folder string, n long").collect()
    return sorted((f"{path}/{r['folder']}", r["n"]) for r in found) or [(path, 0)]


def few_files(folders: Iterable[tuple[str, int]], most: int | None = None) -> Iterator[list[str]]:
    """Folders (with their numbers of files) in groups of at most ``most``
    files, or one folder: a scan's listing is held by the driver, some KB a
    file, so that of all folders at once would outgrow it."""
    group, total, most = [], 0, most or FILES_AT_ONCE
    for folder, n in folders:
        if group and total + n > most:
            yield group
            group, total = [], 0
        group.append(folder)
        total += n
    if group:
        yield group


def binary_files(spark: SparkSession, path: str | Sequence[str], glob: str = "*", recursive: bool = True,
                 with_content: bool = True) -> DataFrame:
    """File listing (path, modificationTime, length[, content]).
    Selecting without ``content`` lets Spark skip reading the bytes."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive) \
              .load(path if isinstance(path, str) else list(path))
    return df if with_content else df.select("path", "modificationTime", "length")


def extract_documents(files: DataFrame, extractor, out_schema: str = "path string, text string") -> DataFrame:
    """Run a per-file extractor (bytes -> text) as ``mapInPandas``; the
    extractor is a plain Python function ``(path, bytes) -> str``. Files
    whose extraction fails yield a null text (and can be quarantined). Small
    files share tasks (``gather``)."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            texts = []
            for p, b in zip(pdf["path"], pdf["content"]):
                try:
                    texts.append(extractor(p, b))
                except Exception:
                    texts.append(None)
            yield pd.DataFrame({"path": pdf["path"], "text": texts})

    return gather(files.select("path", "content")).mapInPandas(run, out_schema)

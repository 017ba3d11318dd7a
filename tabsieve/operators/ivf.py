"""Nearest neighbours by coarse-centroid inverted lists (M18 and T12 at a
scale where not every query can meet every row).

Centroids are fitted on a bounded sample of the vectors; every row is put
into the list of its nearest centroid and the lists are written once to the
shared folder. A query looks into the lists of its ``probes`` nearest
centroids and measures their rows exactly, so distances are exact and only
rows of other lists can be missed; with as many probes as lists the answer
is that of ``retrieve.nearest``. Long lists are cut into parts and the
queries of a list into blocks, so that a call never holds more than a part
and a block, whatever share of the rows a list has.

How many lists to probe is measured, not guessed: for some vectors of the
sample, their nearest others in the sample and the rank of those others'
lists. Neighbours in the whole corpus are closer than in a sample of it, so
the number found there is on the safe side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .partitioning import materialize, spread
from .publish import assert_unique
from .retrieve import finite_vectors

SAMPLE_ROWS = 20_000      # vectors the centroids are fitted on, at most
MOST_LISTS = 4096
PART_ROWS = 20_000        # rows of a list that one call measures
QUERY_ROWS = 2_000        # queries of a list in one call
BLOCK_NUMBERS = 1_000_000  # distances, or vectors' numbers, that a task holds at once
ROUNDS = 10
RECALL, TUNE_ROWS, TUNE_NEAR = 0.95, 500, 10      # share of neighbours to reach, measured on so many vectors and neighbours


def squared(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs, up to rounding."""
    return np.maximum((q * q).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * (q @ v.T), 0)


def k_means(x: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """At most ``k`` centroids of the rows of ``x``, started at random rows."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        at = np.concatenate([squared(x[i:i + 4096], c).argmin(1) for i in range(0, len(x), 4096)])
        total, n = np.zeros_like(c), np.bincount(at, minlength=len(c))
        np.add.at(total, at, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def measured_probes(x: np.ndarray, c: np.ndarray, recall: float) -> int:
    """The least number of lists that holds the share ``recall`` of the
    nearest others of the first vectors of the sample ``x``."""
    asked, near = x[:TUNE_ROWS], min(TUNE_NEAR, len(x) - 1)
    if near < 1:
        return 1
    d = squared(asked, x)
    d[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    others = np.argpartition(d, near - 1, axis=1)[:, :near]
    at = np.concatenate([squared(x[i:i + 4096], c).argmin(1) for i in range(0, len(x), 4096)])
    place = np.argsort(np.argsort(squared(asked, c), axis=1, kind="stable"), axis=1)       # rank of each list for each query
    return 1 + int(np.quantile(np.take_along_axis(place, at[others], axis=1), recall, method="higher"))


@dataclass
class Index:
    """``rows`` (list, part, id columns, vector, payload) and the centroids;
    ``parts`` is the number of parts by list, ``probes`` the lists to probe."""

    rows: DataFrame
    centroids: np.ndarray
    parts: np.ndarray
    ids: list[str]
    vec: str
    probes: int


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of an Arrow column, a row each."""
    return column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(column), -1)


def _nearest_lists(shared, vec: str, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        # so many rows that their distances to all lists, and their copies for the probed ones, stay bounded
        step = max(1, BLOCK_NUMBERS // max(1, len(c), probes * c.shape[1]))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                d = squared(matrix(part.column(vec)), c)
                near = d.argmin(1)[:, None] if probes == 1 else np.argsort(d, axis=1, kind="stable")[:, :probes]
                rows = part.take(pa.array(np.repeat(np.arange(part.num_rows), near.shape[1])))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(near.ravel(), pa.int32())], [*rows.schema.names, "list"])
    return run


def build(corpus: DataFrame, ids: str | list[str], vec: str = "embedding", payload: tuple[str, ...] = (), lists: int | None = None,
          sample: int = SAMPLE_ROWS, recall: float = RECALL) -> Index:
    """The index of ``corpus``; rows with a null, NaN or infinite number take
    no part. ``lists``: about the square root of the rows by default, at most
    ``MOST_LISTS``."""
    ids = [ids] if isinstance(ids, str) else list(ids)
    body = finite_vectors(corpus.select(*ids, vec, *payload), vec)
    n = body.count()
    draw = F.pmod(F.xxhash64(*ids), F.lit(1 << 20)) < F.lit(int(min(1.0, 2 * sample / max(1, n)) * (1 << 20)) + 1)
    some = [r[0] for r in body.filter(draw).orderBy(F.xxhash64(F.lit(1), *ids), *ids).select(vec).limit(sample).collect()]
    x = np.array(some, dtype="float64").reshape(len(some), -1)
    k = min(MOST_LISTS, lists or max(1, int(n ** 0.5)))
    centroids = k_means(x, k) if len(x) else np.zeros((1, 1))
    spark = corpus.sparkSession
    shared = spark.sparkContext.broadcast(centroids)                    # at most MOST_LISTS vectors
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in body.schema.fields] + ["list int"])
    listed = materialize(spread(body).mapInArrow(_nearest_lists(shared, vec, 1), schema), "ivf")
    parts = np.ones(len(centroids), np.int64)
    for at, rows in listed.groupBy("list").count().collect():           # one row per list
        parts[at] = -(-rows // PART_ROWS)
    of = F.element_at(F.array(*[F.lit(int(p)) for p in parts]), F.col("list") + 1)
    return Index(listed.withColumn("part", F.pmod(F.xxhash64(*ids), of).cast("int")), centroids, parts, ids, vec,
                 measured_probes(x, centroids, recall) if len(x) else 1)


def _measure(k: int, ids: list[str], vec: str, payload: list[str]):
    def run(key: tuple, rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        columns = ["qid", *ids, "dist", *payload]
        if not len(rows) or not len(asked):
            return pd.DataFrame(columns=columns)
        rows = rows.sort_values(ids, kind="stable").reset_index(drop=True)
        v, at, dist = np.array(rows[vec].tolist(), dtype="float64"), [], []
        for q in asked["__q"]:
            d = ((v - np.asarray(q, dtype="float64")) ** 2).sum(1)
            at.append(np.argsort(d, kind="stable")[:k])
            dist.append(d[at[-1]])
        found = rows[[*ids, *payload]].take(np.concatenate(at)).reset_index(drop=True)
        return found.assign(qid=np.repeat(asked["qid"].to_numpy(), min(k, len(rows))), dist=np.concatenate(dist))[columns]
    return run


def search(index: Index, queries: DataFrame, k: int, query_id: str, query_vec: str | None = None, probes: int | None = None,
           payload: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, rank, *ids, dist, *payload): the k nearest rows by squared
    L2 of the probed lists (``index.probes`` by default), ties by the ids. Query ids must be unique;
    queries with broken vectors have no answer."""
    qvec = query_vec or index.vec
    asked = finite_vectors(queries.select(F.col(query_id).alias("qid"), F.col(qvec).alias("__q")), "__q")
    assert_unique(asked, "qid")
    shared = queries.sparkSession.sparkContext.broadcast(index.centroids)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields] + ["list int"])
    probed = materialize(asked.mapInArrow(_nearest_lists(shared, "__q", min(probes or index.probes, len(index.centroids))), schema), "probes")
    # queries of a list in blocks; a part of a list meets each block
    blocks = probed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("blocks"))
    blocks = F.broadcast(blocks)                                       # at most one row per list
    of = F.element_at(F.array(*[F.lit(int(p)) for p in index.parts]), F.col("list") + 1)
    probed = probed.join(blocks, "list").withColumn("block", F.pmod(F.xxhash64("qid"), F.col("blocks")).cast("int")).withColumn(
        "part", F.explode(F.sequence(F.lit(0), (of - 1).cast("int")))).drop("blocks")
    rows = index.rows.select("list", "part", *index.ids, index.vec, *payload).join(blocks, "list").withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    kind = {f.name: f.dataType.simpleString() for f in [*index.rows.schema.fields, *asked.schema.fields]}
    out = ", ".join([f"qid {kind['qid']}", *[f"`{c}` {kind[c]}" for c in index.ids], "dist double", *[f"`{c}` {kind[c]}" for c in payload]])
    key = ["list", "part", "block"]
    found = rows.groupBy(*key).cogroup(probed.groupBy(*key)).applyInPandas(_measure(k, index.ids, index.vec, list(payload)), out)
    order = Window.partitionBy("qid").orderBy("dist", *index.ids)
    top = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return top.select(F.col("qid").alias(query_id), "rank", *index.ids, "dist", *payload)

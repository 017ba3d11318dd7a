"""Exact nearest-neighbour retrieval and context assembly (J4, X12, O7,
T12-T14, T18, M18).

Exact top-k without a join of all pairs: a batch of queries (bounded in rows
and bytes) is broadcast; each task scans its share of the corpus once with
NumPy and keeps exactly k rows per query by (distance, id). The matrix
product gives distances up to rounding; only rows that could be among the k
are measured exactly. Candidates (tasks x queries x k rows) are merged in two
steps, first in groups of tasks, then per query. Corpus rows never move
across the network. A query set of any size is cut into batches, one after
the other: a batch's answers are written to the shared folder and its matrix
released before the next is read.
"""

from __future__ import annotations

import heapq
from typing import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import truncate_text
from ..session import scratch_path
from .partitioning import spread
from .publish import assert_unique

MAX_QUERY_ROWS = 50_000          # of a batch
MAX_QUERY_BYTES = 256 << 20      # of a batch, vectors as float64
_BLOCK_ELEMS = 4_000_000         # queries x rows of a block of distances
MERGE_GROUPS = 256               # groups of tasks in the first merge


def finite_vectors(df: DataFrame, vec: str) -> DataFrame:
    """Rows whose vector has only finite numbers (no null, NaN, infinity)."""
    ok = F.forall(F.col(vec), lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return df.filter(F.col(vec).isNotNull() & ok)


def query_batches(queries: DataFrame, qid: str, vec: str, max_rows: int) -> Iterator[tuple[list, np.ndarray]]:
    """(ids, matrix) of each batch, one at a time: unique ids hashed into as
    many batches as the largest needs to fit (only counts are read first)."""
    dims, n = queries.agg(F.max(F.size(vec)), F.count(F.lit(1))).first()
    per = max(1, min(max_rows, MAX_QUERY_BYTES // (8 * max(1, dims or 1))))
    b = max(1, -(-n // per))
    while True:
        keyed = queries.withColumn("__qb", F.pmod(F.xxhash64(qid), F.lit(b)))
        sizes = {r[0]: r[1] for r in keyed.groupBy("__qb").count().collect()}
        if max(sizes.values(), default=0) <= per:
            break
        b *= 2
    for k in sorted(sizes):
        rows = keyed.filter(F.col("__qb") == k).select(qid, vec).collect()
        yield [r[0] for r in rows], np.array([r[1] for r in rows], dtype="float64")


def _finite(v) -> bool:
    """Whether a corpus row takes part. Tested here and not by a filter, which
    Spark would push below the spreading of the rows, deriving the vector once
    more in the few tasks of the scan."""
    return v is not None and None not in v and bool(np.isfinite(np.array(v, dtype="float64")).all())


class _Best:
    """The k best (distance, ids, payload) of each query so far."""

    def __init__(self, q: np.ndarray, k: int):
        self.q, self.k, self.q2 = q, k, (q * q).sum(1)
        self.kept: list[list[tuple]] = [[] for _ in q]
        self.last = np.full(len(q), np.inf)        # the k-th distance

    def add(self, v: np.ndarray, rows: list[tuple]) -> None:
        v2 = (v * v).sum(1)
        step = max(1, _BLOCK_ELEMS // max(1, len(v)))
        for lo in range(0, len(self.q), step):
            q2 = self.q2[lo:lo + step, None]
            about = q2 + v2[None, :] - 2.0 * (self.q[lo:lo + step] @ v.T)
            off = 1e-10 * (q2[:, 0] + v2.max(initial=0.0))       # more than the product's rounding
            within = np.minimum(self.last[lo:lo + step], np.partition(about, self.k - 1, axis=1)[:, self.k - 1]
                                if len(v) >= self.k else np.inf) + 2 * off
            for j in np.flatnonzero((about <= within[:, None]).any(1)):
                at = np.flatnonzero(about[j] <= within[j])
                exact = ((v[at] - self.q[lo + j]) ** 2).sum(1)
                best = heapq.nsmallest(self.k, self.kept[lo + j] + [(d, *rows[i]) for d, i in zip(exact.tolist(), at)],
                                       key=lambda r: r[:2])
                self.kept[lo + j] = best
                if len(best) == self.k:
                    self.last[lo + j] = best[-1][0]


def _scan(shared, k: int, ids: Sequence[str], vec: str, payload: Sequence[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, q = shared.value
        best = _Best(q, k)
        for pdf in batches:
            pdf = pdf[pdf[vec].map(_finite).astype(bool)]
            if len(pdf):
                keys = list(zip(*[pdf[c].tolist() for c in ids]))
                extra = list(zip(*[pdf[c].tolist() for c in payload])) if payload else [()] * len(pdf)
                best.add(np.array(pdf[vec].tolist(), dtype="float64"), list(zip(keys, extra)))
        out = [(name, *key, d, *extra) for name, rows in zip(names, best.kept) for d, key, extra in rows]
        if out:
            yield pd.DataFrame(out, columns=["qid", *ids, "dist", *payload])
    return run


def nearest(corpus: DataFrame, queries: DataFrame, k: int, corpus_id: str | Sequence[str], query_id: str,
            vec_col: str = "embedding", query_vec_col: str | None = None, payload: Sequence[str] = (),
            max_query_rows: int = MAX_QUERY_ROWS) -> DataFrame:
    """For every query, the k nearest corpus rows by squared L2
    (ascending, ties by the corpus id columns in order): (query_id, rank,
    *corpus id, dist, *payload). Vectors with a null, NaN or infinite number
    take no part on either side; query ids must be unique. ``payload``
    columns (e.g. the chunk text) travel with the candidates, so no second
    pass over the corpus fetches them. Fewer corpus rows than k give fewer
    ranks."""
    spark = corpus.sparkSession
    ids = [corpus_id] if isinstance(corpus_id, str) else list(corpus_id)
    qvec = query_vec_col or vec_col
    asked = finite_vectors(queries.select(query_id, qvec), qvec)
    assert_unique(asked, query_id)
    kind = lambda df, c: f"`{c}` {df.schema[c].dataType.simpleString()}"
    qtype = queries.schema[query_id].dataType.simpleString()
    schema = ", ".join([f"qid {qtype}", *[kind(corpus, c) for c in ids], "dist double", *[kind(corpus, c) for c in payload]])
    body = spread(corpus.select(*ids, vec_col, *payload))
    path = scratch_path(spark, "nearest")
    order = [F.col("dist"), *[F.col(f"`{c}`") for c in ids]]
    group = Window.partitionBy("qid", "__g").orderBy(*order)
    every = Window.partitionBy("qid").orderBy(*order)
    answer = spark.createDataFrame([], schema).withColumn("rank", F.lit(0))
    answer.write.parquet(path)
    for batch in query_batches(asked, query_id, qvec, max_query_rows):
        shared = spark.sparkContext.broadcast(batch)
        cand = body.mapInPandas(_scan(shared, k, ids, vec_col, list(payload)), schema)
        cand = cand.withColumn("__g", F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)))
        cand = cand.withColumn("__r", F.row_number().over(group)).filter(F.col("__r") <= k).drop("__g", "__r")
        cand.withColumn("rank", F.row_number().over(every)).filter(F.col("rank") <= k).write.mode("append").parquet(path)
        shared.destroy()
    top = spark.read.schema(answer.schema).parquet(path)
    return top.select(F.col("qid").alias(query_id), "rank", *ids, "dist", *payload)


def knn_vote(neighbours: DataFrame, query_id: str, label: str, weights: str = "uniform") -> DataFrame:
    """Label by neighbour vote; the label travels with the neighbours
    (``nearest(..., payload=[label])``). ``uniform`` counts votes, ``distance``
    weights by 1/dist (an exact match takes the vote alone). Ties go to the
    smallest label."""
    j = neighbours
    if weights == "distance":
        has0 = F.max((F.col("dist") == 0).cast("int")).over(Window.partitionBy(query_id))
        w = F.when(has0 == 1, F.when(F.col("dist") == 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(F.lit(1.0) / F.col("dist"))
    else:
        w = F.lit(1.0)
    votes = j.withColumn("__w", w).groupBy(query_id, label).agg(F.sum("__w").alias("votes"))
    best = Window.partitionBy(query_id).orderBy(F.desc("votes"), F.asc(label))
    return (votes.withColumn("__r", F.row_number().over(best)).filter("__r = 1")
                 .select(query_id, F.col(label).alias("predicted"), "votes"))


# The two prompt templates (with and without retrieved context).
PROMPT_WITH_CONTEXT = ("You are an expert in {domain}. Use the following context to answer the question "
                       "accurately and concisely.\n\nContext:\n{context}\n\nQuestion: {question}\n\n"
                       "Answer (be specific and cite relevant data from the context):")
PROMPT_NO_CONTEXT = ("You are an expert in {domain}. Answer the following question accurately and concisely."
                     "\n\nQuestion: {question}\n\nAnswer:")


def _template(t: str, domain: str) -> str:
    return t.replace("{domain}", domain).replace("%", "%%").replace("{context}", "%1$s").replace("{question}", "%2$s")


def assemble_context(hits: DataFrame, query_id: str, text_col: str = "text", extra_cols: Sequence[str] = ()) -> DataFrame:
    """Per query, the context string ``[Document i]:\\n<text>``
    joined by blank lines in rank order, the number of sources and the
    sources (text cut to 500 chars + '...', score, extra columns). The text
    travels with the hits."""
    j = hits
    item = F.struct(F.col("rank"), F.col(text_col).alias("text"), F.col("dist").alias("score"), *[F.col(c) for c in extra_cols])
    g = j.groupBy(query_id).agg(F.array_sort(F.collect_list(item)).alias("__items"))
    ctx = F.array_join(F.transform("__items", lambda s: F.concat(F.lit("[Document "), s["rank"].cast("string"),
                                                                 F.lit("]:\n"), s["text"])), "\n\n")
    src = F.transform("__items", lambda s: F.struct(truncate_text(s["text"], 500).alias("text"), s["score"].alias("score"),
                                                     *[s[c].alias(c) for c in extra_cols]))
    return g.select(query_id, F.size("__items").alias("num_sources"), ctx.alias("context"), src.alias("sources"))


def build_prompts(questions: DataFrame, contexts: DataFrame, query_id: str, question_col: str,
                  domain: str = "the subject of the corpus") -> DataFrame:
    """Prompt text per question; questions without retrieved context
    (left join miss or empty context) get the no-context template."""
    j = questions.join(contexts, query_id, "left")
    has = F.col("context").isNotNull() & (F.length("context") > 0)
    with_ctx = F.format_string(_template(PROMPT_WITH_CONTEXT, domain), F.col("context"), F.col(question_col))
    no_ctx = F.format_string(_template(PROMPT_NO_CONTEXT, domain).replace("%2$s", "%1$s"), F.col(question_col))
    return j.withColumn("prompt", F.when(has, with_ctx).otherwise(no_ctx)).withColumn(
        "num_sources", F.coalesce(F.col("num_sources"), F.lit(0)))

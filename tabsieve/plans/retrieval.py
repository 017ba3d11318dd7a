"""Retrieval composites: nearest vectors to class centroids (T12), kNN vote
(M18) and question answering context + prompts (T11, T13, T14, T18)."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import round_half_up, truncate_text
from ..functions.text import letter_counts
from ..operators.partitioning import spread
from ..operators import ivf as I
from ..operators import retrieve as R
from ..operators import sparse as SP
from ..sources.tables import Tables
from . import corpus as K

TOP_K = 5


def centroids(emb: DataFrame, label: str = "label", vec: str = "embedding") -> DataFrame:
    """Per-class mean vector: one vector-valued aggregate (no explode)."""
    g = emb.groupBy(label).agg(Summarizer.mean(array_to_vector(F.col(vec))).alias("__m"))
    return g.select(label, vector_to_array("__m").alias("centroid"))


def nearest_centroids(t: Tables) -> DataFrame:
    emb = t.embeddings
    hits = R.nearest(emb, centroids(emb), TOP_K, "vec_id", "label", vec_col="embedding", query_vec_col="centroid")
    return hits.select("label", "rank", "vec_id", round_half_up("dist", 6).alias("dist"))


def labelled_documents(t: Tables) -> DataFrame:
    # the embedding is per-row CPU work over whole texts: spread narrow scans
    d = spread(t.documents).join(t.labels.select("doc_id", "quality"), "doc_id")
    return d.select("doc_id", "quality", letter_counts("text").alias("embedding"))


def benchmark_queries(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", "text", letter_counts("text").alias("embedding"))


def knn_quality(t: Tables) -> DataFrame:
    docs = labelled_documents(t)
    # the label travels with the candidates: no join back to the documents
    hits = R.nearest(docs, benchmark_queries(t), TOP_K, "doc_id", "item_id", payload=["quality"])
    return R.knn_vote(hits, "item_id", "quality", weights="uniform").select("item_id", "predicted", "votes")


def knn_distance(t: Tables) -> DataFrame:
    """M18 with distance weights: the class of every embedding whose id is
    divisible by 20, from its nearest others in the whole table."""
    return _vote_of_others(t.embeddings, t.embeddings.filter("vec_id % 20 = 0"))


def knn_distance_all(t: Tables) -> DataFrame:
    """M18 with distance weights over the whole table: the class of every
    embedding from its nearest others."""
    return _vote_of_others(t.embeddings, t.embeddings)


def _vote_of_others(emb: DataFrame, asked: DataFrame) -> DataFrame:
    # one more than asked for, as a row may find itself
    hits = R.nearest(emb, asked.select(F.col("vec_id").alias("qid"), "embedding"), TOP_K + 1, "vec_id", "qid", payload=["label"])
    place = Window.partitionBy("qid").orderBy("rank")
    others = hits.filter("vec_id != qid").withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= TOP_K)
    v = R.knn_vote(others, "qid", "label", weights="distance")
    return v.select("qid", "predicted", round_half_up("votes", 6).alias("votes"))


def knn_indexed(t: Tables) -> DataFrame:
    """M18 through inverted lists: the class of every embedding whose id is
    divisible by 20 from its nearest others in the whole table."""
    emb = t.embeddings
    index = I.build(emb, "vec_id", "embedding", payload=("label",))
    asked = emb.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    hits = I.search(index, asked, TOP_K + 1, "qid", "embedding", payload=("label",)).filter("vec_id != qid")
    v = R.knn_vote(hits.filter(F.col("rank") <= TOP_K + 1), "qid", "label", weights="distance")
    return v.select("qid", "predicted", round_half_up("votes", 6).alias("votes"))


def sparse_context(t: Tables) -> DataFrame:
    """T11 and T12 with hashed TF-IDF vectors: the chunks closest to every
    benchmark item."""
    chunks = K.chunks(t).select("doc_id", "chunk_index", "text")
    return SP.retrieve(chunks, t.benchmark.select("item_id", "text"), TOP_K, ["doc_id", "chunk_index"], "item_id", digits=6)


def sparse_documents(t: Tables) -> DataFrame:
    """The same over whole documents."""
    return SP.retrieve(t.documents.select("doc_id", "text"), t.benchmark.select("item_id", "text"), TOP_K, ["doc_id"], "item_id", digits=6)


def chunk_corpus(t: Tables) -> DataFrame:
    ch = K.chunks(t)
    return ch.select("doc_id", "chunk_index", "text", letter_counts("text").alias("embedding"))


def rag_context(t: Tables) -> DataFrame:
    corpus = chunk_corpus(t)
    qs = benchmark_queries(t)
    hits = R.nearest(corpus, qs, TOP_K, ["doc_id", "chunk_index"], "item_id", payload=["text"])
    ctx = R.assemble_context(hits, "item_id", "text")
    p = R.build_prompts(qs.select("item_id", F.col("text").alias("question")), ctx, "item_id", "question")
    return p.select("item_id", "num_sources", "context", "prompt",
                    F.col("sources")[0]["text"].alias("top_source"),
                    round_half_up(F.col("sources")[0]["score"], 6).alias("top_score"))

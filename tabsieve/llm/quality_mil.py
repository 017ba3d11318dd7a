"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage of every
text is encoded (hashed character trigrams and a few counts of its letters
and repeats, then a learned layer); gated attention weighs the passages, and
a logistic layer scores the weighted sum:

    h = tanh(W x + b);  a = softmax(w . (tanh(V h) * sigmoid(U h)))
    score = sigmoid(c . sum(a h) + d)

Only documents have labels: the passage weights are learned with the rest,
by Adam on the log loss of whole documents. The fit uses at most ``TRAIN``
labelled documents, taken by a hash of the id, with at most
``TRAIN_PASSAGES`` evenly spaced passages each; scoring uses all passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import bounded_broadcast
from .common import checkpointed, doc_id_text, held_out, written
from .words import runs, text_bytes, word_hashes, words

PASSAGE = 64            # words
BITS = 8                # trigrams are hashed to 2 ** BITS counters
TRAIN = 4000            # labelled documents of the fit
TRAIN_PASSAGES = 200_000  # of all of them together (about 110 MB); documents beyond are left out whole
HIDDEN, GATE = 32, 16
ROUNDS, BATCH, RATE, DECAY = 20, 64, 3e-3, 1e-4
SEED = 3
CUT = 0.7               # predicted 1 at and above this score
BLOCK_BYTES = 1 << 19

D = 1 << BITS
_KIND = np.zeros(256, np.int64)                    # of each byte: what is counted
_KIND[ord("a"):ord("z") + 1] = 1
_KIND[ord("A"):ord("Z") + 1] = 2
_KIND[ord("0"):ord("9") + 1] = 3
_KIND[[0x20, 0x09, 0x0B, 0x0C]] = 4
_KIND[[0x0A, 0x0D]] = 5
_KIND[[ord(c) for c in ".,;:'\"?"]] = 6
_KIND[ord("!")] = 7
_KIND[[ord(c) for c in "|-_=<>/\\"]] = 8
_KIND[0x80:] = 9
KINDS = 10                                          # 0: other signs
WIDTH = D + KINDS + 4


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x, first): the passages of text i are rows first[i] to first[i + 1] - 1.

    Of each passage: shares of its trigrams by counter, shares of its bytes
    by kind, and the shares of words equal to the word before, to one of the
    four before, of words with an upper-case second byte, and the mean word
    length over 16."""
    start, end, word_first = words(data, offsets)
    n = np.diff(word_first)
    first = np.concatenate([[0], np.cumsum(-(-n // PASSAGE))])
    rows = int(first[-1])
    x = np.zeros((rows, WIDTH), np.float32)
    if not rows:
        return x, first
    doc = np.repeat(np.arange(len(n)), n)
    at = first[doc] + (np.arange(len(start)) - word_first[doc]) // PASSAGE           # passage of each word
    lo = start[np.searchsorted(at, np.arange(rows))]
    of = np.searchsorted(lo, np.arange(len(data)), "right") - 1                      # passage of each byte
    of = np.maximum(of, 0)
    code = data.astype(np.uint32)
    code = (code[:-2] << 16) | (code[1:-1] << 8) | code[2:]
    slot = ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)
    x[:, :D] = np.sqrt(np.bincount(of[1:-1] * D + slot, minlength=rows * D).reshape(rows, D))
    x[:, :D] /= np.maximum(np.linalg.norm(x[:, :D], axis=1, keepdims=True), 1)
    kinds = np.bincount(of * KINDS + _KIND[data], minlength=rows * KINDS).reshape(rows, KINDS)
    x[:, D:D + KINDS] = kinds / np.maximum(kinds.sum(1, keepdims=True), 1)
    h, many = word_hashes(data, start, end), np.bincount(at, minlength=rows)
    again = [np.concatenate([np.zeros(k, bool), (h[k:] == h[:-k]) & (doc[k:] == doc[:-k])]) if len(h) > k else np.zeros(len(h), bool)
             for k in range(1, 5)]
    second = _KIND[data[np.minimum(start + 1, len(data) - 1)]] == 2
    for i, v in enumerate((again[0], np.any(again, axis=0), second, (end - start) / 16)):
        x[:, D + KINDS + i] = np.bincount(at, v, rows) / many
    return x, first


def bags(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, x, first) for runs of texts."""
    data, offsets = text_bytes(column)
    for i, j in runs(offsets, BLOCK_BYTES):
        lo, hi = int(offsets[i]), int(offsets[j])
        yield i, *features(data[lo:hi], offsets[i:j + 1] - lo)


def _softmax(s: np.ndarray, first: np.ndarray, of: np.ndarray) -> np.ndarray:
    e = np.exp(s - np.maximum.reduceat(s, first[:-1])[of])
    return e / np.add.reduceat(e, first[:-1])[of]


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


class Model:
    """The encoder, the attention and the classifier: ``p`` by name, and the
    mean and scale of the features."""

    def __init__(self, rng: np.random.Generator, mean: np.ndarray, scale: np.ndarray, prior: float):
        def draw(*shape):
            return rng.normal(0, shape[-1] ** -0.5, shape).astype(np.float32)

        self.mean, self.scale = mean, scale
        self.p = {"W": draw(HIDDEN, WIDTH), "b": np.zeros(HIDDEN, np.float32), "V": draw(GATE, HIDDEN), "U": draw(GATE, HIDDEN),
                  "w": draw(GATE), "c": draw(HIDDEN), "d": np.array(np.log(prior / (1 - prior)), np.float32)}

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict:
        """Of bags with at least one passage each."""
        p, of = self.p, np.repeat(np.arange(len(first) - 1), np.diff(first))
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["W"].T + p["b"])
        t, g = np.tanh(h @ p["V"].T), _sigmoid(h @ p["U"].T)
        a = _softmax((t * g) @ p["w"], first, of)
        z = np.add.reduceat(a[:, None] * h, first[:-1])
        return {"x": x, "of": of, "h": h, "t": t, "g": g, "a": a, "z": z, "y": _sigmoid(z @ p["c"] + p["d"])}

    def gradients(self, f: dict, first: np.ndarray, y: np.ndarray) -> dict:
        p, of = self.p, f["of"]
        e = (f["y"] - y) / len(y)
        dz = e[:, None] * p["c"]
        along = (dz[of] * f["h"]).sum(1)
        ds = f["a"] * (along - np.add.reduceat(f["a"] * along, first[:-1])[of])
        dt, dg = ds[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2), ds[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dz[of] + dt @ p["V"] + dg @ p["U"]) * (1 - f["h"] ** 2)
        return {"W": dh.T @ f["x"], "b": dh.sum(0), "V": dt.T @ f["h"], "U": dg.T @ f["h"], "w": (f["t"] * f["g"]).T @ ds,
                "c": f["z"].T @ e, "d": e.sum()}

    def scores(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The score of every bag; one without passages has the sum 0."""
        out = np.full(len(first) - 1, float(_sigmoid(np.asarray(self.p["d"], float))))
        filled = np.diff(first) > 0
        if filled.any():
            out[filled] = self.forward(x, np.append(first[:-1][filled], first[-1]))["y"]
        return out


def train(x: list[np.ndarray], y: np.ndarray, seed: int = SEED) -> Model:
    """Fits bags of passages (at least one each) to labels 0 and 1."""
    rng = np.random.default_rng(seed)
    every = np.concatenate(x)
    model = Model(rng, every.mean(0), np.maximum(every.std(0), 1e-3), (y.sum() + 1) / (len(y) + 2))
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(w) for k, w in model.p.items()}
    step = 0
    for _ in range(ROUNDS):
        order = rng.permutation(len(y))
        for i in range(0, len(y), BATCH):
            of = order[i:i + BATCH]
            first = np.concatenate([[0], np.cumsum([len(x[k]) for k in of])])
            g = model.gradients(model.forward(np.concatenate([x[k] for k in of]), first), first, y[of])
            step += 1
            for k in model.p:
                d = g[k] + DECAY * model.p[k]
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                model.p[k] = (model.p[k] - RATE * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN, label_col: str = "quality") -> Model | None:
    """A model from ``labels`` (doc_id, quality) and the texts of those
    documents, or None if no text has a label. A document with several
    labels takes their mean, at least 1/2 as 1; null labels are left out. Of
    several texts under one id one is used, always the same. The sample is
    the first documents by a hash of the id, at most ``most`` and at most
    ``TRAIN_PASSAGES`` passages together; each is learned from whole."""
    order = F.xxhash64(F.lit(SEED), doc_id_text(F.col("doc_id")))
    some = checkpointed(labels.filter(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        (F.avg(label_col) >= 0.5).cast("int").alias("__y")).orderBy(order, "doc_id").limit(most))
    texts = docs.select("doc_id", "text").join(bounded_broadcast(some), "doc_id").select("doc_id", "text", "__y")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x, first in bags(batch.column(1)):
                out = [x[lo:hi].astype(np.float16).tobytes() for lo, hi in zip(first, first[1:])]
                n = len(out)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), pa.array(out, pa.binary()), batch.column(2).slice(i, n)],
                                                 ["doc_id", "x", "y"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    encoded = written(texts.mapInArrow(encode, f"doc_id {kind}, x binary, y int").groupBy("doc_id").agg(
        F.min("x").alias("x"), F.min("y").alias("y")).filter(F.octet_length("x") > 0), "bags")
    size = encoded.select("doc_id", order.alias("at"), F.octet_length("x").alias("bytes")).orderBy("at", "doc_id").limit(most).collect()
    held = np.cumsum([r.bytes for r in size]) <= TRAIN_PASSAGES * WIDTH * 2
    last = max((r["at"] for r, ok in zip(size, held) if ok), default=None)
    rows = encoded.filter(order <= F.lit(last)).orderBy("doc_id").collect() if last is not None else []
    if not rows:
        return None
    return train([np.frombuffer(r.x, np.float16).reshape(-1, WIDTH).astype(np.float32) for r in rows], np.array([r.y for r in rows], float))


def training_labels(labels: DataFrame) -> DataFrame:
    """The labels that may be learned from."""
    return labels.filter(~held_out(F.col("doc_id")))


def score_quality(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """One row per input row: doc_id, score (0 to 1), predicted (1 at or
    above ``cut``), n_passages.

    Null and empty texts are bags without passages, scored by the classifier's
    bias alone; without any label every score is 0.5. Repeated rows are scored
    each; a null id stays null. Extra columns are not read; an empty table
    gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)       # about 10,000 floats
    kind = docs.schema[id_col].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x, first in bags(batch.column(1)):
                n = len(first) - 1
                s = shared.value.scores(x, first) if shared.value else np.full(n, 0.5)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, n), pa.array(s.astype(float)), pa.array((s >= cut).astype(np.int32)), pa.array(np.diff(first))],
                    ["doc_id", "score", "predicted", "n_passages"])

    return docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(
        predict, f"doc_id {kind}, score double, predicted int, n_passages long")

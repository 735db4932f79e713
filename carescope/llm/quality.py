"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Words. A text's units between blanks are cut into runs of letters (lower-cased, with one more
token for their case), digits and marks; a unit that repeats the one before it adds a token for
that. Each token falls into one of ``BUCKETS`` by its crc32.
Every bucket has an index vector with a few +1 and -1 at places drawn from a seed. A bucket's
context vector is the sum of the index vectors of its neighbours within ``WINDOW`` tokens, over
the fit sample. A document's features are the means of its tokens' index vectors and of their
unit-length context vectors.

Network. One hidden layer of tanh units and one logistic output, trained in numpy on the driver by
Adam on the fit sample: the ``FIT_DOCS`` labelled documents of least id hash that the fold rule
allows (the documented bound of the sample). A part of them is set aside; on it the temperature
that divides the logit is chosen by least log loss. Scores cover all documents, whole.

Cases: a null or empty text has the zero vector and the network's score for it; null labels are
not learned from, repeated labels of an id count as their mean, rounded; without labels every
score is 0.5; repeated rows repeat, an empty table gives an empty one. Labels, language, source
and id are never inputs of a score; other columns do not matter, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carescope.llm.common import Kept, cut_lineage, id_fold, resident, whole_text

FIT_DOCS = 12_000          # bound of the labelled sample that the classifier is fitted on
BUCKETS, DIM, NONZERO, WINDOW = 1 << 14, 32, 4, 2
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 24, 60, 128, 0.01, 1e-4, 7
UNITS = 300_000            # tokens of text units kept in a worker, in each of two generations
RUN = 1 << 16              # tokens pooled at once
FIT_TASKS = 8
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")

REPEAT = np.array([zlib.crc32(b"repeat") % BUCKETS], dtype="<u2").tobytes()


def tokens(unit: str) -> bytes:
    """Buckets of a unit's tokens, as little-endian unsigned 16-bit integers."""
    out = []
    for token in TOKEN.findall(unit):
        if token[0].isalpha():
            case = "upper" if token.isupper() and len(token) > 1 else "lower" if token.islower() else "title" if token.istitle() else "mixed"
            out += [f"case {case}", f"word {token.lower()}"]
        else:
            out.append("digits" if token.isdigit() else f"marks {token[:8]}")
    return np.array([zlib.crc32(t.encode("utf-8")) % BUCKETS for t in out], dtype="<u2").tobytes()


def token_runs(text: str) -> Iterator[np.ndarray]:
    kept, units = resident("quality", lambda: Kept(tokens, UNITS)), text.split()
    for k in range(0, len(units), RUN):
        run = units[k:k + RUN]
        repeats = sum(map(eq, run, run[1:]))
        yield np.frombuffer(b"".join(kept.many(run)) + REPEAT * repeats, dtype="<u2")


def index_vectors() -> np.ndarray:
    """BUCKETS x DIM, each row with NONZERO entries of +1 or -1."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((BUCKETS, DIM), dtype=np.int32)
    places = np.argsort(rng.random((BUCKETS, DIM)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, places, rng.integers(0, 2, (BUCKETS, NONZERO)).astype(np.int32) * 2 - 1, axis=1)
    return out


def add_contexts(sums: np.ndarray, ids: np.ndarray, index: np.ndarray) -> None:
    """Add to each token's row the index vectors of its neighbours."""
    if len(ids) < 2:
        return
    near = np.zeros((len(ids), DIM), dtype=np.int32)
    own = index[ids]
    for k in range(1, min(WINDOW, len(ids) - 1) + 1):
        near[k:] += own[:-k]
        near[:-k] += own[k:]
    order = np.argsort(ids, kind="stable")
    which, first = np.unique(ids[order], return_index=True)
    sums[which] += np.add.reduceat(near[order], first, axis=0)


class Model(NamedTuple):
    vectors: np.ndarray       # BUCKETS x 2 DIM: index vectors and unit-length context vectors
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def features(self, text: str) -> np.ndarray:
        return pooled(text, self.vectors)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        hidden = np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1)
        return 1 / (1 + np.exp(-np.clip((hidden @ self.w2 + self.b2) / self.temperature, -500, 500)))


def pooled(text: str, vectors: np.ndarray) -> np.ndarray:
    total, n = np.zeros(vectors.shape[1]), 0
    for ids in token_runs(text):
        total += vectors[ids].sum(axis=0, dtype=np.float64)
        n += len(ids)
    return total / max(n, 1)


def word_vectors(sums: np.ndarray) -> np.ndarray:
    index = index_vectors().astype(np.float32)
    contexts = sums.astype(np.float32)
    contexts /= np.maximum(np.linalg.norm(contexts, axis=1, keepdims=True), 1e-9)
    return np.hstack((index, contexts))


def train(vectors: np.ndarray, x: np.ndarray, y: np.ndarray, aside: np.ndarray) -> Model:
    """Fit the network on the rows not set aside and the temperature on those that are."""
    rng = np.random.default_rng(SEED)
    inner = ~aside if (~aside).any() else np.ones(len(y), dtype=bool)
    width = vectors.shape[1]
    mean = x[inner].mean(axis=0) if inner.any() else np.zeros(width)
    scale = np.maximum(x[inner].std(axis=0), 1e-6) if inner.any() else np.ones(width)
    params = [rng.normal(0, 1 / np.sqrt(width), (width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    z, t, step = (x[inner] - mean) / scale, y[inner], 0
    if len(t):
        params[2] = rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN)
    for _ in range(EPOCHS):
        order = rng.permutation(len(t))
        for k in range(0, len(t), BATCH):
            rows = order[k:k + BATCH]
            w1, b1, w2, b2 = params
            hidden = np.tanh(z[rows] @ w1 + b1)
            error = (1 / (1 + np.exp(-np.clip(hidden @ w2 + b2, -500, 500))) - t[rows]) / len(rows)
            back = np.outer(error, w2) * (1 - hidden ** 2)
            grads = [z[rows].T @ back + DECAY * w1, back.sum(axis=0), hidden.T @ error + DECAY * w2, np.array([error.sum()])]
            step += 1
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    w1, b1, w2, b2 = params
    held = aside if aside.any() else inner
    temperature = 1.0
    if held.any():
        logit = np.tanh((x[held] - mean) / scale @ w1 + b1) @ w2 + b2

        def loss(at: float) -> float:
            s = logit / at
            return float(np.mean(np.logaddexp(0, s) - y[held] * s))
        temperature = min(np.geomspace(0.25, 8, 61), key=loss)
    return Model(vectors.astype(np.float32), mean, scale, w1, b1, w2, float(b2[0]), float(temperature))


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality") -> Model:
    """Fit on the bounded sample of labelled rows whose id fold is not 0."""
    ids = F.col(id_col).cast("long")
    known = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (id_fold(id_col) != 0))
             .groupBy(ids.alias("id")).agg(F.round(F.avg(label_col)).cast("double").alias("y"))
             .orderBy(F.xxhash64("id"), "id").limit(fit_docs))
    texts = docs.select(ids.alias("id"), whole_text(text_col).alias("text"))
    # the sample has at most fit_docs rows of 16 bytes: safe to broadcast; of rows that repeat an id, the
    # least text is fitted on (taken in every task before the shuffle), so the fit has at most fit_docs rows
    one = texts.join(F.broadcast(known), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    sample = cut_lineage(one.repartition(FIT_TASKS, "id"))

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, index = np.zeros((BUCKETS, DIM), dtype=np.int64), index_vectors()
        for batch in batches:
            for text in batch["text"]:
                for run in token_runs(text):
                    add_contexts(sums, run, index)
        yield pd.DataFrame({"sums": [sums.tobytes()]})

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "y": batch["y"],
                                "x": [pooled(t, vectors).tobytes() for t in batch["text"]]})

    sums = np.zeros((BUCKETS, DIM), dtype=np.int64)
    for row in sample.select("text").mapInPandas(contexts, "sums binary").toLocalIterator():   # one row a fit task
        sums += np.frombuffer(row["sums"], dtype=np.int64).reshape(BUCKETS, DIM)
    vectors = word_vectors(sums)
    rows = sorted(sample.mapInPandas(features, "id bigint, y double, x binary").collect(),   # at most fit_docs ids
                  key=lambda r: (r["id"], bytes(r["x"])))
    x = np.array([np.frombuffer(r["x"]) for r in rows]).reshape(len(rows), vectors.shape[1])
    y = np.array([r["y"] for r in rows])
    aside = np.array([zlib.crc32(str(r["id"]).encode()) % 5 == 1 for r in rows], dtype=bool)
    return train(vectors, x, y, aside)


def score_column(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """The probability of label 1, from the whole text alone."""
    held = docs.sparkSession.sparkContext.broadcast(tuple(model))    # BUCKETS x 2 DIM floats: 4 MB at any input size

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(*held.value)
        for batch in texts:
            x = np.array([own.features(t) for t in batch]).reshape(len(batch), own.vectors.shape[1])
            yield pd.Series(own.scores(x))
    # pandas_udf reads the kind of function from its annotations
    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")(whole_text(text_col))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """doc_id, held_out (the fold that nothing is learned from), score, predicted."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), (id_fold(id_col) == 0).alias("held_out"),
                         score_column(docs, model, text_col).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """The documents that are not rejected (score at least ``threshold``), with all their columns."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    return docs.where(score_column(docs, model, text_col) >= threshold)

"""Language-model scores and the quality classifier: brute force, normalisation, held-out results."""

import zlib
from collections import Counter
from math import log10

import numpy as np
from data import SF, awkward, empty

from carescope.llm import lm, quality
from carescope.llm.queries import QUERIES

SF01 = "/root/testdata/sf0.01"


def fold(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5


def brute(docs):
    """(n_tokens, n_known, train_tokens, base_score) of each (id, text)."""
    tokens = [(t or "").encode().lower().split() + [b"\n"] for _, t in docs]
    c = Counter(w for (i, _), ts in zip(docs, tokens) if fold(i) != 1 for w in ts)
    n, v = sum(c.values()), len(c)
    z = log10(n + 0.5 * (v + 1))
    return [(len(ts), sum(c[w] > 0 for w in ts), n, sum(log10(c[w] + 0.5) - z for w in ts)) for ts in tokens]


def compare(rows, docs):
    want = sorted(zip(docs, brute(docs)), key=lambda x: (x[0][0] is None, x[0][0] or 0, x[1]))
    got = sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["base_score"]))
    assert len(got) == len(want)
    for r, ((doc_id, _), (tokens, known, n, base)) in zip(got, want):
        assert (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (doc_id, fold(doc_id) == 1, tokens, known, n)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base))
        assert r["score"] <= 0


def test_scores_of_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text").collect()]
    rows = QUERIES["op4_lm_scores"](spark, SF01).collect()
    compare(rows, docs)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.98 * sum(r["base_score"] for r in held)      # both negative


def test_model_is_normalised():
    triples = np.zeros(lm.CLASSES ** 3)
    triples[:5000] = 3
    table = lm.train(triples, steps=50)
    assert np.allclose((10.0 ** table).sum(axis=1), 1)


def test_rare_words_meet_their_counts_in_the_join(spark, monkeypatch):
    monkeypatch.setattr(lm, "KNOWN", 100)
    monkeypatch.setattr(lm, "STEPS", 20)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    compare(lm.score_documents(docs).collect(), [tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_lm_awkward_rows(spark):
    docs = awkward(spark)
    compare(lm.score_documents(docs).collect(), [tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert lm.score_documents(empty(spark)).count() == 0


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op10_quality"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (fold(r["doc_id"]) == 0) and 0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.97


def test_quality_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (3, 0, 0), (5, None, None), (None, 1, 1), (8, 0, 1), (7, 1, 0)],
                                   "doc_id bigint, quality int, toxic int")
    rows = quality.score_documents(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    same = {r["score"] for r in rows if r["doc_id"] in (1, 2)}
    assert len(same) == 1
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in rows)
    nothing = quality.score_documents(docs, labels.limit(0)).collect()
    assert {r["score"] for r in nothing} == {0.5}
    assert quality.score_documents(empty(spark), labels).count() == 0


def test_quality_is_the_same_again(spark):
    a = {r["doc_id"]: r["score"] for r in QUERIES["op10_quality"](spark, SF).collect()}
    assert a == {r["doc_id"]: r["score"] for r in QUERIES["op10_quality"](spark, SF).collect()}


def test_fit_is_bounded_by_rows_also_where_ids_repeat(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "train", lambda vectors, x, y, aside: seen.append(len(x)) or "model")
    docs = spark.range(3000).selectExpr("cast(id % 3 * 7 as bigint) as doc_id", "concat('text number ', id) as text")
    labels = spark.createDataFrame([(0, 1), (7, 0), (14, 1)], "doc_id bigint, quality int")
    assert quality.fit(docs, labels, fit_docs=4) == "model" and len(seen) == 1 and seen[0] <= 3


def test_training_draws_nothing_but_its_first_vectors(monkeypatch):
    class FirstVectors:
        normal = staticmethod(np.random.default_rng(3).normal)
    monkeypatch.setattr(np.random, "default_rng", lambda seed: FirstVectors())
    triples = np.zeros((lm.CLASSES,) * 3)
    triples[1:4, 1:4, 1], triples[1:4, 1:4, 2] = 30, 10
    table = 10.0 ** lm.train(triples.ravel()).reshape(triples.shape)
    assert np.allclose(table[1:4, 1:4, 1] / table[1:4, 1:4, 2], 3, rtol=0.1)

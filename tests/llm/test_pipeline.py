"""The pipeline against its parts by brute force."""

import hashlib

import public_tokenizers as P
import tiktoken
from data import SF, awkward, components, empty, simhash

import corpus_pipeline
from carescope.llm import byte_bpe, decontam
from carescope.llm.queries import QUERIES


def test_run(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    good = sorted(r["doc_id"] for r in QUERIES["op10_quality"](spark, SF).collect() if r["predicted"] == 1)
    group, first = components([simhash(docs[i]) for i in good]), {}
    for i, g in zip(good, group):
        first.setdefault(g, i)
    items = [f" {' '.join(decontam.words(r['text']))} " for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [i for i in first.values() if not any(w in f" {' '.join(decontam.words(docs[i]))} " for w in items)]
    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert sorted(got) == sorted(clean)
    for i, r in got.items():
        assert r["n_tokens"] == len(tik.encode_ordinary(docs[i]))
        assert r["decoded_sha256"] == hashlib.sha256(docs[i].encode()).hexdigest()


def test_stages_keep_columns_and_take_awkward_rows(spark):
    for docs in (awkward(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.schema == docs.schema
            assert out.count() <= docs.count()

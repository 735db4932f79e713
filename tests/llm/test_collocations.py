"""Phrase collocations: the trie and the whole operator against plain counting, SQL twin, awkward rows."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from data import SF, awkward, empty, rows_of

from carescope.llm import collocations as C
from carescope.llm.queries import QUERIES, SQL


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def expected(rows, least, top=2000):
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            total[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in cands.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i:i + m]] = max(inside[p[i:i + m]], a)
        best = []
        for p, a in cands.items():
            if 100 * inside[p] >= 100 * a:
                continue
            s, k = min((1000 * a * total[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            best.append((-s, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, phrase, l, r) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("held,burst,collide", [(C.HELD, C.BURST, False), (300, 20, False), (300, 20, True)])
def test_trie_counts_and_spills(monkeypatch, held, burst, collide):
    monkeypatch.setattr(C, "BURST", burst)
    if collide:      # phrases that share a key stay apart
        real = C.container_key
        monkeypatch.setattr(C, "container_key", lambda w: real(w) & np.uint64(0xFF03 << 48))
    rng, trie, want, runs = np.random.default_rng(1), C.HatTrie(3, held), Counter(), []
    for _ in range(30):
        rows = rng.zipf(1.5, (400, 3)).clip(0, 30).astype(np.int64)
        want.update(map(tuple, rows.tolist()))
        runs += trie.add(rows)
        assert trie.root.size() <= held
    runs += trie.spill()
    got = Counter()
    for keys, words, counts in runs:
        assert (keys[1:] >= keys[:-1]).all()
        for row, n in zip(words.tolist(), counts.tolist()):
            got[tuple(row)] += n
    assert got == want


def documents(spark, seed=3, n=400):
    rng = np.random.default_rng(seed)
    words = ["the", "new", "york", "City", "of", "é", "漢字", "a.b", "x,y", "san", "francisco\tbay", "!"]
    rows = [(k, " ".join(rng.choice(words, rng.integers(0, 30))) + (" san francisco bay area" if k % 3 == 0 else ""),
             [None, "en", "fr"][k % 3]) for k in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


@pytest.mark.parametrize("ranked", [C.RANKED, 0])
def test_against_plain_counting(spark, monkeypatch, ranked):
    monkeypatch.setattr(C, "RANKED", ranked)            # ids by rank, and by hash
    docs = documents(spark)
    want = expected([(r.lang, r.text) for r in docs.collect()], 8)
    assert len(want) > 50 and rows_of(C.collocations(docs, least=8)) == want
    assert rows_of(C.collocations(docs, least=8, top=5, salts=2)) == [r for r in want if r[1] <= 5]


def test_slices_and_spills_change_nothing(spark, monkeypatch):
    docs = documents(spark, 4)
    stream_row, (ids, own) = [], (np.arange(1, 40), 10)
    for length in range(2, 6):
        whole = C.phrases_in(ids, len(ids), length, None).tolist()
        for a in range(0, len(ids), own):
            stream_row += C.phrases_in(ids[a:a + own + 4], min(own, len(ids) - a), length, None).tolist()
        assert stream_row == whole
        stream_row = []
    text = "new york, " * 50 + "x" * 300 + " end"
    monkeypatch.setattr(C, "BYTES", 64)
    assert [t for some in C.tokens(text.encode()) for t in some] == text.encode().replace(b",", b" \xff ").split()
    assert docs.count() == 400


def test_ids_of_equal_hash_get_another_seed(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b a b a b", "en")], "doc_id bigint, text string, lang string")
    asked = []

    def clash(docs_, seed, real=C.word_counts):
        asked.append(seed)
        out = real(docs_, seed)
        return out.withColumn("id", C.F.lit(5).cast("long")) if seed == 0 else out
    monkeypatch.setattr(C, "word_counts", clash)
    assert rows_of(C.collocations(docs, least=2)) == expected([("en", "a b a b a b")], 2) and asked == [0, 1]


def test_scores_are_exact_beyond_64_bits(spark):
    a, n, l, r = 9_999_999_999_999, 999_999_999_999_999_999, 10 ** 13 + 7, 10 ** 15 + 3
    rows = [("en", [1, 2], a), ("en", [1], l), ("en", [2], r)]
    got, = C.score_cuts(spark.createDataFrame(rows, C.PHRASES), spark.createDataFrame([("en", n)], "lang string, n bigint")).collect()
    assert got.score == 1000 * a * n // (l * r)


def test_query_and_sql_twin(spark):
    d = "/root/testdata/sf0.01"
    got = rows_of(QUERIES["op12_collocations"](spark, d))
    assert got == expected([(r.lang, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()], 100)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet'")
    assert sorted(con.execute(SQL["op12_collocations"]).fetchall()) == got


def test_awkward_rows(spark):
    docs = awkward(spark)
    want = expected([(r.lang, r.text) for r in docs.collect()], 2)
    extra = docs.withColumnsRenamed({"row": "words", "fp": "word", "n_tokens": "n"})
    assert want and rows_of(C.collocations(extra, least=2)) == want
    assert rows_of(C.collocations(empty(spark), least=2)) == []
    assert QUERIES["op12_collocations"](spark, SF).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]

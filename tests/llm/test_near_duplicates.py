"""Fingerprints, SimHash links, components and decontamination against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from data import SF, awkward, components, empty, simhash

from carescope.llm import cws, decontam, simhash as sim
from carescope.llm.components import connected_components
from carescope.llm.queries import QUERIES


def jaccard(a, b):
    a, b = Counter(a.lower().split()), Counter(b.lower().split())
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_fingerprints_of_whole_table(spark):
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    rows = sorted(QUERIES["op6_fingerprints"](spark, SF).collect(), key=lambda r: r["doc_id"])
    assert [r["doc_id"] for r in rows] == [i for i, _ in docs]
    after = [t for _, t in docs[1:]] + [docs[0][1]]
    edited = [t[:len(t) - len(t) // 4] + n[:len(t) // 4] for (_, t), n in zip(docs, after)]
    assert [r["n_chars"] for r in rows] == [len(t) for _, t in docs]
    assert [r["edited_sha256"] for r in rows] == [hashlib.sha256(e.encode()).hexdigest() for e in edited]
    errors = np.array([r["near_edited"] - jaccard(t, e) for r, (_, t), e in zip(rows, docs, edited)])
    assert abs(errors.mean()) < 0.03 and np.sqrt((errors ** 2).mean()) < 0.12      # 32 samplers
    errors = np.array([r["near_next"] - jaccard(t, n) for r, (_, t), n in zip(rows, docs, after)])
    assert abs(errors.mean()) < 0.03
    by_text = {}
    assert all(by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"] for r, (_, t) in zip(rows, docs))
    assert all(len(r["fingerprint"]) == 8 * 32 == len(r["edited_fingerprint"]) for r in rows)


def test_fingerprints_awkward_rows(spark):
    docs = awkward(spark)
    rows = cws.fingerprint_documents(docs, samples=8).collect()
    assert len(rows) == docs.count()
    prints = {}
    for r in rows:
        prints.setdefault(r["doc_id"], set()).add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert prints[1] == prints[2] and prints[3] == prints[4] == prints[6] and len(prints[8]) == 2
    assert sum(r["doc_id"] == 8 for r in rows) == 3
    assert cws.fingerprint_documents(empty(spark)).count() == 0
    one = cws.fingerprint_documents(docs.where("doc_id = 1")).collect()
    assert one[0]["near_next"] == 1.0


def test_bits_are_those_of_the_law():
    for text in ("", "one", "one two", "A b C d e", "x " * 50, " \t", "É é Z"):
        assert sim.fingerprint(text) == simhash(text)


def test_long_texts_are_read_in_runs(monkeypatch):
    text = " ".join(str(k) for k in range(500))
    want = simhash(text)
    monkeypatch.setattr(sim, "RUN", 7)
    monkeypatch.setattr(sim, "LONG", 10)
    assert sim.fingerprint(text) == want


@pytest.mark.parametrize("distance", [0, 1, 3, 4])
def test_all_links_are_found(spark, distance):
    rnd = random.Random(distance)
    fps = [rnd.getrandbits(64) for _ in range(60)]
    for fp in list(fps):
        for _ in range(3):
            fps.append(fp ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 5))))
    fps += [0, 1, 3, 7, 15, 2 ** 63, 2 ** 64 - 1]
    fps = sorted({f - 2 ** 64 if f >> 63 else f for f in fps})
    got = {tuple(r) for r in sim.near_pairs(spark.createDataFrame([(f,) for f in fps], "fp bigint"), distance).collect()}
    want = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (2 ** 64 - 1)).bit_count() <= distance}
    assert got == want


def test_allocations_are_complete():
    rnd = np.random.default_rng(1)
    x = (rnd.random((400, 64)) < rnd.random(64)).astype(float)
    counts = (x.T @ x).astype(int)
    for n in (400, 10 ** 6, 10 ** 9, 10 ** 11):
        plan = sim.plan_parts(counts * (n // 400), n, 3)
        assert sum(t + 1 for _, t in plan) == 4
        bits = [b for g, _ in plan for b in g]
        assert len(bits) == len(set(bits))
    for parts in sim.PARTS:
        assert sorted(b for g in sim.cut_bits(counts, 400, parts) for b in g) == list(range(64))


def test_components(spark):
    chain = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (101, 102), (200, 100), (7, 7)]
    got = dict(connected_components(spark.createDataFrame(chain, "a bigint, b bigint"), "a", "b").collect())
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100, 200: 100}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def test_near_duplicates_of_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    group = components([simhash(t) for _, t in docs])
    least = {}
    for (i, _), g in zip(docs, group):
        least[g] = min(i, least.get(g, i))
    want = {i: (f"{simhash(t):016x}", least[g]) for (i, t), g in zip(docs, group)}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op7_simhash"](spark, SF).collect()}
    assert got == want


def test_near_duplicates_awkward_rows(spark):
    docs = awkward(spark)
    rows = sim.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    named = {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] not in (8, None)}
    assert named[1] == named[2] == 1 and named[3] == named[4] == named[6] == 3 and named[5] == 5
    kept = sim.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"], r["text"]) for r in kept.collect()) == sorted(
        (r["doc_id"] is None, r["doc_id"], r["text"]) for r in docs.where("doc_id is null or doc_id not in (2, 4, 6)").distinct().collect())
    assert sim.near_duplicates(empty(spark)).count() == 0 and sim.drop_near_duplicates(empty(spark)).count() == 0


# -- decontamination ------------------------------------------------------------------------

def edit_distance(item, text):
    """Least word edits between the item and any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item):
        new = [i + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (w != t), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_matches_are_exact_and_recall_reaches_its_target(spark):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(30).collect()]
    rnd, texts = random.Random(4), []
    for _, text in items:
        for share in (0, 0.1, 0.2):
            w = decontam.words(text)
            for _ in range(int(share * len(w))):
                k = rnd.randrange(len(w))
                w[k:k + 1] = rnd.choice([["zzz"], [], [w[k], "the"]])
            around = decontam.words(rnd.choice(docs))
            cut = rnd.randrange(len(around) + 1)
            texts.append(" ".join(around[:cut] + w + around[cut:]))
    searcher = decontam.Searcher(items, 0.2, 0.95, 11)
    got = {(k, i): e for k, i, e, _, _ in searcher.matches(texts)}
    want = {}
    for k, text in enumerate(texts):
        words = decontam.words(text)
        for i, t in items:
            w = decontam.words(t)
            if (i == items[k // 3][0]) and edit_distance(w, words) <= int(0.2 * len(w) + 1e-9):
                want[k, i] = edit_distance(w, words)
    assert all(got[key] == want[key] for key in got.keys() & want.keys())
    assert len(got.keys() & want.keys()) >= 0.95 * len(want)
    for k, i in got.keys() - want.keys():      # any other match is a true one too
        w = decontam.words(dict(items)[i])
        assert edit_distance(w, decontam.words(texts[k])) == got[k, i] <= int(0.2 * len(w) + 1e-9)


def test_exact_passages_of_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    items = {r["item_id"]: f" {' '.join(decontam.words(r['text']))} " for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    docs = {r["doc_id"]: f" {' '.join(decontam.words(r['text']))} " for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in QUERIES["op8_decontamination"](spark, sf).collect()}
    exact = {(d, i) for d, t in docs.items() for i, w in items.items() if w in t}
    assert exact and {k for k, e in got.items() if e == 0} == exact


def test_long_documents_are_read_in_stretches(monkeypatch):
    rnd = random.Random(6)
    item = " ".join(f"w{rnd.randrange(500)}" for _ in range(20))
    filler = [f"x{rnd.randrange(900)}" for _ in range(3000)]
    monkeypatch.setattr(decontam, "STRETCH", 200)
    searcher = decontam.Searcher([(1, item)], 0.2, 0.95, 11)
    for cut in (0, 190, 199, 200, 201, 1500, 3000):
        text = " ".join(filler[:cut] + item.split() + filler[cut:])
        assert [(i, e, end) for _, i, e, _, end in searcher.matches([text])] == [(1, 0, cut + 20)]


def test_decontamination_awkward_rows(spark):
    docs = awkward(spark)
    bench = spark.createDataFrame([(1, "quick brown fox jumps over it"), (1, "quick brown fox jumps over it"), (2, None), (3, ""),
                                   (4, "one two"), (None, "Quick BROWN fox, jumps over?"), (5, "very long words very long words")],
                                  "item_id bigint, text string")
    got = sorted((r["doc_id"], r["item_id"] or 0, r["edits"]) for r in decontam.contaminated(docs, bench).collect())
    assert got == sorted([(1, 1, 0), (1, 0, 0), (2, 1, 0), (2, 0, 0), (5, 5, 0)])
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.where("doc_id in (1, 2, 5)").count() == 0 and kept.count() == docs.count() - 3
    assert decontam.contaminated(empty(spark), bench).count() == 0
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0
    assert decontam.drop_contaminated(docs, bench.limit(0)).count() == docs.count()


def test_items_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 7)
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op8_decontamination"](spark, SF).collect()}
    monkeypatch.undo()
    assert got == {(r["doc_id"], r["item_id"]) for r in QUERIES["op8_decontamination"](spark, SF).collect()}


def edited_passages(items, share, seed):
    """Each item with so many random edits, amid other words."""
    rnd, texts = random.Random(seed), []
    for _, text in items:
        w = text.split()
        for _ in range(int(share * len(w))):
            k = rnd.randrange(len(w))
            w[k:k + 1] = rnd.choice([["zzz"], [], [w[k], "zzz"]])
        around = [f"y{rnd.randrange(50)}" for _ in range(rnd.randrange(60))]
        texts.append(" ".join(around + w + around))
    return texts


@pytest.mark.parametrize("length", [60, 200, 600])
def test_long_items_reach_the_target(length):
    rnd = random.Random(length)
    items = [(k, " ".join(f"w{int(rnd.paretovariate(0.7)) % 3000}" for _ in range(length))) for k in range(20)]
    searcher = decontam.Searcher(items, 0.2, 0.95, 11)
    assert all(b.recall >= 0.95 for b in searcher.bands)
    for share in (0.05, 0.1, 0.2):
        texts = edited_passages(items, share, 3)
        got = {(k, i): e for k, i, e, _, _ in searcher.matches(texts)}
        assert sum((k, k) in got for k in range(len(items))) >= 0.95 * len(items)
        assert all(e == edit_distance(items[i][1].split(), texts[k].split()) for (k, i), e in list(got.items())[:2])


def test_bands_that_miss_the_target_are_checked_exactly(monkeypatch):
    monkeypatch.setattr(decontam, "REPEATS", 1)
    monkeypatch.setattr(decontam, "PAIRED", 7)
    rnd = random.Random(2)
    items = [(k, " ".join(f"w{int(rnd.paretovariate(0.7)) % 3000}" for _ in range(rnd.choice((6, 17, 60, 150))))) for k in range(40)]
    searcher = decontam.Searcher(items, 0.2, 0.95, 11)
    assert any(b.paired for b in searcher.bands)
    got = {(k, i) for k, i, *_ in searcher.matches(edited_passages(items, 0.2, 5))}
    assert {(k, k) for k in range(40)} <= got


def test_short_items_are_searched_exactly(spark):
    bench = spark.createDataFrame([(1, "Rare"), (2, "two words"), (3, "one, two: three four"), (4, "你好世界"), (5, "สวัสดี"),
                                   (6, "漢字とかな交じりの文"), (7, "!?"), (2, "two words")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "a rare thing, rare"), (2, "Two WORDS here and two, words"), (3, "zero one two three four"),
                                  (4, "他说你好世界吗"), (5, "คำว่าสวัสดีครับ"), (6, "この漢字とかな交じりの文は長い"), (7, "rarely two thing words"),
                                  (8, "one two three"), (9, "你好 世 "), (10, None), (11, "這漢字和かな交じりの文は")], "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["item_id"], r["edits"], r["word_end"]) for r in decontam.contaminated(docs, bench).collect())
    assert got == [(1, 1, 0, 2), (2, 2, 0, 2), (3, 3, 0, 5), (4, 4, 0, 6), (5, 5, 0, 11), (6, 6, 0, 12), (11, 6, 1, 11)]
    assert sorted(r["doc_id"] for r in decontam.drop_contaminated(docs, bench).collect()) == [7, 8, 9, 10]


def test_columns_keep_their_values_whatever_their_names(spark):
    rows = [(1, "the same words here again", 5, "a", 7, [1]), (2, "the same words here again", 6, "b", 8, [2]), (None, "lone text of its own", 7, "c", 9, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, __own_id int, own_hash string, row int, `k.0` array<int>")
    got = sim.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted((rows[0], rows[2]), key=str)


def test_a_third_of_all_rows_equal_leave_one(spark):
    docs = spark.range(3000).selectExpr("case when id % 3 = 0 then null else id end as doc_id",
                                        "case when id % 3 = 0 then 'one text that many rows share' else concat(md5(cast(id as string)), ' ', sha1(cast(id as string)), ' ', id) end as text")
    got = sim.drop_near_duplicates(docs.repartition(6)).collect()
    assert sum(r.doc_id is None for r in got) == 1 and len({r.doc_id for r in got}) == len(got)

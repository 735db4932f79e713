"""Prefix trie of conversations: against a trie built node by node, SQL twin, borders, awkward rows."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from data import rows_of

from carescope.llm import prefix_trie as T
from carescope.llm.queries import QUERIES, SQL

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def rebuilt(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    plain = {c: [t[3] for t in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, own in plain.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = plain.get(c - int(np.fmod(c, 100)), [])[:h] + own[h:]
    return out


def trie(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = []

    def below(p):
        leaves, saved = (0 if children[p] else 1), (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        for child in children[p]:
            a, b = below(child)
            leaves, saved = leaves + a, saved + b
        ends = ",".join(map(str, sorted(c for c in members[p] if len(convs[c]) == len(p))))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), leaves, saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved
    if convs:
        below(())
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def random_rows(seed, n, letters, longest):
    rng, rows = np.random.default_rng(seed), []
    for c in rng.choice(10 * n, n, replace=False).tolist():
        for t in range(rng.integers(1, longest)):
            rows.append((c - n, t, "user", letters[rng.integers(0, len(letters))]))
    return rows


@pytest.mark.parametrize("parts", [1, 3, 40])
@pytest.mark.parametrize("letters,longest", [("ab", 7), (["x"], 9), (["é", "漢字 long", "", "b"], 4)])
def test_against_a_plain_trie(spark, parts, letters, longest):
    rows = random_rows(len(letters) + longest, 250, list(letters), longest)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        assert got(T.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == trie(rebuilt(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("seed", range(40))
def test_forests_cut_anywhere_merge_to_the_same(seed):
    """Fragments of forests over any cut of the sorted keys add up to the whole forest."""
    rng = np.random.default_rng(seed)
    keys = sorted({"".join(digest("u", "abc"[i]) for i in rng.integers(0, 2 + seed % 2, rng.integers(0, 7))) for _ in range(40)})
    chars = [np.array([0, *rng.integers(1, 2, len(k) // T.WIDTH)]) * 3 for k in keys]
    times, least = rng.integers(1, 4, len(keys)).tolist(), rng.permutation(1000)[:len(keys)].tolist()
    whole = T.Forest(keys, chars, times, least, keys, -1, -1).rows()
    cuts = [0, *sorted(rng.choice(np.arange(1, len(keys)), min(5, len(keys) - 1), replace=False).tolist()), len(keys)]
    side = [-1, *(T.shared_turns(keys[c - 1], keys[c]) for c in cuts[1:-1]), -1]
    parts = [T.Forest(keys[a:b], chars[a:b], times[a:b], least[a:b], keys[a:b], side[k], side[k + 1]).rows()
             for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    cat = T.pd.concat(parts)
    frag = cat[cat.own_key.notna()].groupby("own_key").agg(
        {"conv_id": "min", "depth": "max", "n_convs": "sum", "n_children": "sum", "n_leaves": "sum", "saved": "sum"})
    assert (cat[cat.own_key.notna()].groupby("own_key").depth.nunique() == 1).all()
    names = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved"]
    merged = [*cat[cat.own_key.isna()][names].itertuples(index=False, name=None), *frag[names].itertuples(index=False, name=None)]
    assert sorted(merged) == sorted(whole[names].itertuples(index=False, name=None))
    assert len(cat[cat.own_key.notna()]) <= sum(max(0, a + 1) + max(0, b + 1) for a, b in zip(side, side[1:]))


def test_query_and_sql_twin(spark):
    d = "/root/testdata/sf0.01"
    nodes = got(QUERIES["op11_prefix_trie"](spark, d))
    assert nodes == trie(rebuilt([tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{d}/conversations.parquet'")
    assert sorted(con.execute(SQL["op11_prefix_trie"]).fetchall(), key=str) == nodes


def test_many_equal_conversations(spark):
    """A third of all conversations are equal, over many partitions; ids of a sequence are hashed in order."""
    rows = [(100 * c, t, "user", "same" if c % 3 else f"other {c} {t}") for c in range(1200) for t in range(2)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert got(T.conversation_trie(frame)) == trie(rebuilt(rows))


def test_awkward_rows(spark):
    rows = [(1, None, None, None), (1, 2, "user", "b"), (1, 2, "user", "a"), (1, 2, "user", "a"), (2, 0, "user", None), (None, 0, "user", "lost"),
            (105, 0, "user", "own"), (200, 0, "user", "x" * 300_000), (203, 0, "a", ":b"), (-250, 0, "user", "neg"), (-200, 0, "user", "base"),
            (3, 0, "us", "er"), (4, 0, "user", "")]
    frame = spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA + ", key string, at int")
    assert got(T.conversation_trie(frame)) == trie(rebuilt(rows))
    con = duckdb.connect()
    con.register("given", frame.toPandas())
    con.execute("create view conversations as select conv_id::bigint as conv_id, turn::bigint as turn, role, text from given")
    assert sorted(con.execute(SQL["op11_prefix_trie"]).fetchall(), key=str) == trie(rebuilt(rows))
    assert rows_of(T.conversation_trie(spark.createDataFrame([], SCHEMA))) == []

"""Prefix trie of conversations: union-find over the shared lengths of sorted neighbours.

A conversation is the string of its turns' digests. Distinct strings are range-partitioned and
sorted; the turns that neighbours share are edges, and a union-find takes them in descending
depth: each merge of components is a branching node, at the depth of the edge, and a component's
depths between two merges are the nodes of an unbranched path. Everything asked of a node is a sum
over its component. A component that reaches a partition's border, at a depth that the rows on both
sides of the border share, is not whole: a partition's forest is contracted to one fragment for each
such depth (at most two paths), and fragments of equal prefix are merged in an aggregation.

No conversation's turns are numbered or joined in one task: turns get global row numbers by range
partition, and a conversation's first number comes from an aggregate. One row then holds a
conversation's digests and lengths, some 40 bytes a turn; this is the one thing that grows with a
single conversation.

Cases: rows without a conversation id belong to no conversation; a null turn comes first, equal
turns are ordered by the digest of role and text, a null role or text counts as empty; repeated
rows are turns of their own; equal conversations share all nodes; a conversation without turns ends
at the root; an empty table has no node, not even the root. Only the four named columns are read, so
other columns, whatever their names, do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carescope.llm.common import checkpoint_dir, cut_lineage, row_numbers

WIDTH = 32                                          # characters of a turn's digest
NODES = ("conv_id bigint, depth bigint, parent_conv bigint, n_convs bigint, n_children bigint, n_leaves bigint,"
         " saved bigint, own_key string, parent_key string, sequence string")
EMPTY = hashlib.sha256(b"").hexdigest()


def turn_rows(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
              text_col: str = "text") -> DataFrame:
    """(conv_id, pos, digest, chars) of every turn, ``pos`` from 0, kept in a checkpoint."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.left(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(WIDTH))
    narrow = conversations.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).isNotNull().alias("dated"),
                                  F.col(turn_col).alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    numbered, _ = row_numbers(narrow.where("conv_id is not null"), ["conv_id", "dated", "turn", "digest"], "at")
    first = numbered.groupBy("conv_id").agg(F.min("at").alias("first"))
    return cut_lineage(numbered.join(first, "conv_id").select("conv_id", (F.col("at") - F.col("first")).alias("pos"), "digest", "chars"))


def rebuilt_rows(turns: DataFrame, group: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) after the first h turns of c were replaced by those of c - c % group;
    h is crc32 of c as text, modulo ``most`` + 1."""
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.withColumns({"base": F.col("conv_id") - F.col("conv_id") % group,
                               "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)})
    bases = sizes.where(F.col("conv_id") == F.col("base")).select("base", F.col("size").alias("there"))
    convs = sizes.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0)))).select(
        "conv_id", "base", "h", "taken")
    own = turns.join(convs, "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "chars")
    heads = turns.where((F.col("pos") < most) & (F.col("conv_id") % group == 0)).withColumnRenamed("conv_id", "base")
    lent = convs.join(heads, "base").where("pos < taken").select("conv_id", "pos", "digest", "chars")
    return convs.select("conv_id"), own.unionByName(lent)


def paths(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, key, chars, sequence): the digests in order, the lengths after a 0 for the root, the key's digest."""
    marks = convs.select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit("").alias("digest"), F.lit(0).cast("long").alias("chars"))
    rows = turns.select("conv_id", "pos", "digest", "chars").unionByName(marks)
    each = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "chars"))).alias("t"))
    key = F.array_join("t.digest", "")
    return each.select("conv_id", key.alias("key"), F.col("t.chars").alias("chars"), F.left(F.sha2(key, 256), F.lit(WIDTH)).alias("sequence"))


def shared_turns(a: str, b: str) -> int:
    """How many turns two keys have in common from the start."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:
        half = (low + high + 1) // 2
        if a[WIDTH * low:WIDTH * half] == b[WIDTH * low:WIDTH * half]:
            low = half
        else:
            high = half - 1
    return low


def prefix_keys(key: str, depth: int) -> list[str]:
    """Digests of the first 0, 1, .. ``depth`` turns of a key."""
    state, out = hashlib.sha256(), []
    for d in range(depth + 1):
        out.append(state.hexdigest()[:WIDTH])
        state.update(key[WIDTH * d:WIDTH * (d + 1)].encode())
    return out


class Forest:
    """The nodes of sorted distinct keys; ``left`` and ``right`` are the turns shared with the rows
    before and after these, -1 where there are none."""

    def __init__(self, keys: Sequence[str], chars: Sequence[np.ndarray], times: Sequence[int], least: Sequence[int],
                 sequences: Sequence[str], left: int, right: int):
        self.keys, self.sequences, self.left, self.right, m = keys, sequences, left, right, len(keys)
        shared = [left, *(shared_turns(keys[i - 1], keys[i]) for i in range(1, m))]
        before = [np.cumsum(np.asarray(c, np.int64)) for c in chars]       # characters of the first d turns
        self.at = np.concatenate(([0], np.cumsum([len(b) for b in before])))
        self.before = np.concatenate(before)
        self.total = np.array([b[-1] for b in before], np.int64)
        #: characters of the nodes that a row begins
        self.begun = self.total - np.array([b[max(s, 0)] for b, s in zip(before, shared)], np.int64)
        self.top = [len(k) // WIDTH for k in keys]
        self.first, self.last, self.up = list(range(m)), list(range(m)), [-1] * m
        self.n, self.least, self.kids = list(times), list(least), [0] * m
        self.leaves = [int(after < top) for after, top in zip([*shared[1:], right], self.top)]
        self.weight = [t * int(c) for t, c in zip(times, self.total)]      # characters over all conversations
        self.inner = [0] * m                                               # characters begun by rows but the first
        self._merge(shared)

    def _merge(self, shared: list[int]) -> None:
        m = len(self.keys)
        root, node = list(range(m)), list(range(m))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x
        for i in sorted(range(1, m), key=lambda i: (-shared[i], i)):
            x, y, depth = find(i - 1), find(i), shared[i]
            a, b = node[x], node[y]
            if self.top[a] > depth:
                a = self._above(a, depth)
            self.up[b] = a
            self.kids[a] += 1
            self.n[a] += self.n[b]
            self.leaves[a] += self.leaves[b]
            self.weight[a] += self.weight[b]
            self.inner[a] += self.inner[b] + int(self.begun[self.first[b]])
            self.least[a] = min(self.least[a], self.least[b])
            self.last[a] = self.last[b]
            root[y] = x
            node[x] = a

    def _above(self, child: int, depth: int) -> int:
        """A branching node at ``depth`` over a component."""
        for values in (self.first, self.last, self.n, self.least, self.leaves, self.weight, self.inner):
            values.append(values[child])
        self.top.append(depth)
        self.kids.append(1)
        self.up.append(-1)
        self.up[child] = len(self.top) - 1
        return len(self.top) - 1

    def rows(self) -> pd.DataFrame:
        """A row for each node of the components' paths; unfinished ones carry their prefix's key."""
        top, up, first, last, n, least, kids, leaves, weight, inner = (
            np.array(x, np.int64) for x in (self.top, self.up, self.first, self.last, self.n, self.least, self.kids, self.leaves,
                                            self.weight, self.inner))
        below = np.where(up >= 0, top[up], -1)                             # depth of the branching node above
        z = np.repeat(np.arange(len(top)), top - below)
        depth = np.arange(len(z)) - np.repeat(np.cumsum(top - below) - (top - below), top - below) + below[z] + 1
        own = np.where(depth > below[z] + 1, z, up[z])                     # the parent's component
        goes_on = (first[z] == 0) & (depth <= self.left)
        unfinished = goes_on | ((last[z] == len(self.keys) - 1) & (depth <= self.right))
        parent_unfinished = (depth > 0) & (((first[own] == 0) & (depth - 1 <= self.left)) | ((last[own] == len(self.keys) - 1) & (depth - 1 <= self.right)))
        earlier = np.where(depth > 0, self.before[self.at[first[z]] + np.maximum(depth, 1) - 1], 0)
        begun = inner[z] + np.where(goes_on, self.begun[0], self.total[first[z]] - earlier)
        children = np.where(depth == top[z], kids[z], 1) - ((first[z] == 0) & (depth + 1 <= self.left))
        ends = (z < len(self.keys)) & (depth == top[z])
        lefts, rights = prefix_keys(self.keys[0], self.left), prefix_keys(self.keys[-1], self.right)

        def keys_of(where, component, at) -> np.ndarray:
            out = np.full(len(z), None, object)
            for k in np.flatnonzero(where):
                d = int(at[k])
                out[k] = lefts[d] if first[component[k]] == 0 and d <= self.left else rights[d]
            return out
        sequence = np.full(len(z), None, object)
        sequence[ends] = np.array(self.sequences, object)[z[ends]]
        parent = pd.array(least[own], dtype="Int64")
        parent[(depth == 0) | parent_unfinished] = pd.NA
        return pd.DataFrame({"conv_id": least[z], "depth": depth, "parent_conv": parent, "n_convs": n[z], "n_children": children,
                             "n_leaves": leaves[z], "saved": weight[z] - n[z] * earlier - begun,
                             "own_key": keys_of(unfinished, z, depth), "parent_key": keys_of(parent_unfinished, own, depth - 1),
                             "sequence": sequence})


def _whole(batches: Iterator[pd.DataFrame]) -> pd.DataFrame | None:
    """A partition's rows: as many as one task of a range partition has."""
    held = [b for b in batches if len(b)]
    return pd.concat(held, ignore_index=True) if held else None


def member_digests(members: DataFrame) -> DataFrame:
    """(sequence, ends): SHA-256 of the comma-joined ids of each sequence's conversations, ascending.

    Ids are sorted and written out over all tasks, in pieces; only the hashing of a sequence's
    pieces, which has an order, is one task's, a piece at a time.
    """
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch.groupby("sequence", sort=False)["conv_id"]
            yield pd.DataFrame([(s, int(c.iloc[0]), ",".join(map(str, c.tolist()))) for s, c in ids], columns=["sequence", "first", "piece"])

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for batch in batches:
            out = []
            for sequence, piece in zip(batch["sequence"], batch["piece"]):
                if sequence == now:
                    state.update(b",")
                else:
                    if now is not None:
                        out.append((now, state.hexdigest()))
                    now, state = sequence, hashlib.sha256()
                state.update(piece.encode())
            yield pd.DataFrame(out, columns=["sequence", "ends"])
        if now is not None:
            yield pd.DataFrame([(now, state.hexdigest())], columns=["sequence", "ends"])

    ordered = members.select("sequence", "conv_id").repartitionByRange(parts, "sequence", "conv_id").sortWithinPartitions("sequence", "conv_id")
    cut = ordered.mapInPandas(pieces, "sequence string, first bigint, piece string")
    return cut.repartition(parts, "sequence").sortWithinPartitions("sequence", "first").mapInPandas(digests, "sequence string, ends string")


def trie_nodes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """A row for each node of the prefix trie of the given conversations (``conv_id``) and their
    ``turns`` (conv_id, pos, digest, chars): smallest member and depth, smallest member of the parent,
    members, children, leaves, characters saved in the subtree, and the digest of the members that end."""
    spark = convs.sparkSession
    each = cut_lineage(paths(convs, turns))
    distinct = each.groupBy("sequence").agg(F.first("key").alias("key"), F.first("chars").alias("chars"),
                                            F.count(F.lit(1)).alias("times"), F.min("conv_id").alias("least"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    checkpoint_dir(spark)
    ordered = distinct.repartitionByRange(parts, "key").sortWithinPartitions("key").checkpoint(eager=True)

    def ends_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = last = None
        for batch in batches:
            if len(batch):
                first, last = batch["key"].iloc[0] if first is None else first, batch["key"].iloc[-1]
        if first is not None:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "first": [first], "last": [last]})

    borders = sorted(tuple(r) for r in ordered.select("key").mapInPandas(ends_of, "part int, first string, last string").collect())
    between = [-1, *(shared_turns(a[2], b[1]) for a, b in zip(borders, borders[1:])), -1]    # one number a partition
    sides = {part: (between[k], between[k + 1]) for k, (part, _, _) in enumerate(borders)}

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = _whole(batches)
        if rows is not None:
            left, right = sides[TaskContext.get().partitionId()]
            yield Forest(rows["key"].tolist(), rows["chars"].tolist(), rows["times"].tolist(), rows["least"].tolist(),
                         rows["sequence"].tolist(), left, right).rows()

    grown = cut_lineage(ordered.mapInPandas(grow, NODES))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    merged = cut_lineage(grown.where("own_key is not null").groupBy("own_key").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *sums, F.max("parent_key").alias("parent_key"),
        F.max("sequence").alias("sequence")))
    columns = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved", "sequence"]
    parents = merged.select(F.col("own_key").alias("parent_key"), F.col("conv_id").alias("parent_conv"))
    finished = grown.where("own_key is null")
    hung = finished.select("parent_key", *columns).unionByName(merged.select("parent_key", *columns)).where("parent_key is not null").join(parents, "parent_key")
    roots = merged.where("parent_key is null").select(*columns, F.lit(None).cast("long").alias("parent_conv"))
    nodes = (finished.where("parent_key is null").select(*columns, "parent_conv")
             .unionByName(hung.select(*columns, "parent_conv")).unionByName(roots))
    several = ordered.where("times > 1").select("sequence")
    shared = member_digests(each.select("sequence", "conv_id").join(several, "sequence", "left_semi"))
    alone = ordered.where("times = 1").select("sequence", F.sha2(F.col("least").cast("string"), 256).alias("ends"))
    ending = nodes.where("sequence is not null").join(shared.unionByName(alone), "sequence")
    passing = nodes.where("sequence is null").withColumn("ends", F.lit(EMPTY))
    return ending.unionByName(passing).select(
        "conv_id", "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, group: int = 100, most: int = 5) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return trie_nodes(*rebuilt_rows(turn_rows(conversations), group, most))

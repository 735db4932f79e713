"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprint: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, shingles of some words (all of them
if there are fewer), repeats included; h is a shingle's XXH64 with seed 42, and a bit is 1 if set
in over half of the h. No words: fingerprint 0, linked like any other.

Links: two fingerprints that differ in at most T bits, cut into parts with thresholds t_i whose
t_i + 1 sum to T + 1, differ in at most t_i bits within some part i. Correlated bits (over all
distinct fingerprints) share a part, so that the parts' distributions differ little from
independent ones; the thresholds, which may be unequal or -1 (part not used), and the number of
parts come from dynamic programming on the estimated numbers of probes and candidates. Each
fingerprint is listed under its value in each part and probes all values within the threshold;
candidates are verified on all 64 bits. Any cut and allocation finds every link; the estimates
only decide the cost.

Equal fingerprints are taken together first (pre-aggregated in every task), so copies cost
nothing, and links are between distinct fingerprints only.

Cases: a null text counts as empty; null ids take part, but a component's id is its least id that
isn't null (null if there is none); repeated rows repeat in the result; an empty table gives an
empty one; texts of any length are read whole, in runs of shingles. Only the id and text columns
are read; ``drop_near_duplicates`` passes all columns through, whatever their names.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from itertools import combinations, islice
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carescope.llm.common import cut_lineage, whole_text
from carescope.llm.components import connected_components

BITS = 64
SEED = 42
RUN = 1 << 15              # shingles hashed at once
LONG = 1 << 22             # bytes from which words are found one by one
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
PARTS = (2, 3, 4, 5, 6)    # numbers of parts that are considered


# -- fingerprints ---------------------------------------------------------------------------

def _shingles(text: bytes, length: int) -> Iterator[bytes]:
    words = text.split() if len(text) < LONG else (m[0] for m in WORD.finditer(text))
    if isinstance(words, list) and len(words) >= length:
        return map(b" ".join, zip(*(words[k:] for k in range(length))))
    return _sliding(iter(words), length)


def _sliding(words: Iterator[bytes], length: int) -> Iterator[bytes]:
    window = deque(islice(words, length), maxlen=length)
    if window:
        yield b" ".join(window)
    for word in words:
        window.append(word)
        yield b" ".join(window)


def fingerprint(text: str, length: int = 3) -> int:
    """The unsigned 64-bit fingerprint. bytes.lower and bytes.split know A-Z and the ASCII blanks only."""
    shingles, set_bits, n = _shingles(text.encode("utf-8").lower(), length), np.zeros(BITS, dtype=np.int64), 0
    while run := [xxhash.xxh64_intdigest(s, SEED) for s in islice(shingles, RUN)]:
        h = np.array(run, dtype="<u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(h, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(run)
    return int(np.packbits(set_bits * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, length: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and text_hash of every row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = np.array([fingerprint(t, length) for t in batch["text"]], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "fp": fp.view(np.int64),
                                "text_hash": batch["text_hash"]})
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"),
                         F.xxhash64(whole_text(text_col)).alias("text_hash"))
    return narrow.mapInPandas(run, "doc_id bigint, fp bigint, text_hash bigint")


# -- parts and thresholds -------------------------------------------------------------------

def bit_counts(distinct: DataFrame) -> tuple[np.ndarray, int]:
    """(co-occurrence counts of set bits, number) over all distinct fingerprints; each batch sends
    one row a pair of bits, summed before and after the shuffle."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, cols = np.triu_indices(BITS)
        for batch in batches:
            h = batch["fp"].to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8)
            x = np.unpackbits(h, axis=1, bitorder="little").astype(np.float64)
            yield pd.DataFrame({"i": rows, "j": cols, "c": (x.T @ x)[rows, cols].astype(np.int64)})
    counts = np.zeros((BITS, BITS), dtype=np.int64)
    for i, j, c in distinct.select("fp").mapInPandas(run, "i int, j int, c bigint").groupBy("i", "j").agg(F.sum("c")).collect():
        counts[i, j] = counts[j, i] = c
    return counts, distinct.count()


def cut_bits(counts: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of near-equal size; the most correlated pairs go together first."""
    p = np.diag(counts) / max(n, 1)
    cov = counts / max(n, 1) - np.outer(p, p)
    scale = np.sqrt(np.maximum(np.outer(p * (1 - p), p * (1 - p)), 1e-12))
    strength, room = np.abs(cov / scale), -(-BITS // parts)
    group = {b: [b] for b in range(BITS)}
    pairs = [(-strength[i, j], i, j) for i in range(BITS) for j in range(i + 1, BITS)]
    for _, i, j in sorted(pairs):
        a, b = group[i], group[j]
        if a is not b and len(a) + len(b) <= room // 2:
            a += b
            for bit in b:
                group[bit] = a
    clusters = sorted({id(g): g for g in group.values()}.values(), key=lambda g: (-len(g), g))
    out: list[list[int]] = [[] for _ in range(parts)]
    for cluster in clusters:     # whole clusters into the emptiest part; the rest fills up bit by bit
        target = min(out, key=len)
        if len(target) + len(cluster) <= room:
            target += cluster
        else:
            for bit in cluster:
                min(out, key=len).append(bit)
    return [sorted(g) for g in out]


def part_costs(bits: list[int], counts: np.ndarray, n: int, most: int) -> list[float]:
    """Estimated cost of a part for thresholds -1, 0, ..: rows listed and probed, and candidates met."""
    p = np.diag(counts)[bits] / max(n, 1)
    differ = np.zeros(most + 1)
    differ[0] = 1.0              # chances that two fingerprints differ in so many bits of the part
    for q in 2 * p * (1 - p):
        differ[1:] = differ[1:] * (1 - q) + differ[:-1] * q
        differ[0] *= 1 - q
    costs = [0.0]
    for t in range(most + 1):
        probes = sum(comb(len(bits), k) for k in range(t + 1))
        costs.append(n * (1.0 + probes) + n * (n / 2) * float(differ[:t + 1].sum()))
    return costs


def allocate(costs: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with the t_i + 1 summing to distance + 1, of least total cost."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for units, more in enumerate(part):
                total = used + units
                if total <= distance + 1 and (total not in new or cost + more < new[total][0]):
                    new[total] = (cost + more, [*chosen, units - 1])
        best = new
    return best[distance + 1]


def plan_parts(counts: np.ndarray, n: int, distance: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the parts in use, of the cheapest number of parts."""
    plans = []
    for parts in PARTS:
        groups = cut_bits(counts, n, parts)
        cost, thresholds = allocate([part_costs(g, counts, n, distance) for g in groups], distance)
        plans.append((cost, parts, [(g, t) for g, t in zip(groups, thresholds) if t >= 0]))
    return min(plans, key=lambda p: p[:2])[2]


# -- links and components -------------------------------------------------------------------

def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _flips(bits: list[int], threshold: int) -> list[int]:
    """All changes of at most ``threshold`` of the bits, as masks."""
    flips = [0]
    for k in range(1, threshold + 1):
        flips += [_signed(sum(1 << b for b in c)) for c in combinations(bits, k)]
    return flips


def near_pairs(distinct: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints that differ in at most ``distance`` bits."""
    counts, n = bit_counts(distinct)
    plan = plan_parts(counts, n, distance)
    fp = F.col("fp")

    def rows(entries: list[Column], name: str) -> DataFrame:
        return (distinct.select(fp.alias(name), F.explode(F.array(*entries)).alias("e"))
                .select(name, F.col("e.part").alias("part"), F.col("e.value").alias("value")))

    def entry(part: int, value: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), value.alias("value"))

    masks = [F.lit(_signed(sum(1 << b for b in bits))).cast("long") for bits, _ in plan]
    listed = rows([entry(k, fp.bitwiseAND(m)) for k, m in enumerate(masks)], "b")
    probes = rows([entry(k, fp.bitwiseAND(m).bitwiseXOR(F.lit(flip).cast("long")))
                   for k, (m, (bits, t)) in enumerate(zip(masks, plan)) for flip in _flips(bits, t)], "a")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= F.lit(distance))
    return probes.join(listed, ["part", "value"]).where(near).select("a", "b").distinct()


def near_components(prints: DataFrame, distance: int = 3) -> DataFrame:
    """Per distinct fingerprint: fp and ``keeper``, the first document (least id, null ids last,
    then text hash) of all that are linked to it."""
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min(order).alias("first")))
    linked = connected_components(near_pairs(distinct, distance), "a", "b")
    named = distinct.join(linked, distinct["fp"] == linked["node"], "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component"))
    best = named.groupBy("component").agg(F.min("first").alias("keeper"))
    return named.join(best, "component").select("fp", "keeper")


def near_duplicates(docs: DataFrame, length: int = 3, distance: int = 3, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits) and component_id of every row."""
    prints = cut_lineage(fingerprints(docs, length, id_col, text_col))
    joined = prints.join(near_components(prints, distance), "fp")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                         F.col("keeper.doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, length: int = 3, distance: int = 3, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """The documents without those that are linked, directly or not, to one of lesser id; of
    repeated rows one stays. All columns are kept."""
    prints = cut_lineage(fingerprints(docs, length, id_col, text_col))
    keepers = near_components(prints, distance).select(F.col("keeper.doc_id").alias("id"), F.col("keeper.text_hash").alias("hash")).distinct()
    # whole rows travel as one struct, so their names meet no other; of equal rows every task sends one
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)])
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("own_id"), F.xxhash64(whole_text(text_col)).alias("own_hash"), row.alias("row"))
    once = rows.groupBy("own_id", "own_hash").agg(F.first("row").alias("row"))
    kept = once.join(keepers, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("hash")), "left_semi")
    return kept.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)])

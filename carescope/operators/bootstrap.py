"""Bootstrap confidence intervals of ranking metrics.

Resampling is expressed as replicate weights. All replicates of all groups are evaluated in one
blocked pass:

1. the units (rows, or cells of equal score) are range-partitioned once on (group, score) and
   checkpointed, which gives balanced blocks;
2. each block draws the weights of its units for all B replicates, some units at a time, and sends
   B-long vectors: of its first score, of its last, of each score that ``CROWD`` of its rows or more
   share, and of each run of others between. Rows of one score may fill many blocks; what they send
   for it is added up, so ties are counted as ties;
3. running sums over these entries turn them into offsets; the numerators of the scores that have
   an entry of their own are then plain expressions;
4. each block draws the weights of the runs again and, with their offsets, sends B partial sums of the
   AUROC and AP numerators. Where all scores are crowded nothing is drawn twice.

What is shuffled is units + (blocks + units / CROWD) x B at most; no (unit, replicate) pair leaves a
task. One more vector entry, with all weights 1, is the point estimate.

Units and draws, chosen by the caller (the result does not depend on any size):

* ``exact`` - a unit is a row, and a replicate draws exactly n rows of its group with replacement. The n
  draws are split over chunks of rows (in order of score and key) by conditional binomials from one
  seed tree, and within a chunk by a multinomial; the result does not depend on the partitions.
* ``rows``  - a unit is a row; its weight in replicate r is an inverse-CDF Poisson(1) draw from a
  32-bit slice of ``md5(seed:key:r div 4)``, so the whole bootstrap is reproducible in SQL.
* ``cells`` - a unit is a (group, score) cell with its counts; a count's total weight in a replicate
  is one Poisson(count) draw (the sum of independent Poisson(1)) of a generator seeded by (seed,
  cell). The cost does not depend on the number of rows, nor does a score that many rows share.

The Poisson modes are the large-n limit: a replicate's size is Poisson(n) rather than n.
A replicate with a single class has a null metric and counts as skipped; when more than
``max_skip`` of the replicates are skipped the interval is null (A24).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import poisson1_cutoffs, poisson1_weight
from ..session import cut_lineage
from . import curves
from .joins import join_on


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Hash-partition the (narrow) input of a B-fold fan-out over all task slots.

    An explicit partition count is not coalesced by AQE: without it a small input would be
    merged into one partition and the whole fan-out would run as a single task.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        n = max(n, spark.sparkContext.defaultParallelism)
    except Exception:  # remote session: the shuffle partition count alone
        pass
    return df.repartition(n, *[F.col(c) for c in cols])


UNIFORMS_PER_HASH = 4  # an md5 digest has 128 bits: four independent 32-bit uniforms
UNITS_AT_ONCE = 1024   # units whose B weights a task holds at a time
CROWD = 1024           # rows of one score in a block from which its weights are sent by themselves
CELL_FAN = 32          # tasks that share the rows of one (group, score, label) at most


def replicate_weights(df: DataFrame, key: str, n_iterations: int = 1000, seed: int = 42) -> DataFrame:
    """Rows mode: one row per (input row, replicate) with weight w > 0 (fused, not materialised).

    Replicates come in blocks of four: h = md5('seed:key:block'); replicate 4*block + j uses the
    uniform int(h[8j:8j+8], 16) / 2^32. The digest is computed in the projection below the
    generator, once per row and block, and the inverse-CDF CASE reads the generated uniform.
    """
    k = UNIFORMS_PER_HASH
    blocks = (n_iterations + k - 1) // k
    rep = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_blk"))
    rep = rep.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"),
                                                 F.col("_blk").cast("string"))))
    parts = F.array(*[F.struct((F.col("_blk") * k + j).alias("replicate"),
                               (F.conv(F.substring("_h", 8 * j + 1, 8), 16, 10).cast("bigint").cast("double")
                                / F.lit(4294967296.0)).alias("_u"))
                      for j in range(k)])
    rep = rep.select(*[c for c in df.columns], F.inline(parts)).where(F.col("replicate") < n_iterations)
    return rep.withColumn("w", poisson1_weight(F.col("_u"))).drop("_u").where(F.col("w") > 0)


_MD5_ADD = (np.abs(np.sin(np.arange(1, 65))) * 2.0 ** 32).astype(np.uint32)
_MD5_TURN = [t for turns in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in turns * 4]
_MD5_WORD = [(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)]
_MD5_START = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476]


def md5_words(heads: Sequence[bytes], tails: Sequence[bytes]) -> np.ndarray:
    """The digests of all ``head + tail`` as four big-endian words (heads x tails x 4), many at a time.

    Texts of one md5 block (up to 55 bytes) of equal lengths are hashed together; longer ones one by one.
    """
    out = np.empty((len(heads), len(tails), 4), np.uint32)
    by_head, by_tail = ({n: np.flatnonzero([len(v) == n for v in vs]) for n in {len(v) for v in vs}} for vs in (heads, tails))
    for n, hs in by_head.items():
        for m, ts in by_tail.items():
            if n + m > 55:
                digests = b"".join(hashlib.md5(heads[i] + tails[j]).digest() for i in hs for j in ts)
                out[np.ix_(hs, ts)] = np.frombuffer(digests, ">u4").reshape(len(hs), len(ts), 4)
                continue
            first, last = np.zeros((len(hs), 64), np.uint8), np.zeros((len(ts), 64), np.uint8)
            first[:, :n] = np.frombuffer(b"".join(heads[i] for i in hs), np.uint8).reshape(len(hs), n)
            last[:, n:n + m] = np.frombuffer(b"".join(tails[j] for j in ts), np.uint8).reshape(len(ts), m)
            last[:, n + m] = 0x80
            last[:, 56:58] = np.array([8 * (n + m)], "<u2").view(np.uint8)
            first, last = first.view("<u4").astype(np.uint32), last.view("<u4").astype(np.uint32)
            step = max(1, (1 << 14) // len(ts))
            for k in range(0, len(hs), step):
                # a word of the head alone, or of the tail alone, is the same for a whole row, or column
                words = [first[k:k + step, i, None] | last[None, :, i] if last[:, i].any() else first[k:k + step, i, None] for i in range(16)]
                out[np.ix_(hs[k:k + step], ts)] = _md5_block(words, (len(hs[k:k + step]), len(ts)))
    return out


def _md5_block(words: Sequence[np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    a, b, c, d = (np.full(shape, v, np.uint32) for v in _MD5_START)
    t = np.empty(shape, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=t)
            t &= b
            t ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=t)
            t &= d
            t ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=t)
            t ^= d
        else:
            np.invert(d, out=t)
            t |= b
            t ^= c
        t += a
        t += words[_MD5_WORD[i]] + _MD5_ADD[i]
        np.left_shift(t, np.uint32(_MD5_TURN[i]), out=a)
        t >>= np.uint32(32 - _MD5_TURN[i])
        a |= t
        a += b
        a, b, c, d = d, a, b, c
    return np.stack([v + np.uint32(v0) for v, v0 in zip((a, b, c, d), _MD5_START)], axis=-1).byteswap()


def poisson_weights(heads: Sequence[str], n_iterations: int) -> np.ndarray:
    """(heads x replicates): the weights of :func:`replicate_weights` for ``heads`` ('seed:key:')."""
    blocks = -(-n_iterations // UNIFORMS_PER_HASH)
    u = md5_words([h.encode() for h in heads], [str(k).encode() for k in range(blocks)]).reshape(len(heads), -1)[:, :n_iterations]
    w = np.zeros(u.shape, np.uint8)
    for cut in poisson1_cutoffs():                # u / 2^32 is exact, and so is the cutoff times 2^32
        w += u >= np.uint32(np.ceil(cut * 4294967296.0))
    return w


def split_draws(seed: Sequence[int], n_iterations: int, total: int, size: int, chunk: int) -> np.ndarray:
    """How many of ``total`` draws fall on a chunk, in every replicate, when units 0..total-1 are drawn with
    replacement and chunk k holds units k * size ..: conditional binomials down one tree over the chunks.

    Every chunk walks from the root by itself, so no counts travel, and all chunks' draws add up to ``total``.
    """
    low, high = 0, -(-total // size)
    draws = np.full(n_iterations, total, np.int64)
    while high - low > 1:
        mid = (low + high) // 2
        first = (mid - low) * size
        rng = np.random.default_rng([*seed, low, high])
        left = rng.binomial(draws, first / (min(high * size, total) - low * size))
        if chunk < mid:
            draws, high = left, mid
        else:
            draws, low = draws - left, mid
    return draws


class _Draw:
    """(positive weights, negative weights) of units, units x (B + 1); the last column is the unit itself."""

    def __init__(self, mode: str, n_iterations: int, seed: int):
        self.mode, self.b, self.seed, self.size = mode, n_iterations, seed, UNITS_AT_ONCE

    def __call__(self, units: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        keys, pos, neg = (units[c].to_numpy() for c in ("_key", "_pos", "_neg"))
        out = np.empty((2, len(units), self.b + 1), dtype=np.int64)
        out[0, :, -1], out[1, :, -1] = pos, neg
        if self.mode == "cells":
            for i, (k, p, n) in enumerate(zip(keys, pos, neg)):
                rng = np.random.default_rng([self.seed, int(k) & 0xFFFFFFFFFFFFFFFF])
                out[0, i, :-1], out[1, i, :-1] = rng.poisson(p, self.b), rng.poisson(n, self.b)
            return out[0], out[1]
        if self.mode == "rows":
            w = poisson_weights([f"{self.seed}:{k}:" for k in keys], self.b)
        else:                                    # a whole chunk
            seed, chunk = [self.seed, int(units["_gid"].iloc[0]) & 0xFFFFFFFFFFFFFFFF], int(units["_blk"].iloc[0])
            m = split_draws(seed, self.b, int(units["_n"].iloc[0]), self.size, chunk)
            rng = np.random.default_rng([*seed, chunk])
            w = rng.multinomial(m, np.full(len(units), 1.0 / len(units))).T
        out[0, :, :-1], out[1, :, :-1] = w * pos[:, None], w * neg[:, None]
        return out[0], out[1]


def _units(df: DataFrame, key: str, score: str, label: str, g: list[str], mode: str) -> DataFrame:
    """(group..., _score, _pos, _neg, _key): rows, or cells of equal score."""
    if mode in ("rows", "exact"):
        y = F.col(label)
        return df.where(F.col(score).isNotNull() & y.isNotNull()).select(
            *g, F.col(score).cast("double").alias("_score"), (y == 1).cast("bigint").alias("_pos"),
            (y != 1).cast("bigint").alias("_neg"), F.col(key).cast("string").alias("_key"))
    if mode != "cells":
        raise ValueError(f"unknown mode {mode}")
    return curves.score_histogram(df, score, label, g).select(
        *g, F.col("score").cast("double").alias("_score"), F.col("pos").alias("_pos"), F.col("neg").alias("_neg"),
        F.xxhash64(*[F.col(c) for c in g], F.col("score")).alias("_key"))


def _blocks(units: DataFrame, g: list[str], mode: str) -> DataFrame:
    """The units with ``_blk``: the range partition they lie in; for exact draws the chunk of ``UNITS_AT_ONCE``
    units of their group that they belong to in order of score and key, whatever the partitions."""
    n = max(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    keys = [F.col(f"`{c}`") for c in g]
    ranged = units.repartitionByRange(n, *keys, F.col("_score").desc(), F.col("_key"))
    ranged = cut_lineage(ranged.withColumn("_blk", F.spark_partition_id()))
    if mode != "exact":
        return ranged
    per = ranged.groupBy("_blk", *g).agg(F.count(F.lit(1)).alias("_here"))
    of_group = Window.partitionBy(*g)                         # a row a block
    before = F.coalesce(F.sum("_here").over(of_group.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("_blk", *g, before.alias("_before"), F.sum("_here").over(of_group).alias("_n"), F.xxhash64(*keys, F.lit(0)).alias("_gid"))
    at = F.row_number().over(Window.partitionBy("_blk", *g).orderBy(F.col("_score").desc(), "_key"))      # within a block
    ranked = join_on(ranged.withColumn("_at", at), per, ["_blk", *g])
    chunk = ((F.col("_at") + F.col("_before") - 1) / F.lit(UNITS_AT_ONCE)).cast("int")
    return cut_lineage(ranked.withColumn("_blk", chunk).drop("_at", "_before"))


def _by_score(units: pd.DataFrame, draw: _Draw, keep: Callable | None = None):
    """(scores in descending order, positive and negative weights by score) of units, some at a time; a score's
    weights may come in several pieces."""
    if draw.mode == "rows":
        yield from _rows_by_score(units.sort_values(["_score", "_pos", "_key"], ascending=[False, False, True]), draw)
        return
    units = units.sort_values(["_score", "_key"], ascending=[False, True])
    step = len(units) if draw.mode == "exact" else draw.size
    for k in range(0, len(units), max(step, 1)):
        some = units.iloc[k:k + step]
        p, q = draw(some)
        scores = some["_score"].to_numpy()
        first = np.flatnonzero(np.concatenate(([True], scores[1:] != scores[:-1])))
        for at, sp, sn in zip(first, np.add.reduceat(p, first, axis=0), np.add.reduceat(q, first, axis=0)):
            yield scores[at], sp, sn


def _rows_by_score(units: pd.DataFrame, draw: _Draw):
    """The same for rows in order of score and label: small weights are added up before they are widened."""
    scores, pos, keys = (units[c].to_numpy() for c in ("_score", "_pos", "_key"))
    for k in range(0, len(units), draw.size):
        s, y = scores[k:k + draw.size], pos[k:k + draw.size]
        first = np.flatnonzero(np.concatenate(([True], (s[1:] != s[:-1]) | (y[1:] != y[:-1]))))
        w = poisson_weights([f"{draw.seed}:{v}:" for v in keys[k:k + draw.size]], draw.b)
        sums = np.add.reduceat(w.astype(np.uint16), first, axis=0).astype(np.int64)       # UNITS_AT_ONCE small weights at most
        sums = np.concatenate((sums, np.diff([*first, len(s)])[:, None]), axis=1)
        for at, v in zip(first, sums):
            yield s[at], *((v, np.zeros_like(v)) if y[at] else (np.zeros_like(v), v))


def _runs(scores: pd.Series) -> dict[float, float]:
    """Score -> highest score of its run, in descending order, of a block's scores without an entry of their own:
    all but the first, the last and those of ``CROWD`` rows or more."""
    counts = scores.value_counts().sort_index(ascending=False)
    out, run = {}, None
    for s, n in list(counts.items())[1:-1]:
        run = None if n >= CROWD else s if run is None else run
        if run is not None:
            out[s] = run
    return out


def replicate_metrics(df: DataFrame, key: str = "encounter_id", score: str = "score", label: str = "label",
                      group_cols: Sequence[str] = (), n_iterations: int = 1000, seed: int = 42,
                      mode: str = "rows") -> DataFrame:
    """(group..., replicate, auroc, auprc, size) for every replicate; null metric = skipped replicate, size = units drawn.

    Replicate number ``n_iterations`` is the point estimate.
    """
    g = list(group_cols)
    units = _units(df, key, score, label, g, mode)
    placed = _blocks(units, g, mode)
    draw = _Draw(mode, n_iterations, seed)
    names = ["_blk", *g]
    kinds = [f"`{c}` {units.schema[c].dataType.simpleString()}" for c in g]

    def entries(block: pd.DataFrame) -> pd.DataFrame:
        """Weights of a block's first score, of its last, of its crowded ones, and of each run of others between
        (``_inner``): other blocks may hold the first and the last too, but none of those between."""
        run_of = _runs(block["_score"])
        head = next(iter(run_of.values()), np.nan)
        known = {*block["_score"]} - run_of.keys()
        sums: dict = {}
        for s, p, n in _by_score(block, draw):
            at = (run_of[s], True) if s in run_of else (s, False) if s in known and s == s else (head, True)
            sums[at] = (sums[at][0] + p, sums[at][1] + n) if at in sums else (p, n)
        out = pd.DataFrame({"_score": [s for s, _ in sums], "_inner": [i for _, i in sums],
                            "p": [p for p, _ in sums.values()], "n": [n for _, n in sums.values()]})
        return out.assign(**{c: [block[c].iloc[0]] * len(out) for c in names})[[*names, "_score", "_inner", "p", "n"]]

    sums = placed.groupBy(*names).applyInPandas(entries, ", ".join(["_blk int", *kinds, "_score double", "_inner boolean",
                                                                    "p array<bigint>", "n array<bigint>"]))
    # a score that several blocks share becomes one entry
    long = (sums.withColumn("_blk", F.when(F.col("_inner"), F.col("_blk")))
            .select(*names, "_score", "_inner", F.posexplode(F.arrays_zip("p", "n")).alias("replicate", "s"))
            .groupBy(*names, "_score", "_inner", "replicate").agg(F.sum("s.p").alias("p"), F.sum("s.n").alias("n")))
    # at most three entries a block and two a crowded score; between a block's first and last score there is no other block's entry
    before = Window.partitionBy(*g, "replicate").orderBy(F.col("_score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    entry = cut_lineage(long.withColumns({"tp": F.coalesce(F.sum("p").over(before), F.lit(0)), "fp": F.coalesce(F.sum("n").over(before), F.lit(0))}))
    p, n, tp, fp = (F.col(c).cast("double") for c in ("p", "n", "tp", "fp"))
    shared = entry.where("not _inner").select(*g, "replicate", (n * tp + F.lit(0.5) * n * p).alias("up"),
                                              F.when(p > 0, p * (tp + p) / (tp + p + fp + n)).otherwise(0.0).alias("ap"),
                                              p.alias("p"), n.alias("n"))

    def partials(block: pd.DataFrame, offs: pd.DataFrame) -> pd.DataFrame:
        ident = {c: block[c].iloc[0] for c in g}
        run_of = _runs(block["_score"])
        block = block[block["_score"].isin(run_of.keys())] if draw.mode != "exact" else block
        if not len(offs) or not run_of:                            # nothing lies between the scores that have entries
            return pd.DataFrame({**{c: [v] for c, v in ident.items()}, "replicate": [0], "up": [0.0], "ap": [0.0], "p": [0.0], "n": [0.0]})
        offs = offs.sort_values("replicate")
        offset_of = {s: [some[c].to_numpy().astype(np.float64) for c in ("tp", "fp")] for s, some in offs.groupby("_score")}
        tp, fp = offset_of[next(iter(run_of.values()))]
        up = ap = P = N = np.zeros(len(tp))
        held, last = None, None                                    # the score that is being summed up

        def close():
            nonlocal up, ap, tp, fp, P, N
            p, n = held
            up = up + n * tp + 0.5 * n * p
            tp, fp = tp + p, fp + n
            with np.errstate(invalid="ignore", divide="ignore"):
                ap = ap + np.where(p > 0, p * tp / (tp + fp), 0.0)
            P, N = P + p, N + n
        for s, sp, sn in _by_score(block, draw):
            if s not in run_of:
                continue
            sp, sn = sp.astype(np.float64), sn.astype(np.float64)
            if s == last:
                held = (held[0] + sp, held[1] + sn)
                continue
            if last is not None:
                close()
            if run_of[s] == s:                                     # the first score of a run
                tp, fp = offset_of[s]
            held, last = (sp, sn), s
        if last is not None:
            close()
        out = {c: [v] * len(tp) for c, v in ident.items()}
        return pd.DataFrame({**out, "replicate": np.arange(len(tp)), "up": up, "ap": ap, "p": P, "n": N})

    schema = ", ".join([*kinds, "replicate int, up double, ap double, p double, n double"])
    offsets = entry.where("_inner").select(*names, "_score", "replicate", "tp", "fp")
    between = placed.groupBy(*names).cogroup(offsets.groupBy(*names)).applyInPandas(partials, schema)
    P, N = F.sum("p"), F.sum("n")
    ok = (P > 0) & (N > 0)
    return shared.unionByName(between).groupBy(*g, "replicate").agg(
        F.when(ok, F.sum("up") / (P * N)).alias("auroc"), F.when(ok, F.sum("ap") / P).alias("auprc"), (P + N).cast("bigint").alias("size"))


def bootstrap_ci(df: DataFrame, key: str = "encounter_id", score: str = "score", label: str = "label",
                 group_cols: Sequence[str] = (), n_iterations: int = 1000, ci: float = 0.95,
                 seed: int = 42, max_skip: float = 0.10, mode: str = "rows",
                 suppress_unreliable: bool = True, decimals: int = 3) -> DataFrame:
    """Point estimates and percentile CIs of AUROC and AUPRC from the same replicates, plus skip counts.

    A replicate that yields no metric (single class, or empty) is skipped; ``unreliable`` flags a
    skipped share above ``max_skip`` (the reference's warning). With ``suppress_unreliable`` (the
    subgroup-audit rule, A24) the four CI columns are then null; otherwise they are kept (A22), and
    they are null only when no replicate is left. CIs use exact linear-interpolated percentiles
    (never an approximate percentile); all are rounded to ``decimals``.
    """
    g = list(group_cols)
    rep = replicate_metrics(df, key, score, label, g, n_iterations, seed, mode)
    alpha = (1.0 - ci) / 2.0
    lo, hi = F.lit(alpha), F.lit(1.0 - alpha)
    drawn = F.col("replicate") < n_iterations
    roc, ap = F.when(drawn, F.col("auroc")), F.when(drawn, F.col("auprc"))
    agg = rep.groupBy(*g).agg(
        F.max(F.when(~drawn, F.col("auroc"))).alias("auroc"), F.max(F.when(~drawn, F.col("auprc"))).alias("auprc"),
        F.count(roc).cast("bigint").alias("n_ok"),
        F.percentile(roc, lo).alias("auroc_ci_low"), F.percentile(roc, hi).alias("auroc_ci_high"),
        F.percentile(ap, lo).alias("auprc_ci_low"), F.percentile(ap, hi).alias("auprc_ci_high"))
    skipped = (F.lit(n_iterations) - F.col("n_ok")).cast("bigint")
    reliable = skipped.cast("double") / F.lit(float(n_iterations)) <= F.lit(max_skip)
    keep = reliable if suppress_unreliable else F.lit(True)
    cols = ("auroc_ci_low", "auroc_ci_high", "auprc_ci_low", "auprc_ci_high")
    flag = [] if suppress_unreliable else [(~reliable).alias("unreliable")]
    def rounded(c: str) -> Column:   # through 9 decimals, so that the order of a sum can't turn a tie
        return F.round(F.col(c).cast("decimal(18,9)"), decimals).cast("double")
    return agg.select(*g, *[rounded(c).alias(c) for c in ("auroc", "auprc")], skipped.alias("skipped"),
                      *[F.when(keep, rounded(c)).alias(c) for c in cols], *flag)


def bootstrap_custom_metric(df: DataFrame, metric_fn: Callable[[np.ndarray, np.ndarray, np.ndarray], float],
                            key: str = "encounter_id", score: str = "score", label: str = "label",
                            group_cols: Sequence[str] = (), n_iterations: int = 200, seed: int = 42) -> DataFrame:
    """User-supplied metric f(y, p, w) per (group, replicate) via grouped ``applyInPandas``.

    Rows are first reduced to weighted (group, replicate, score, label) cells by a partial
    aggregation, so a pandas frame holds one group-replicate's distinct (score, label) cells with
    their weights, not its rows; the metric must accept sample weights ``w``.
    """
    g = list(group_cols)
    reps = replicate_weights(spread(df.select(*g, key, score, label), key), key, n_iterations, seed)
    cells = (reps.groupBy(*g, "replicate", F.col(score).cast("double").alias("_p"),
                          F.col(label).cast("int").alias("_y"))
             .agg(F.sum("w").cast("double").alias("_w")))
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in g] +
                       ["replicate int", "value double"])

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf["_y"].to_numpy()
        v = None
        if (y == 1).any() and (y == 0).any():
            v = float(metric_fn(y, pdf["_p"].to_numpy(), pdf["_w"].to_numpy()))
        row = {c: [pdf[c].iloc[0]] for c in g}
        row.update(replicate=[int(pdf["replicate"].iloc[0])], value=[v])
        return pd.DataFrame(row)

    return cells.groupBy(*g, "replicate").applyInPandas(apply, schema)


def bootstrap_metric_columns(df: DataFrame, metric: Callable[[Column, Column, Column], Column],
                             key: str = "encounter_id", score: str = "score", label: str = "label",
                             group_cols: Sequence[str] = (), n_iterations: int = 200, seed: int = 42) -> DataFrame:
    """D1, distributed form: a metric written as a Column aggregate of (y, p, w), e.g.
    ``lambda y, p, w: F.sum(w * (p - y) ** 2) / F.sum(w)``, evaluated per (group, replicate) by a
    partial aggregation - no group is ever gathered into one task. Same replicates as the pandas
    form; a replicate with a single class yields null.

    As there, the metric must accept sample weights: rows of a group with equal label and score
    come to it as one row with the sum of their weights (or a few, from several tasks). A task
    draws the weights of its rows in all replicates and sends a vector a cell, not a pair a row
    and replicate.
    """
    g = list(group_cols)
    cell = [f"_g{i}" for i in range(len(g))] + ["_y", "_p"]
    rows = df.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(g, cell)], F.col(label).cast("double").alias("_y"), F.col(score).cast("double").alias("_p"),
                     F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), F.lit("")).alias("_head"))
    # rows of a cell lie side by side; a cell of very many rows is spread over several tasks
    near = spread(rows.withColumn("_salt", F.pmod(F.xxhash64("_head"), F.lit(CELL_FAN))), *cell, "_salt").drop("_salt").sortWithinPartitions(*cell)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4 * UNITS_AT_ONCE):
                some = batch.slice(k, 4 * UNITS_AT_ONCE)
                at = np.zeros(some.num_rows, np.int64)
                for c in cell:
                    codes = some.column(c).dictionary_encode(null_encoding="encode")
                    at = np.unique(at * (len(codes.dictionary) + 1) + codes.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
                _, one, at = np.unique(at, return_index=True, return_inverse=True)
                order, heads = np.argsort(at, kind="stable"), some.column("_head").to_pylist()
                w = np.zeros((len(one), n_iterations), np.int64)
                for j in range(0, len(order), UNITS_AT_ONCE):
                    part = order[j:j + UNITS_AT_ONCE]
                    starts = np.flatnonzero(np.diff(at[part], prepend=-1))
                    w[at[part[starts]]] += np.add.reduceat(poisson_weights([heads[i] for i in part], n_iterations), starts, axis=0, dtype=np.int64)
                offsets = np.arange(len(one) + 1, dtype=np.int32) * n_iterations
                yield pa.RecordBatch.from_arrays([*(some.column(c).take(pa.array(one)) for c in cell),
                                                  pa.ListArray.from_arrays(pa.array(offsets), pa.array(w.ravel()))], [*cell, "ws"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in cell)
    cells = near.mapInArrow(run, f"{kinds}, ws array<bigint>")
    pairs = cells.select(*cell, F.posexplode("ws").alias("replicate", "w")).where("w > 0")
    y, p, w = F.col("_y"), F.col("_p"), F.col("w").cast("double")
    out = pairs.groupBy(*cell[:-2], "replicate").agg(F.when(F.max(y) > F.min(y), metric(y, p, w)).alias("value"))
    return out.select(*[F.col(a).alias(c) for c, a in zip(g, cell)], "replicate", "value")

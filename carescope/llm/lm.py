"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

Tokens: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, then one end token. Each token has a class:
the end, one of the ``TOP`` most frequent words, or one of ``GROUPS`` groups of the other words
(by the crc32 of their last two characters). The model gives P(class | the two classes before);
within a group a word has its smoothed share, (c + 0.5) over the group's sum of c + 0.5 and 0.5
for words never met. A token's log probability is the sum of both, and the probabilities of all
words and the unmet word of each group sum to one.

Model: the context vectors of the two classes before, each through a matrix of its position, add
up to a predicted vector; its product with a class's vector, and the class's bias, is the score.
Noise-contrastive estimation, in numpy on the driver, with the classes' frequencies as noise,
trains on the counts of all class triples of all training documents: these counts, at most the
third power of the number of classes, are all that training needs of the corpus. Every step takes
the gradient over all of these counts and the expectation over the noise; nothing is drawn but the
first vectors. The scores of all contexts are then normalised by batched matrix products.

Counts of all training words come from the whole corpus. Tasks know up to ``KNOWN`` of the most
frequent words (a bounded table); the other words of each document meet their counts in a join.

Cases: a null text counts as empty (the end token alone); repeated rows repeat; an empty table
gives an empty result; without training documents all counts are zero; texts of any length are
scored whole, in runs of words. Only the id and text columns are read, so other columns, whatever
their names, do not matter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from math import log10

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carescope.llm.common import Kept, cut_lineage, id_fold, whole_text

TOP, GROUPS = 95, 32
CLASSES = 1 + TOP + GROUPS          # class 0 is the end, which also stands before a text
KNOWN = 200_000                     # words whose counts every task holds
END = "\n"                          # no word holds it
DIM, NOISE, STEPS, RATE, SEED = 32, 64, 300, 0.02, 5
RUN = 1 << 16                       # words handled at once
LONG = 1 << 22                      # bytes from which words are found one by one
FLUSH = 300_000                     # distinct words counted in a task before they are sent on
WORDS = 500_000                     # words kept in a worker, in each of two generations
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ENTRY = np.dtype([("class", "<i2"), ("known", "i1"), ("asked", "i1"), ("log_c", "<f8")])


def word_runs(text: str) -> Iterator[list[bytes]]:
    """The words in runs; bytes.lower and bytes.split know A-Z and the ASCII blanks only."""
    data = text.encode("utf-8").lower()
    if len(data) < LONG:
        words = data.split()
        for k in range(0, len(words), RUN):
            yield words[k:k + RUN]
    else:
        found = (m[0] for m in WORD.finditer(data))
        while run := list(islice(found, RUN)):
            yield run


def group_of(word: bytes) -> int:
    return 1 + TOP + zlib.crc32(word.decode("utf-8")[-2:].encode("utf-8")) % GROUPS


def word_counts(training: DataFrame) -> DataFrame:
    """word, c over all training texts; the end token is ``END``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()

        def rows() -> pd.DataFrame:
            return pd.DataFrame({"word": [w.decode("utf-8") for w in counts], "c": list(counts.values())})
        for batch in batches:
            for text in batch["text"]:
                for words in word_runs(text):
                    counts.update(words)
                counts[END.encode()] += 1
                if len(counts) > FLUSH:
                    yield rows()
                    counts.clear()
        if counts:
            yield rows()
    return training.mapInPandas(run, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def class_triples(training: DataFrame, top: dict[bytes, int]) -> np.ndarray:
    """Counts of (class two before, class before, class), over all training texts."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes = Kept(lambda w: np.int16(top.get(w) or group_of(w)).tobytes(), WORDS)
        counts = np.zeros(CLASSES ** 3, dtype=np.int64)
        held, size = [], 0

        def add() -> None:
            codes = np.concatenate(held) if held else np.zeros(0, dtype=np.int64)
            counts[:] += np.bincount(codes, minlength=len(counts))
        for batch in batches:
            for text in batch["text"]:
                before = np.zeros(2, dtype=np.int64)
                for words in (*word_runs(text), None):
                    own = np.zeros(1, np.int64) if words is None else np.frombuffer(b"".join(classes.many(words)), "<i2")
                    line = np.concatenate((before, own)).astype(np.int64)
                    held.append((line[:-2] * CLASSES + line[1:-1]) * CLASSES + line[2:])
                    before, size = line[-2:], size + len(own)
                if size >= 1 << 20:
                    add()
                    held, size = [], 0
        add()
        code = np.flatnonzero(counts)
        yield pd.DataFrame({"code": code, "c": counts[code]})
    sums = training.mapInPandas(run, "code bigint, c bigint").groupBy("code").agg(F.sum("c").alias("c"))
    out = np.zeros(CLASSES ** 3)
    for code, c in packed(sums, "code", "c"):
        out[np.frombuffer(code, dtype=np.int64)] = np.frombuffer(c, dtype=np.int64)
    return out


def packed(df: DataFrame, key: str, count: str) -> Iterator[tuple[bytes, bytes]]:
    """Keys (longs, or strings by lines) and counts of a bounded table, one pair of byte strings a batch."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = batch[key]
            data = "\n".join(keys).encode("utf-8") if keys.dtype == object else keys.to_numpy(dtype=np.int64).tobytes()
            yield pd.DataFrame({"k": [data], "c": [batch[count].to_numpy(dtype=np.int64).tobytes()]})
    for row in df.select(key, count).mapInPandas(run, "k binary, c binary").collect():
        yield bytes(row["k"]), bytes(row["c"])


def train(triples: np.ndarray, steps: int = STEPS, seed: int = SEED) -> np.ndarray:
    """log10 P(class | two classes before), CLASSES^2 x CLASSES, of a model trained on the counts."""
    rng = np.random.default_rng(seed)
    by_class = triples.reshape(-1, CLASSES).sum(axis=0) + 0.5
    noise_log = np.log(by_class / by_class.sum())
    context = rng.normal(0, 0.1, (CLASSES, DIM))
    position = [np.eye(DIM) * 0.5, np.eye(DIM)]          # two before, one before
    target, bias = rng.normal(0, 0.1, (CLASSES, DIM)), noise_log.copy()
    params = [context, *position, target, bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    seen = np.flatnonzero(triples.reshape(-1, CLASSES).any(axis=1))        # contexts: class two before * CLASSES + class before
    a, b = seen // CLASSES, seen % CLASSES
    share = (triples.reshape(-1, CLASSES)[seen] / max(triples.sum(), 1.0)).astype(np.float32)
    noise_share = (NOISE * share.sum(axis=1, keepdims=True) * np.exp(noise_log)).astype(np.float32)
    log_noise = np.log(NOISE) + noise_log
    for step in range(1, steps + 1 if len(seen) else 1):
        q = (context @ position[0])[a] + (context @ position[1])[b]
        told = (q.astype(np.float32) @ target.T.astype(np.float32)) + (bias - log_noise).astype(np.float32)
        # gradients of the log likelihood of telling data from noise, over all triples and all noise
        np.clip(told, -50, 50, out=told)
        told = 1 / (1 + np.exp(-told))
        up = share - (share + noise_share) * told
        q_up = (up @ target.astype(np.float32)).astype(float)
        one, two = np.zeros((CLASSES, DIM)), np.zeros((CLASSES, DIM))
        np.add.at(one, a, q_up)
        np.add.at(two, b, q_up)
        ups = [one @ position[0].T + two @ position[1].T, context.T @ one, context.T @ two,
               up.T @ q.astype(np.float32), up.sum(axis=0, dtype=float)]
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, m, v in zip(params, ups, first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p += rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    out = np.empty((CLASSES, CLASSES, CLASSES))
    for a in range(CLASSES):                              # one batched product for each first class
        q = context[a] @ position[0] + context @ position[1]
        scores = q @ target.T + bias
        scores -= scores.max(axis=1, keepdims=True)
        out[a] = (scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))) / np.log(10)
    return out.reshape(CLASSES ** 2, CLASSES)


def count_step() -> Column:
    """Logarithmic step of a word's count: equal counts share a step, and there are few steps."""
    return F.floor(F.ln(F.col("c").cast("double")) * 32)


def known_from(words: DataFrame) -> int:
    """The least step from which on at most ``KNOWN`` words lie; found from the steps' sizes, without a sort."""
    total, least = 0, None
    steps = words.groupBy(count_step().alias("s")).count().collect()     # a thousand steps hold any count
    for step, n in sorted(((r["s"], r["count"]) for r in steps), reverse=True):
        total += n
        if total > KNOWN:
            break
        least = step
    return least if least is not None else 1 << 40


def score_documents(docs: DataFrame, fold: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learned from the
    documents whose id fold (crc32 of the id modulo 5) is not ``fold``."""
    spark = docs.sparkSession
    narrow = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                         (id_fold(id_col) == fold).alias("held_out"), whole_text(text_col).alias("text"))
    training = docs.where(id_fold(id_col) != fold).select(whole_text(text_col).alias("text"))
    counts = cut_lineage(word_counts(training))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()

    words = counts.where(F.col("word") != END)
    most = words.orderBy(F.desc("c"), "word").limit(TOP).collect()
    top = {r["word"].encode("utf-8"): k + 1 for k, r in enumerate(most)}
    known = {r["word"].encode("utf-8"): int(r["c"]) for r in most}
    for keys, cs in packed(words.where(count_step() >= known_from(words)), "word", "c"):
        known.update(zip(keys.split(b"\n"), np.frombuffer(cs, dtype=np.int64).tolist()))
    end_count = next((r["c"] for r in counts.where(F.col("word") == END).collect()), 0)
    group = F.crc32(F.substring("word", -2, 2).cast("binary")) % GROUPS
    others = counts.where((F.col("word") != END) & ~F.col("word").isin([w.decode("utf-8") for w in top]))
    sizes = {r["g"]: r["s"] for r in others.groupBy(group.alias("g")).agg(F.sum(F.col("c") + 0.5).alias("s")).collect()}
    log_size = np.zeros(CLASSES)
    for g in range(GROUPS):
        log_size[1 + TOP + g] = log10(sizes.get(g, 0.0) + 0.5)
    # at most CLASSES^3 floats and KNOWN words, at any input size
    held = spark.sparkContext.broadcast((train(class_triples(training, top)).astype(np.float32), known, top, log_size))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, known, top, log_size = held.value

        def entry(word: bytes) -> bytes:
            c = known.get(word)
            return np.array([(top.get(word) or group_of(word), c is not None, c is None, log10((c or 0) + 0.5))], ENTRY).tobytes()
        entries = Kept(entry, WORDS)
        end = np.array([(0, end_count > 0, 0, log10(end_count + 0.5))], ENTRY)
        for batch in batches:
            found, asked = [], []
            for row, doc_id, held_out, text in batch[["row", "doc_id", "held_out", "text"]].itertuples(index=False):
                before, rest = np.zeros(2, dtype=np.int64), Counter()
                tokens = sure = 0
                model = rare = every = 0.0
                for words in (*word_runs(text), None):
                    own = end if words is None else np.frombuffer(b"".join(entries.many(words)), ENTRY)
                    line = np.concatenate((before, own["class"].astype(np.int64)))
                    model += float(table[line[:-2] * CLASSES + line[1:-1], line[2:]].sum(dtype=np.float64)) - float(log_size[line[2:]].sum())
                    here = own["asked"] == 0
                    tokens, sure = tokens + len(own), sure + int(own["known"].sum())
                    every += float(own["log_c"][here].sum())
                    rare += float(own["log_c"][here & (line[2:] > TOP)].sum())
                    rest.update([words[k] for k in np.flatnonzero(~here)])
                    before = line[-2:]
                found.append((row, None if pd.isna(doc_id) else int(doc_id), held_out, tokens, sure, model, rare, every, f"{END}{row}", 0))
                asked += [(row, None, None, 0, 0, 0.0, 0.0, 0.0, w.decode("utf-8"), k) for w, k in rest.items()]
                if len(asked) > RUN:
                    yield _frame(found + asked)
                    found, asked = [], []
            yield _frame(found + asked)

    parts = narrow.mapInPandas(run, PARTS).join(counts.select(F.col("word").alias("w2"), "c"), F.col("word") == F.col("w2"), "left")
    log_c = F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    total = parts.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("n_known"),
        F.sum("model").alias("model"), F.sum(F.col("rare") + log_c).alias("rare"), F.sum(F.col("every") + log_c).alias("every"))
    return total.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        (F.col("every") - F.col("n_tokens") * F.lit(log10(n + 0.5 * (v + 1)))).alias("base_score"),
        (F.col("model") + F.col("rare")).alias("score"))


PARTS = ("row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, model double, rare double, "
         "every double, word string, times bigint")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in PARTS.split(", ")]
    return pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64", "held_out": "boolean"})

"""Phrase collocations: exact counts of phrases of up to five words, with a HAT-trie in every task.

Words of at least ``least`` occurrences are counted first; the corpus is then written once as rows
of word ids (0 stands for a piece's end or for words that no frequent phrase can hold). An id is the
rank of the word's hash among the frequent ones while these are at most ``RANKED``, beyond that the
64-bit hash itself; hashes are checked to be one to one. Level k counts the phrases of k words both of whose parts of k - 1
words are frequent; what is frequent is told to the tasks by a bit map of fixed size, whose false
positives only cause phrases to be counted that are dropped afterwards. Counts are exact.

``HatTrie`` counts in a task: a shallow trie over the first two words' ids leads to hash
containers (arrays in hash order), a container that grows over ``BURST`` entries bursts into
containers one level deeper, and when the trie is full its largest subtrees are spilled whole, as
sorted runs cut by prefix partition. The runs of a prefix partition meet in one task and are
merged there. A run is one row, so the shuffle moves packed arrays.

Scores are taken over all cuts of a phrase in exact decimal arithmetic.

Cases: a null text counts as empty, a null language as ``und``; empty texts and tables have no
phrases; repeated rows count as often as they occur; ties are ordered by the phrase's UTF-8 bytes;
texts of any length are read whole, in slices that overlap; only the text and language columns are
read, so other columns, whatever their names, do not matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from zlib import crc32

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carescope.llm.common import cut_lineage, shared_folder, whole_text
from carescope.session import remove_folder

LONGEST = 5                 # words of a phrase at most
BITS = 25                   # the bit map of frequent phrases has 2**BITS bits
HELD = 1_500_000              # entries of a task's trie before subtrees are spilled
RANKED = 4_000_000          # frequent words whose hashes tasks are given, 8 bytes each
MERGES = 2                  # prefix partitions for each shuffle partition: a merge holds one
BURST = 50_000              # entries of a container before it bursts
WORDS = 600_000             # distinct words that a task holds at once
SLICE = 200_000             # ids of a row of the stream, about
BYTES = 2_000_000           # that a task is given and splits at once, about
END = b"\xff"               # no UTF-8 text holds this byte
TABLE = bytes(ord(END) if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
CUT = re.compile(rb"[\x09\x20\xff]")
COUNTS = "lang string, word string, id bigint, n bigint"
STREAM = "lang string, own int, ids binary"
RUNS = "part int, lang string, words binary, counts binary"
PHRASES = "lang string, words array<bigint>, n bigint"
ODD = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """Words in order, with ``END`` between pieces, in lists of bounded length."""
    text, start = text.translate(TABLE), 0
    while start < len(text):
        cut = CUT.search(text, start + BYTES)
        stop = cut.start() if cut else len(text)
        yield text[start:stop].replace(END, b" \xff ").split()
        start = stop


def word_ids(words: list[bytes], lang: str, seed: int) -> np.ndarray:
    """Signed 64-bit hashes; 0 is left to breaks (a word that hashes to it counts as a collision)."""
    own, digest = seed + crc32(lang.encode()), xxhash.xxh64_intdigest
    return np.fromiter((digest(w, own) for w in words), np.uint64, len(words)).view(np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * ODD
    return (x ^ (x >> np.uint64(29))) * ODD


def phrase_hash(words: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of phrases given as columns of ids."""
    out = np.zeros(len(words[0]), np.uint64)
    for column in words:
        out = _mixed(out + column.view(np.uint64))
    return out


def container_key(words: np.ndarray) -> np.ndarray:
    """Sort key of rows of ids: 16 bits of the first two words (the trie's path), 48 of all."""
    columns = [np.ascontiguousarray(words[:, j]) for j in range(words.shape[1])]
    path = phrase_hash(columns[:2])
    return (path & np.uint64(0xFFFF << 48)) | (phrase_hash(columns) >> np.uint64(16))


def summed(keys: np.ndarray, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries in order of their key, equal phrases summed. Different phrases of one key stay apart."""
    order = np.argsort(keys)
    keys, words = keys[order], words[order]
    same = keys[1:] == keys[:-1]
    if not np.array_equal((words[1:] == words[:-1]).all(axis=1), same):
        again = np.lexsort((*words.T, keys))
        order, keys, words = order[again], keys[again], words[again]
        same = (words[1:] == words[:-1]).all(axis=1) & (keys[1:] == keys[:-1])
    first = np.flatnonzero(np.concatenate(([True], ~same))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], words[first], np.add.reduceat(counts[order], first) if len(keys) else counts


class Container:
    """Counts by phrase in hash order, and additions not yet merged in."""

    def __init__(self, length: int):
        self.keys, self.words, self.counts = np.zeros(0, np.uint64), np.zeros((0, length), np.int64), np.zeros(0, np.int64)
        self.added: list = []
        self.waiting = 0

    def add(self, keys, words, counts) -> None:
        self.added.append((keys, words, counts))
        self.waiting += len(keys)
        if self.waiting > max(len(self.keys), 4096):
            self.merge()

    def merge(self) -> None:
        if self.added:
            parts = [(self.keys, self.words, self.counts), *self.added]
            self.keys, self.words, self.counts = summed(*(np.concatenate([p[j] for p in parts]) for j in range(3)))
            self.added, self.waiting = [], 0

    def size(self) -> int:
        return len(self.keys) + self.waiting

    def run(self) -> list:
        self.merge()
        return [(self.keys, self.words, self.counts)]


class Branch:
    """256 children by one byte of the path; a child is a container until it bursts."""

    def __init__(self, length: int, level: int):
        self.length, self.level = length, level
        self.children: dict[int, Container | Branch] = {}
        self.borders = None

    def add(self, keys, words, counts) -> None:
        """Entries in order of their key, so that a child's are a slice."""
        byte = ((keys >> np.uint64(56 - 8 * self.level)) & np.uint64(255)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], byte[1:] != byte[:-1])))
        for a, b in zip(starts, [*starts[1:], len(keys)]):
            at = int(byte[a])
            child = self.children.get(at)
            if child is None:
                child = self.children[at] = Container(self.length)
            child.add(keys[a:b], words[a:b], counts[a:b])
            if isinstance(child, Container) and len(child.keys) > BURST and self.level == 0:
                deeper = Branch(self.length, self.level + 1)
                deeper.add(*child.run()[0])
                self.children[at] = deeper

    def size(self) -> int:
        return sum(c.size() for c in self.children.values())

    def run(self) -> list:
        return [part for at in sorted(self.children) for part in self.children[at].run()]


class HatTrie:
    """Counts phrases of one length; gives whole subtrees as sorted runs when it is full and at the end."""

    def __init__(self, length: int, held: int = HELD):
        self.root, self.held, self.length = Branch(length, 0), held, length

    def add(self, words: np.ndarray, counts: np.ndarray | None = None) -> list:
        """Count rows of ids; returns the runs spilled."""
        if not len(words):
            return []
        counts = np.ones(len(words), np.int64) if counts is None else counts
        self.root.add(*summed(container_key(words), words, counts))
        return self.spill(self.held // 2) if self.root.size() > self.held else []

    def spill(self, keep: int = 0) -> list:
        """Runs (keys, words, counts) of the largest subtrees, until ``keep`` entries are left."""
        out, left = [], self.root.size()
        for at in sorted(self.root.children, key=lambda k: -self.root.children[k].size()):
            if left <= keep:
                break
            child = self.root.children.pop(at)
            left -= child.size()
            parts = child.run()
            out.append(tuple(np.concatenate([p[j] for p in parts]) for j in range(3)))
        return out


def _by_lang(batch: pd.DataFrame) -> Iterator[tuple[str, bytes]]:
    """Texts of a language joined, some at a time."""
    for lang, texts in batch.groupby("lang")["text"]:
        some, size = [], 0
        for text in texts:
            some.append(text.encode())
            size += len(some[-1])
            if size > BYTES:
                yield lang, END.join(some)
                some, size = [], 0
        yield lang, END.join(some)


def _languages(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), whole_text(text_col).alias("text"))


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """(lang, word, id, n) of all words of (lang, text) rows."""
    def rows(lang: str, counter: Counter) -> pd.DataFrame:
        counter.pop(END, None)
        words = list(counter)
        return pd.DataFrame({"lang": lang, "word": [w.decode() for w in words], "id": word_ids(words, lang, seed),
                             "n": list(counter.values())})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in _by_lang(batch):
                for some in tokens(text):
                    held.setdefault(lang, Counter()).update(some)
                if sum(map(len, held.values())) > WORDS:
                    for name in list(held):
                        yield rows(name, held.pop(name))
        for name in list(held):
            yield rows(name, held.pop(name))

    return docs.mapInPandas(run, COUNTS).groupBy("lang", "word", "id").agg(F.sum("n").alias("n"))


class Ranks:
    """Words by the rank of their hash among all frequent ones: 32-bit ids for a vocabulary of bounded size."""

    kind = "<u4"

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """1 + rank of frequent words, 0 for others."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        return np.where(self.hashes[at] == hashes, at + 1, 0) if len(self.hashes) else np.zeros(len(hashes), np.int64)


class Hashes:
    """Words by their hash, where the vocabulary is larger; what is frequent is told by a bit map."""

    kind = "<i8"

    def __init__(self, words: Frequent):
        self.words = words

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        return np.where(self.words.has(phrase_hash([hashes])), hashes, 0)


class Frequent:
    """A bit map of fixed size; ``has`` may be wrongly true, never wrongly false."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - BITS)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def frequent(phrases: DataFrame) -> Frequent:
    """The bit map of phrases (``words`` arrays of one length): at most 2**BITS / 64 rows reach the driver."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = np.array(batch["words"].tolist(), np.int64)
            if len(words):
                at = phrase_hash([np.ascontiguousarray(c) for c in words.T]) >> np.uint64(64 - BITS)
                yield pd.DataFrame({"slot": (at >> np.uint64(6)).astype(np.int64), "bits": (np.uint64(1) << (at & np.uint64(63))).view(np.int64)})

    slots = phrases.select("words").mapInPandas(run, "slot bigint, bits bigint").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(1 << BITS - 6, np.int64)
    out[slots["slot"].to_numpy(np.int64)] = slots["bits"].to_numpy(np.int64)
    return Frequent(out.view(np.uint64))


def _squeezed(ids: np.ndarray) -> np.ndarray:
    """Ids with breaks, without words that have no neighbour and without repeated breaks."""
    ids = np.concatenate(([0], ids, [0]))
    full = ids != 0
    ids[1:-1][~(full[:-2] | full[2:])] = 0
    return ids[1:][(ids[1:] != 0) | (ids[:-1] != 0)]


def id_stream(docs: DataFrame, coded: Ranks | Hashes, seed: int) -> DataFrame:
    """Rows of word ids; phrases that begin in the first ``own`` ids of a row are the row's."""
    def slices(lang: str, ids: np.ndarray) -> pd.DataFrame:
        starts = range(0, len(ids), SLICE)
        return pd.DataFrame({"lang": lang, "own": [min(SLICE, len(ids) - a) for a in starts],
                             "ids": [ids[a:a + SLICE + LONGEST - 1].astype(coded.kind).tobytes() for a in starts]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, dict] = {}
        for batch in batches:
            for lang, text in _by_lang(batch):
                parts = []
                for found in tokens(text):
                    if sum(map(len, known.values())) > WORDS:
                        known.clear()
                    codes = known.setdefault(lang, {END: 0})
                    new = [w for w in set(found) if w not in codes]
                    if new:
                        ids = word_ids(new, lang, seed)
                        codes.update(zip(new, coded.ids(ids).tolist()))
                    parts.append(np.fromiter(map(codes.__getitem__, found), np.int64, len(found)))
                if parts:
                    yield slices(lang, _squeezed(np.concatenate(parts)))

    return docs.mapInPandas(run, STREAM)


def phrases_in(ids: np.ndarray, own: int, length: int, shorter: Frequent | None) -> np.ndarray:
    """Rows of ids of the phrases that begin in the first ``own`` ids and whose parts may be frequent."""
    n = len(ids) - length + 1
    if n <= 0:
        return np.zeros((0, length), np.int64)
    full = ids != 0
    inside = full[:len(ids) - length + 2].copy()
    for j in range(1, length - 1):
        inside &= full[j:len(ids) - length + 2 + j]
    if shorter is not None:
        at = np.flatnonzero(inside)
        inside[at] = shorter.has(phrase_hash([ids[at + j] for j in range(length - 1)]))
    starts = np.flatnonzero((inside[:-1] & inside[1:])[:own])
    return np.stack([ids[starts + j] for j in range(length)], axis=1)


def count_phrases(stream: DataFrame, length: int, shorter: Frequent | None, least: int, kind: str) -> DataFrame:
    """The phrases of ``length`` words of at least ``least`` occurrences, with their counts."""
    parts = MERGES * int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def rows(lang: str, runs: list) -> Iterator[pd.DataFrame]:
        for keys, words, counts in runs:
            part = ((keys >> np.uint64(48)).astype(np.int64) * parts) >> 16
            starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            stops = [*starts[1:], len(part)]
            yield pd.DataFrame({"part": part[starts], "lang": lang, "words": [words[a:b].astype(kind).tobytes() for a, b in zip(starts, stops)],
                                "counts": [counts[a:b].tobytes() for a, b in zip(starts, stops)]})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tries: dict[str, HatTrie] = {}
        for batch in batches:
            for lang, own, ids in zip(batch["lang"], batch["own"], batch["ids"]):
                trie = tries.setdefault(lang, HatTrie(length))
                yield from rows(lang, trie.add(phrases_in(np.frombuffer(ids, kind).astype(np.int64), own, length, shorter)))
                if sum(t.root.size() for t in tries.values()) > HELD:
                    yield from rows(lang, trie.spill())
        for lang, trie in tries.items():
            yield from rows(lang, trie.spill())

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Container] = {}
        for batch in batches:
            for lang, words, counts in zip(batch["lang"], batch["words"], batch["counts"]):
                words = np.frombuffer(words, kind).astype(np.int64).reshape(-1, length)
                held.setdefault(lang, Container(length)).add(container_key(words), words, np.frombuffer(counts, np.int64))
        for lang, container in held.items():
            (_, words, counts), = container.run()
            often = counts >= least
            if often.any():
                yield pd.DataFrame({"lang": lang, "words": list(words[often]), "n": counts[often]})

    return stream.mapInPandas(count, RUNS).repartition(parts, "part").mapInPandas(merge, PHRASES)


@contextmanager
def _batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """Jobs run inside hand tasks about ``size`` bytes at a time; the session's own setting returns afterwards."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def mine(docs: DataFrame, least: int = 100, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(totals, words, phrases): (lang, n) of all words, (lang, word, id) of the words with at least ``least``
    occurrences, and (lang, words, n) of all such phrases of one to ``longest`` words, ``words`` being ids."""
    with _batches_of(docs.sparkSession, BYTES):
        return _mined(docs, least, longest, text_col, lang_col)


def _mined(docs: DataFrame, least: int, longest: int, text_col: str, lang_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs, spark, seed = _languages(docs, text_col, lang_col), docs.sparkSession, 0
    while True:
        words = cut_lineage(word_counts(docs, seed))
        twice = words.groupBy("lang", "id").agg(F.count(F.lit(1)).alias("k")).where("k > 1 or id = 0")
        if twice.isEmpty():
            break
        seed += 1                                       # ids must be one to one
    often = words.where(F.col("n") >= least)
    if often.count() <= RANKED:                         # 32 MB of hashes at most
        coded = Ranks(often.select("id").toPandas()["id"].to_numpy(np.int64))

        def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch.assign(id=coded.ids(batch["id"].to_numpy(np.int64)))
        often = cut_lineage(often.mapInPandas(rank, COUNTS))
    else:
        coded = Hashes(frequent(often.select(F.array("id").alias("words"))))
    found = [often.select("lang", F.array("id").alias("words"), "n")]
    folder = shared_folder(spark, "phrases")
    id_stream(docs, coded, seed).write.parquet(folder)
    stream = spark.read.schema(STREAM).parquet(folder)
    for length in range(2, longest + 1):
        # two frequent words in a row are in the stream as they are; longer parts are looked up
        shorter = frequent(found[-1]) if length > 2 else None
        found.append(cut_lineage(count_phrases(stream, length, shorter, least, coded.kind)))
        if found[-1].isEmpty():
            break
    remove_folder(spark, folder)
    out = found[0]
    for level in found[1:]:
        out = out.unionByName(level)
    return words.groupBy("lang").agg(F.sum("n").alias("n")), often.select("lang", "word", "id"), out


def score_cuts(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, words, a, k, l, r, n, score): the lowest-scoring cut of every phrase of two words or more."""
    long = phrases.where(F.size("words") > 1).withColumnRenamed("n", "a")
    cuts = long.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1))).withColumns(
        {"left": F.slice("words", F.lit(1), F.col("k")), "right": F.slice("words", F.col("k") + 1, F.size("words") - F.col("k"))})
    cuts = cuts.join(phrases.select("lang", F.col("words").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(phrases.select("lang", F.col("words").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    # 1000 a n has at most 4 + 14 + 18 digits, l r at most 18 + 18
    score = F.expr("cast((cast(1000 as decimal(4,0)) * cast(a as decimal(14,0)) * cast(n as decimal(18,0)))"
                   " div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) as bigint)")
    best = cuts.join(totals, "lang").withColumn("score", score).groupBy("lang", "words", "a", "n").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "words", "a", "n", "cut.*")


def without_parts(scored: DataFrame, percent: int = 100) -> DataFrame:
    """Phrases that no longer phrase holds which occurs at least ``percent`` of their times."""
    size = F.size("words")
    lengths = F.filter(F.sequence(F.lit(2), F.greatest(F.lit(2), size - 1)), lambda m: m < size)
    parts = F.flatten(F.transform(lengths, lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda at: F.slice("words", at, m))))
    inside = (scored.select("lang", F.explode(parts).alias("words"), F.col("a").alias("longer"))
              .groupBy("lang", "words").agg(F.max("longer").alias("longer")))
    kept = scored.join(inside, ["lang", "words"], "left")
    return kept.where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * percent)).drop("longer")


def with_text(scored: DataFrame, words: DataFrame) -> DataFrame:
    """Adds ``phrase``, the words joined by blanks."""
    each = scored.select("*", F.posexplode("words").alias("pos", "id")).join(words.select("lang", "id", "word"), ["lang", "id"])
    columns = [c for c in scored.columns if c != "words"]
    return each.groupBy("words", *columns).agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w")).select(
        *columns, F.array_join(F.col("w.word"), " ").alias("phrase"))


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, text_col: str = "text", lang_col: str = "lang",
                 salts: int = 64) -> DataFrame:
    """The ``top`` phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    The report's ranking takes the best of each of ``salts`` shares of a language first, so at
    most top x salts rows of a language meet in a task.
    """
    totals, words, phrases = mine(docs, least, LONGEST, text_col, lang_col)
    listed = with_text(without_parts(score_cuts(phrases, totals)), words)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = listed.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    some = salted.withColumn("at", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("at") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

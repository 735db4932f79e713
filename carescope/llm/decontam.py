"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, edit check.

A document is contaminated by an item if some stretch of it is within ``max_edit`` times the
item's length in word edits (insertions, deletions, substitutions). Words are runs of word
characters, lower-cased; in scripts written without blanks each character is a word.

Embedding. A CGK walk reads a sequence from its first word: step j gives out the current word and
moves on or stays, by a random bit of (j, word). Two sequences a few edits apart fall into step
again, so that their outputs agree in most places: edit distance becomes Hamming distance.
LSH. Each repetition samples ``SAMPLES`` steps of a walk of its own; windows whose samples agree
with an item's are candidates. Repetitions are added until items with random edits of the full
allowed number reach ``target`` recall; a band that misses it after ``REPEATS`` repetitions has all
stretches checked that hold enough of an item's own word pairs, which loses nothing. Each candidate
is verified by the exact edit distance, with free start and end.

Long items. Two samples of a long walk seldom agree after many edits, so items of more than ``WHOLE``
words are cut into pieces of at most ``PIECE`` words. Of m pieces of a match of k edits one has at most
k / m edits; pieces are searched like items, and the whole item is verified around each that is met.

Windows. Items go in bands of near-equal length; a band's walks are as long as its items. A
window needs no walk where too few of the item's word pairs can lie: k edits break at most 2 k of
an item's pairs of neighbours, so a match of L words holds L - 1 - 2 k pairs of the benchmark.
That bound loses nothing.

The items are the stated query set: they are read in blocks of at most ``BLOCK_ITEMS`` items and
``BLOCK_WORDS`` words, and each block goes to all documents. Items of fewer than ``SHORT`` words that
are allowed no edit are looked up as they are, among the documents' runs of as many words.

Cases: null texts are empty and match nothing; null item texts have no words; repeated documents
and items each give their rows; empty tables give an empty result; long documents are read in
stretches that overlap by more than any match. Only id and text columns are read;
``drop_contaminated`` passes all columns through, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carescope.llm.common import Kept, resident, whole_text

BLOCK_ITEMS, BLOCK_WORDS = 20_000, 2_000_000
SHORT = 5
SAMPLES = 2
REPEATS = 96               # repetitions after which a band goes to the exact pair count
WHOLE, PIECE = 60, 40      # longest item searched as it is, longest piece of the others
PAIRED = 256               # items whose pairs are counted at once
BAND = 1.25                # longest over shortest item of a band
STRETCH = 1 << 18          # words searched at once
UNITS = 500_000            # numbered words of text units kept in a worker, in each of two generations
VERIFY = 2048              # candidates verified at once, fewer of long items
PAIR_BITS = 22
# Thai, Lao, Burmese, Khmer, kana, Chinese characters
BLANKLESS = ("\u0e01-\u0e3a\u0e40-\u0e4e\u0e50-\u0e59\u0e81-\u0edf\u1000-\u1049\u1050-\u109f\u1780-\u17d3\u17d7\u17dc-\u17e9"
             "\u3005-\u3007\u3041-\u3096\u309d-\u309f\u30a1-\u30fa\u30fc-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
             "\uff66-\uff9f\U00020000-\U0003ffff")
WORD = re.compile(f"[{BLANKLESS}]|[^\\W{BLANKLESS}]+")
ROWS = "doc_id bigint, item_id bigint, edits int, similarity double, word_end bigint"

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)   # odd multipliers


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def pair_slots(ids: np.ndarray) -> np.ndarray:
    """A slot of 2^PAIR_BITS for each pair of neighbours."""
    x = ids.astype(np.uint64)
    return ((x[:-1] * _A + x[1:] * _B) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


class Walk:
    """One repetition: a random walk and the steps it samples."""

    def __init__(self, seed: int, steps: int):
        rng = np.random.default_rng(seed)
        self.at = np.sort(rng.choice(steps, size=min(SAMPLES, steps), replace=False))
        self.factor = rng.integers(0, 1 << 63, size=steps, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift = rng.integers(0, 1 << 63, size=steps, dtype=np.uint64)

    def keys(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The sampled words of the windows that begin at ``starts``, hashed."""
        place, key, samples = starts.copy(), np.zeros(len(starts), dtype=np.uint64), set(self.at.tolist())
        for j in range(int(self.at[-1]) + 1):
            word = ids[place]
            if j in samples:
                key = key * _A + word + np.uint64(1)
            place += ((word * self.factor[j] + self.shift[j]) >> np.uint64(63)).astype(np.int64)
        return key


class Items:
    """Items of near-equal length, or pieces of items: (number of the item, place in it, words, allowed edits)."""

    def __init__(self, items: list[tuple[int, int, np.ndarray, int]]):
        self.items = items
        self.sizes, self.edits = np.array([len(i[2]) for i in items]), np.array([i[3] for i in items])
        self.longest, self.slack = int(self.sizes.max()), int(self.edits.max())
        self.grain = max(1, self.slack)
        self.rows = np.zeros((len(items), self.longest), dtype=np.int64)
        for k, item in enumerate(items):
            self.rows[k, :len(item[2])] = item[2]

    def verify(self, ids: np.ndarray, item: np.ndarray, begin: np.ndarray, width: int) -> Iterator[tuple[int, int, int]]:
        """(candidate, least edits, place after the match) of those within the allowed edits, in ``width``
        words from ``begin``."""
        step = max(1, VERIFY * 128 // max(width, 128))
        for k in range(0, len(item), step):
            which, first = item[k:k + step], begin[k:k + step]
            at = first[:, None] + np.arange(width)
            text = np.where((at >= 0) & (at < len(ids)), ids[np.clip(at, 0, len(ids) - 1)], 0).astype(np.int64)
            across = np.arange(width + 1, dtype=np.int32)
            row, best, end = np.zeros((len(which), width + 1), dtype=np.int32), np.zeros(len(which), int), np.zeros(len(which), int)
            for i in range(self.longest):
                word = self.rows[which, i]
                new = np.empty_like(row)
                new[:, 0] = i + 1
                new[:, 1:] = np.minimum(row[:, :-1] + (text != word[:, None]), row[:, 1:] + 1)
                row = np.minimum.accumulate(new - across, axis=1) + across
                done = self.sizes[which] == i + 1
                if done.any():
                    best[done], end[done] = row[done].min(axis=1), row[done].argmin(axis=1)
            for c in np.flatnonzero(best <= self.edits[which]):
                yield k + int(c), int(best[c]), int(first[c] + end[c])


class Band(Items):
    """Items searched with repetitions of the embedding."""

    def __init__(self, items: list[tuple[int, int, np.ndarray, int]], target: float, seed: int):
        super().__init__(items)
        self.needs = self.sizes - 1 - 2 * self.edits
        self.need = int(self.needs.min())
        self.steps = max(SAMPLES, int(0.6 * self.sizes.min()))
        pad = 2 * self.steps + 2
        self.flat = np.concatenate([np.concatenate((i[2], np.zeros(pad, np.uint64))) for i in items])
        self.starts = np.concatenate(([0], np.cumsum(self.sizes + pad)[:-1])).astype(np.int64)
        self._repeat(target, seed)
        self.paired: list[tuple[np.ndarray, np.ndarray]] | None = None
        if self.recall < target:
            self.paired, self.repeats, self.recall = [], [], 1.0
            for k in range(0, len(items), PAIRED):
                slots = [pair_slots(i[2]) for i in items[k:k + PAIRED]]
                own, slot = np.repeat(np.arange(k, k + len(slots)), [len(x) for x in slots]), np.concatenate(slots)
                order = np.argsort(slot, kind="stable")
                self.paired.append((slot[order], own[order]))

    def _repeat(self, target: float, seed: int) -> None:
        """Add repetitions until items with as many random edits as allowed are met often enough, by
        windows that begin up to that many words within them (all windows are searched)."""
        rng = np.random.default_rng(seed)
        edited, own = [], []
        pad = np.zeros(2 * self.steps + self.slack + 2, np.uint64)
        for k in range(0, len(self.items), max(1, len(self.items) // 64)):   # trials, not the search
            for _ in range(8):
                w = list(self.items[k][2])
                for _ in range(int(self.edits[k])):
                    at = int(rng.integers(0, len(w)))
                    w[at:at + 1] = [[0], [], [w[at], 0]][int(rng.integers(0, 3))]
                edited.append(np.concatenate((np.array(w, np.uint64), pad)))
                own.append(k)
        flat = np.concatenate(edited)
        starts = np.concatenate(([0], np.cumsum([len(e) for e in edited])[:-1])).astype(np.int64)
        own, met, self.repeats = np.array(own), np.zeros(len(own), dtype=bool), []
        while len(self.repeats) < REPEATS and met.mean() < target:
            walk = Walk(seed * 1000 + len(self.repeats), self.steps)
            keys = walk.keys(self.flat, self.starts)
            met |= np.any([walk.keys(flat, starts + shift) == keys[own] for shift in range(self.slack + 1)], axis=0)
            order = np.argsort(keys, kind="stable")
            self.repeats.append((walk, keys[order], order))
        self.recall = float(met.mean())

    def windows(self, pairs: np.ndarray, n: int) -> np.ndarray:
        """Places of 0..n-1 where a match may begin; ``pairs`` are running sums of benchmark pairs."""
        places = np.arange(n)
        low = np.maximum(places - self.slack, 0)
        high = np.minimum(places + self.longest + self.slack, n)
        return places[pairs[np.maximum(high - 1, low)] - pairs[low] >= self.need]

    def candidates(self, ids: np.ndarray, places: np.ndarray, slots: np.ndarray, held: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(item, place) that may match; places in steps of the allowed edits."""
        if self.paired is None:
            found = []
            for walk, keys, order in self.repeats:
                mine = walk.keys(ids, places)
                which, item = _meet(keys, order, mine)
                found.append(np.unique(item.astype(np.int64) << 40 | places[which] // self.grain))
            both = np.unique(np.concatenate(found))
            yield both >> 40, (both & ((1 << 40) - 1)) * self.grain
            return
        at = np.flatnonzero(held)
        for keys, order in self.paired:
            which, item = _meet(keys, order, slots[at])
            both = np.unique(item.astype(np.int64) << 40 | at[which])
            item, first = both >> 40, both & ((1 << 40) - 1)
            last = np.arange(len(both)) + np.maximum(self.needs[item], 1) - 1
            ok = last < len(both)
            last[~ok] = 0
            ok &= (self.needs[item] > 0) & (item[last] == item) & (first[last] - first <= self.sizes[item] + self.edits[item])
            item, first = item[ok], first[ok]
            # at most 2 k pairs and k insertions lie between a match's begin and its first whole pair
            near = [np.maximum(first - n * self.edits[item], 0) // self.grain for n in (1, 2)]
            both = np.unique(np.concatenate([item << 40 | x for x in near]))
            yield both >> 40, (both & ((1 << 40) - 1)) * self.grain
        every = np.unique(places // self.grain) * self.grain
        for item in np.flatnonzero(self.needs <= 0):      # so many edits that no pair need be left
            yield np.full(len(every), item), every


def _meet(keys: np.ndarray, order: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``mine``, entry of ``order``) of all equal keys; ``keys`` are sorted."""
    low, high = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
    hit = np.flatnonzero(high > low)
    counts = (high - low)[hit]
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(hit, counts), order[np.repeat(low[hit], counts) + offset]


def _run_keys(ids: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The runs of so many words that begin at ``starts``, hashed."""
    key = np.zeros(len(starts), dtype=np.uint64)
    for j in range(length):
        key = key * _A + ids[starts + j] + np.uint64(1)
    return key


def _bands(items: list[tuple[int, int, np.ndarray, int]]) -> Iterator[list]:
    """Items of near-equal length."""
    group: list = []
    for c in [*sorted(items, key=lambda c: (len(c[2]), c[0], c[1])), None]:
        if group and (c is None or len(c[2]) > BAND * len(group[0][2])):
            yield group
            group = []
        group.append(c)


class Searcher:
    """All matches of a block of items in documents."""

    def __init__(self, items: list[tuple[int, str]], max_edit: float, target: float, seed: int):
        self.vocabulary: dict[str, int] = {}
        number = self.vocabulary.setdefault
        coded = [(i, np.array([number(w, len(self.vocabulary) + 1) for w in ws], dtype=np.uint64))
                 for i, ws in ((i, words(t)) for i, t in items) if ws]
        self.pairs = np.zeros(1 << PAIR_BITS, dtype=bool)
        for _, w in coded:
            self.pairs[pair_slots(w)] = True
        coded.sort(key=lambda c: (len(c[1]), c[0]))
        self.items = [(i, len(w)) for i, w in coded]
        searched, whole, short = [], [], {}
        for k, (_, w) in enumerate(coded):
            if len(w) < SHORT and int(len(w) * max_edit + 1e-9) == 0:
                short.setdefault(len(w), []).append((k, w))
                continue
            edits, m = int(len(w) * max_edit + 1e-9), -(-len(w) // PIECE) if len(w) > WHOLE else 1
            cuts = [len(w) * j // m for j in range(m + 1)]
            searched += [(k, a, w[a:b], edits // m) for a, b in zip(cuts, cuts[1:])]
            if m > 1:
                whole.append((k, 0, w, edits))
        self.bands = [Band(group, target, seed + k) for k, group in enumerate(_bands(searched))]
        self.wholes = [Items(group) for group in _bands(whole)]
        self.place = {item[0]: (g, k) for g, group in enumerate(self.wholes) for k, item in enumerate(group.items)}
        self.reach = max([b.longest + 4 * b.grain + 2 * b.steps for b in self.bands] + [g.longest + g.slack + 1 for g in self.wholes] + [SHORT])
        self.short = [self._lookup(group) for group in short.values()]
        self.units = Kept(self._unit, UNITS)

    def _lookup(self, group: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, ...]:
        """Numbers, words, sorted keys and their order of short items of one length; words that begin one."""
        number, rows = np.array([k for k, _ in group]), np.array([w for _, w in group])
        begins = np.zeros(len(self.vocabulary) + 1, dtype=bool)
        begins[rows[:, 0]] = True
        keys = _run_keys(rows.ravel(), np.arange(len(rows)) * rows.shape[1], rows.shape[1])
        order = np.argsort(keys, kind="stable")
        return number, rows, keys[order], order, begins

    def _unit(self, unit: str) -> bytes:
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in words(unit)], dtype="<u4").tobytes()

    def ids(self, text: str) -> np.ndarray:
        """Numbers of the text's words, 0 for those in no item. Blanks part words, so units between them are kept."""
        return np.frombuffer(b"".join(self.units.many(text.split(" "))), dtype="<u4")

    def matches(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item id, edits, item words, word after the match), one for each text and item that match."""
        if not self.items:
            return
        gap, parts, bounds, size, best = np.zeros(self.reach, dtype="<u4"), [], [], 0, {}
        for k, text in enumerate(texts):
            ids = self.ids(text)
            for start in range(0, max(len(ids), 1), STRETCH):
                part = ids[start:start + STRETCH + self.reach]
                bounds.append((size, k, start))
                parts += [part, gap]
                size += len(part) + len(gap)
                if size >= STRETCH:
                    self._search(np.concatenate([*parts, gap, gap]), bounds, best)
                    parts, bounds, size = [], [], 0
        if parts:
            self._search(np.concatenate([*parts, gap, gap]), bounds, best)
        for (k, item_id, _), (edits, end, length) in sorted(best.items(), key=lambda x: (x[0][0], x[0][1] is None, x[0][1] or 0)):
            yield k, item_id, edits, length, end

    def _search(self, flat: np.ndarray, bounds: list, best: dict) -> None:
        """Put into ``best`` the least edits and first end by (text, item)."""
        ids = flat.astype(np.uint64)
        slots = pair_slots(ids)
        held = self.pairs[slots] & (ids[:-1] > 0) & (ids[1:] > 0)
        sums = np.concatenate(([0], np.cumsum(held)))
        begin = np.array([b[0] for b in bounds])
        n = len(ids) - 2 * self.reach

        def put(number: int, edits: int, end: int) -> None:
            at, k, start = bounds[int(np.searchsorted(begin, max(end - 1, 0), "right")) - 1]
            item_id, length = self.items[number]
            found, key = (edits, start + end - at, length), (k, item_id, number)
            if key not in best or found < best[key]:
                best[key] = found

        for number, rows, keys, order, begins in self.short:
            at = np.flatnonzero(begins[ids[:n]])
            which, item = _meet(keys, order, _run_keys(ids, at, rows.shape[1]))
            at = at[which]
            same = (ids[at[:, None] + np.arange(rows.shape[1])] == rows[item]).all(axis=1)
            at, item = at[same], item[same]
            part = np.searchsorted(begin, at, "right") - 1
            first = np.unique(part << 32 | item, return_index=True)[1]
            for k in first:                                # the first place in a stretch, for each item
                put(int(number[item[k]]), 0, int(at[k]) + rows.shape[1])

        around: list[set] = [set() for _ in self.wholes]
        for band in self.bands:
            places = band.windows(sums[:n + 1], n)
            if not len(places):
                continue
            for item, place in band.candidates(ids, places, slots, held):
                for c, edits, end in band.verify(ids, item, place - band.grain, band.longest + 4 * band.grain):
                    number, offset = band.items[item[c]][:2]
                    if number in self.place:
                        g, k = self.place[number]
                        around[g].add((k, (int(place[c]) - offset) // self.wholes[g].grain))
                    else:
                        put(number, edits, end)
        for group, found in zip(self.wholes, around):
            if found:
                # a piece lies within its own edits of its place, the item's begin within all its edits of that
                both = np.array(sorted(found), dtype=np.int64)
                for c, edits, end in group.verify(ids, both[:, 0], (both[:, 1] - 2) * group.grain, group.longest + 7 * group.grain):
                    put(group.items[both[c, 0]][0], edits, end)


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple]]:
    """The items, block by block; only one block at a time is on the driver."""
    block, size = [], 0
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), whole_text(text_col).alias("t")).orderBy("i", "t")
    for row in rows.toLocalIterator():
        block.append((row["i"], row["t"]))
        size += row["t"].count(" ") + 1
        if len(block) >= BLOCK_ITEMS or size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _searcher(held: Broadcast) -> Searcher:
    """One searcher a worker and block."""
    return resident(("searcher", held.value["key"]), lambda: Searcher(**held.value["arguments"]))


def _broadcasts(benchmark: DataFrame, max_edit: float, target: float, seed: int, **columns: str) -> Iterator[Broadcast]:
    for k, block in enumerate(item_blocks(benchmark, **columns)):   # a block's size is bounded above
        arguments = {"items": block, "max_edit": max_edit, "target": target, "seed": seed}
        key = (k, hash(tuple(block)), max_edit, target, seed)
        yield benchmark.sparkSession.sparkContext.broadcast({"key": key, "arguments": arguments})


def contaminated(docs: DataFrame, benchmark: DataFrame, max_edit: float = 0.2, target: float = 0.95, seed: int = 11,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document and item that match: doc_id, item_id, the least edits, similarity
    (1 - edits / item words) and the number of the document's words up to the match's end."""
    def search(held: Broadcast):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            searcher = _searcher(held)
            for batch in batches:
                ids = batch["id"].tolist()
                rows = {}
                for k, item, edits, length, end in searcher.matches(batch["text"].tolist()):
                    found = (edits, end, length)
                    rows[k, item] = min(rows.get((k, item), found), found)
                yield pd.DataFrame([(None if pd.isna(ids[k]) else int(ids[k]), item, e, 1 - e / n, end)
                                    for (k, item), (e, end, n) in rows.items()],
                                   columns=["doc_id", "item_id", "edits", "similarity", "word_end"]).astype(
                    {"doc_id": "Int64", "item_id": "Int64", "edits": "int32", "similarity": "float64", "word_end": "int64"})
        return run

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    out = None
    for held in _broadcasts(benchmark, max_edit, target, seed):
        found = narrow.mapInPandas(search(held), ROWS)
        out = found if out is None else out.union(found)
    return narrow.sparkSession.createDataFrame([], ROWS) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, max_edit: float = 0.2, target: float = 0.95, seed: int = 11,
                      text_col: str = "text") -> DataFrame:
    """The documents that no item matches, with all their columns."""
    def flag(held: Broadcast) -> Column:
        def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            searcher = _searcher(held)
            for batch in texts:
                hit = np.zeros(len(batch), dtype=bool)
                for k, *_ in searcher.matches(batch.tolist()):
                    hit[k] = True
                yield pd.Series(hit)
        # pandas_udf reads the kind of function from its annotations
        run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(run, "boolean")(whole_text(text_col))

    for held in _broadcasts(benchmark, max_edit, target, seed):
        docs = docs.where(~flag(held))
    return docs

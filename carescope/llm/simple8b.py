"""Simple-8b: word-aligned packing of non-negative integers, vectorised both ways.

A 64-bit word has a selector in its top four bits and, below, as many values of one width as the
selector says. A value of more than 60 bits is an escape: selector 0, then the value as a word of
its own. Values go in blocks of ``BLOCK``; each block begins a word, so with the blocks' word
offsets any block decodes alone. The last word of a block is filled up with zeros, which the
reader drops as it knows the block's number of values.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
#: Fixed values of the coding: selector k + 1 packs COUNTS[k] values of BITS[k] bits.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
WIDTH = BLOCK + max(COUNTS)      # a block's row, with room for a last word that isn't full
_TAKES = np.array([1, *COUNTS], dtype=np.int64)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, offsets): block b is words[offsets[b]:offsets[b + 1]]."""
    n = len(values)
    blocks = -(-n // BLOCK)
    if not blocks:
        return np.zeros(0, "<u8"), np.zeros(1, "<i8")
    rows = np.zeros((blocks, WIDTH), dtype=np.uint64)
    padded = np.zeros(blocks * BLOCK, dtype=np.uint64)
    padded[:n] = values
    rows[:, :BLOCK] = padded.reshape(blocks, BLOCK)
    length = np.full(blocks, BLOCK)
    length[-1] = n - (blocks - 1) * BLOCK
    flat = rows.ravel()

    # the densest selector whose values all fit, at every place: the greatest bit length in each
    # window comes from windows of a power of two
    widths = np.frexp(flat.astype(np.float64))[1].astype(np.uint8)
    greatest = {1: widths}
    for size in (2, 4, 8, 16, 32):
        half = greatest[size // 2]
        greatest[size] = half.copy()
        np.maximum(half[:-(size // 2)], half[size // 2:], out=greatest[size][:-(size // 2)])
    density = np.zeros(len(flat), dtype=np.uint8)        # 15 - selector, 0: escape
    for k, (take, bits) in enumerate(zip(COUNTS, BITS)):
        size = 1 << (take.bit_length() - 1)
        window = greatest[size].copy()
        if take > size:
            np.maximum(window[:size - take], greatest[size][take - size:], out=window[:size - take])
        np.maximum(density, (window <= bits).view(np.uint8) * np.uint8(14 - k), out=density)
    chosen = np.where(density == 0, 0, 15 - density).astype(np.uint8)

    # all blocks walk from word to word together
    at, live, starts = np.zeros(blocks, dtype=np.int64), np.arange(blocks), []
    while len(live):
        here = live * WIDTH + at[live]
        starts.append(here)
        at[live] += _TAKES[chosen[here]]
        live = live[at[live] < length[live]]
    start = np.sort(np.concatenate(starts))
    selector = chosen[start]
    size = np.where(selector == 0, 2, 1)
    position = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), dtype="<u8")
    for k in np.unique(selector):
        mine = selector == k
        if k == 0:
            words[position[mine] + 1] = flat[start[mine]]
            continue
        take, bits = COUNTS[k - 1], BITS[k - 1]
        shifts = (np.arange(take, dtype=np.uint64) * np.uint64(bits))
        group = flat[start[mine][:, None] + np.arange(take)]
        words[position[mine]] = np.bitwise_or.reduce(group << shifts, axis=1) | np.uint64(int(k) << 60)
    first = np.searchsorted(start, np.arange(blocks) * WIDTH)
    return words, np.append(position[first], len(words)).astype("<i8")


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n values of consecutive blocks; ``offsets`` are relative to ``words``."""
    blocks = len(offsets) - 1
    if not n:
        return np.zeros(0, dtype=np.uint64)
    words = np.asarray(words, dtype=np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    takes = _TAKES[np.minimum(selector, len(COUNTS))]
    raw = np.zeros(len(words), dtype=bool)
    for i in np.flatnonzero(selector == 0):     # escapes are rare; the word after one is a value
        if not raw[i]:
            raw[i + 1] = True
    takes[raw] = 0
    block = np.repeat(np.arange(blocks), np.diff(offsets))
    before = np.cumsum(takes) - takes
    at = before - before[offsets[:-1]][block] + block * WIDTH
    out = np.zeros(blocks * WIDTH, dtype=np.uint64)
    for k in np.unique(selector[~raw]):
        mine = np.flatnonzero((selector == k) & ~raw)
        if k == 0:
            out[at[mine]] = words[mine + 1]
            continue
        take, bits = COUNTS[k - 1], BITS[k - 1]
        shifts = np.arange(take, dtype=np.uint64) * np.uint64(bits)
        out[at[mine][:, None] + np.arange(take)] = (words[mine][:, None] >> shifts) & np.uint64((1 << bits) - 1)
    return out.reshape(blocks, WIDTH)[:, :BLOCK].ravel()[:n]

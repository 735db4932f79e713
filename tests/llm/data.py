"""Small tables with awkward rows, and brute-force versions of what the operators compute."""

import numpy as np
import xxhash

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_tokens string, row int, fp string, id double"
LONG = "very long words " * 20_000


def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns with clashing names."""
    rows = [(1, "The quick brown fox jumps over it.", "en", "s", 34, "x", 1, "y", 0.5),
            (2, "The quick brown fox jumps over it.", None, None, None, None, None, None, None),
            (3, "", "en", "s", 0, "x", 1, "y", 0.5), (4, None, None, None, None, None, None, None, None),
            (5, LONG, "en", "s", len(LONG), "x", 1, "y", 0.5), (6, "  \t\n ", "en", "s", 5, "x", 1, "y", 0.5),
            (7, "Élan vital, naïve café — 漢字 😀 <|endoftext|> it's", "fr", "s", 1, "x", 1, "y", 0.5),
            (None, "no id here", "en", "s", 1, "x", 1, "y", 0.5),
            (8, "repeated row", "en", "s", 1, "x", 1, "y", 0.5), (8, "repeated row", "en", "s", 1, "x", 1, "y", 0.5),
            (8, "same id, other text", "en", "s", 1, "x", 1, "y", 0.5)]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df, *order):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(type(x)), x) for x in r))


def simhash(text, length=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[k:k + length]) for k in range(max(1, len(w) - length + 1))]
    out = 0
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    for bit in range(64):
        if 2 * sum(x >> bit & 1 for x in h) > len(h):
            out |= 1 << bit
    return out


def components(fps, distance=3):
    """Component number of each fingerprint by comparing all pairs."""
    u, inverse = np.unique(np.array(fps, dtype=np.uint64), return_inverse=True)
    parent = list(range(len(u)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u ^ u[i]) <= distance):
            parent[find(int(j))] = find(i)
    return [find(int(k)) for k in inverse]

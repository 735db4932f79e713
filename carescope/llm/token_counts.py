"""Token counts by prefix dynamic programming.

For a piece (a pre-tokenised word) of symbols s1..sn the table keeps, for every prefix, the last
token of its encoding and the number of tokens. The last token of a prefix is the one vocabulary
token that ends there and may follow the last token of the prefix before it, so each entry needs
only earlier entries. Vocabularies with a word-end mark have two rows: ``last``/``open`` for a
prefix that goes on, and ``closed`` for the prefix as a whole word. A piece's table answers the
count of any truncation and the longest prefix within a budget without encoding again.

Pieces and special strings come from the tokenizer file's own normalizer and pre-tokenizer.

Cases: a null text counts as empty and has no tokens; rows are handled one by one (repeated rows
repeat, an empty table gives an empty one); only the id and text columns are read, so other
columns, whatever their names, do not matter.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carescope.llm.common import Kept, resident, whole_text
from carescope.llm.merges import Merges

UNITS = 500_000    # counts of text units kept in a worker, in each of two generations
TABLES = 100_000   # prefix tables kept likewise
#: Letters with one lower-case form each that no normal form changes, then ASCII marks that begin no special string
#: and no contraction: such a unit is one piece of letters and one of marks.
PLAIN = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]*)([!-&(-/:;=-@\[-`{-~]*)")
RESULT = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
#: The pre-tokenizer pattern under which PLAIN holds: runs of letters, single digits, runs of marks.
LOWER_WORDS = json.dumps(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_letters() -> dict[int, int]:
    """Byte -> the character that stands for it in byte-level vocabularies: printable Latin-1
    characters stand for themselves, the others take the code points from 256 on in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + k for k, b in enumerate(other)}


class PrefixCounter:
    """Exact token counts of every prefix, by a tokenizer file with BPE merges and a word-end mark."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        order = {pair: i for i, pair in enumerate(pairs)}
        self.merges = Merges(lambda a, b: order.get((a, b)), self._base)
        #: 1: a token within a piece, 2: a token that ends a piece, 0: only the beginning of tokens
        self.kinds: dict[str, int] = {}
        for token in model["vocab"]:
            if self.merges.history(token) is None:
                continue
            ends = bool(self.end) and token.endswith(self.end)
            body = token[:len(token) - len(self.end)] if ends else token
            self.kinds[body] = self.kinds.get(body, 0) | (2 if ends else 1 if self.end else 3)
            for k in range(1, len(body)):
                self.kinds.setdefault(body[:k], 0)
        self.tokenizer = Tokenizer.from_file(path)
        special = [t["content"] for t in spec.get("added_tokens") or []]
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.plain = (spec.get("normalizer") or {}).get("type") == "Sequence" and LOWER_WORDS in json.dumps(spec["pre_tokenizer"])
        self.visible = byte_letters()
        self.tables = Kept(self._table, TABLES)
        self.units = Kept(self._unit, UNITS)

    def _base(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[:len(token) - len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def prefix_table(self, piece: str) -> list[int]:
        """closed[k]: tokens of the piece's first k symbols taken as a whole word, k = 0..n."""
        return self.tables.one(piece)

    def _table(self, piece: str) -> list[int]:
        kinds, follows, end, n = self.kinds, self.merges.follows, self.end, len(piece)
        last: list = [None] * (n + 1)      # the last token of each prefix that goes on
        opened, closed = [0] * (n + 1), [0] * (n + 1)
        for start in range(n):
            before, count = last[start], opened[start] + 1
            if start and before is None:
                continue                   # no text goes on from here
            for stop in range(start + 1, n + 1):
                part = piece[start:stop]
                kind = kinds.get(part)
                if kind is None:           # no token begins so
                    break
                if kind & 1 and last[stop] is None and (start == 0 or follows(before, part)):
                    last[stop], opened[stop] = part, count
                if kind & 2 and not closed[stop] and (start == 0 or follows(before, part + end)):
                    closed[stop] = count
        if not all(closed[1:]):
            raise ValueError(f"some prefix of {piece!r} has no encoding")
        return closed

    def pieces(self, text: str) -> list[str | None]:
        """The pre-tokenised pieces in order; None stands for a special string (one token)."""
        out: list[str | None] = []
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                out.append(None)
            elif part:
                normal = self.tokenizer.normalizer.normalize_str(part) if self.tokenizer.normalizer else part
                out += [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]
        return out

    def count(self, text: str) -> int:
        """Tokens of the text. Blanks part pieces and no special string holds one, so the text is
        counted by the units between them."""
        return sum(self.units.many(text.split(" ")))

    def _unit(self, unit: str) -> int:
        match = PLAIN.fullmatch(unit) if self.plain else None
        if match is None:
            return sum(1 if p is None else self.prefix_table(p)[-1] for p in self.pieces(unit))
        letters, marks = match.groups()
        n = 0
        if letters:
            letters = letters.lower()
            if not letters.isascii():
                letters = letters.encode("utf-8").decode("latin-1").translate(self.visible)
            n = self.prefix_table(letters)[-1]
        return n + self.prefix_table(marks)[-1] if marks else n

    def truncation(self, text: str, budget: int) -> tuple[int, int]:
        """How many pieces fit whole within ``budget`` tokens, and how many symbols of the next one
        still fit, with its count as a word of its own."""
        pieces = self.pieces(text)
        sums = [0, *accumulate(1 if p is None else self.prefix_table(p)[-1] for p in pieces)]
        whole = max(k for k, s in enumerate(sums) if s <= budget)
        if whole == len(pieces) or pieces[whole] is None:
            return whole, 0
        left, closed = budget - sums[whole], self.prefix_table(pieces[whole])
        return whole, max(k for k, n in enumerate(closed) if n <= left)


def prefix_counter(path: str) -> PrefixCounter:
    """One counter a worker."""
    return resident(("prefix_counter", path), lambda: PrefixCounter(path))


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Per document: its id, UTF-8 bytes, tokens of the whole text, and whether they exceed ``limit``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = prefix_counter(tokenizer_path)
        for batch in batches:
            n = [counter.count(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["id"], "n_bytes": batch["n_bytes"], "n_tokens": n,
                                "over_limit": [x > limit for x in n]})
    text = whole_text(text_col)
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"),
                         F.octet_length(text).cast("long").alias("n_bytes"))
    return narrow.mapInPandas(run, RESULT)

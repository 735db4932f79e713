"""Byte-level BPE encoding and decoding with a lazily determinised finite-state transducer.

Encoding. A transducer state holds every token that may be in progress: pairs of (bytes of a
token begun, last token before it), each with the tokens that are chosen on its path but not yet
common to all paths. Reading a byte advances all of them; a path on which a token ends here and
may follow its predecessor starts a new token. Tokens that all paths share are emitted at once, so
output lags by a bounded lookahead. States and transitions are made when first met and kept up to
a bound, after which the table is begun anew (the result is the same).

Decoding. Ids become bytes; ``Utf8Stream`` turns byte chunks into text with a state machine that
holds back an incomplete sequence until the rest arrives.

Rank files hold one ``base64 rank`` pair a line. A piece that is itself a token is that token;
other pieces go through the transducer, one by one as the pattern gives them.

Cases: a null text counts as empty; an empty text has no ids; rows are handled one by one, so
repeated rows give repeated results, and an empty table gives an empty one. Only the id and text
columns are read, so other columns, whatever their names, do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carescope.llm.common import Kept, resident, whole_text
from carescope.llm.merges import Merges

STATES = 300_000       # transducer states kept in a worker
PAIRS = 1_000_000      # verdicts on neighbouring tokens kept likewise
UNITS = 400_000        # encoded text units kept in a worker, in each of two generations
PIECES = 300_000       # encoded pieces kept likewise
KEPT_CHARS = 40        # characters of a piece that is kept, at most
FED = 256                   # tokens whose bytes go to the streaming decoder at once
RESULT = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Transducer:
    """Piece of bytes -> token ids."""

    def __init__(self, ranks: dict[bytes, int], states: int = STATES, pairs: int = PAIRS):
        self.ranks, self.bound = ranks, states
        self.merges = Merges(lambda a, b: ranks.get(a + b), lambda t: [t[i:i + 1] for i in range(len(t))], keep=pairs)
        self.begun = {t[:i] for t in ranks for i in range(1, len(t))}
        self._reset()

    def _reset(self) -> None:
        self.moves: dict = {}          # state * 256 + byte -> (state, tokens emitted)
        self.ids: dict = {}
        self.items: list = []
        self.rest: list = []           # tokens still to emit if the piece ends in the state
        self.start = self._state(((b"", None, ()),))

    def _state(self, items: tuple) -> int:
        if items not in self.ids:
            self.ids[items] = len(self.items)
            self.items.append(items)
            self.rest.append(next((pending for begun, _, pending in items if not begun), None))
        return self.ids[items]

    def _move(self, state: int, byte: int) -> tuple[int, tuple]:
        items, ended = [], None
        for begun, last, pending in self.items[state]:
            token = begun + bytes((byte,))
            if token in self.begun:
                items.append((token, last, pending))
            if (ended is None and token in self.ranks and self.merges.history(token) is not None
                    and (last is None or self.merges.follows(last, token))):
                ended = (b"", token, (*pending, self.ranks[token]))
        if ended is None:
            raise ValueError(f"byte {byte} has no token in the rank file")
        items.append(ended)
        same = 0
        for column in zip(*(pending for _, _, pending in items)):
            if len(set(column)) > 1:
                break
            same += 1
        out = ended[2][:same]
        return self._state(tuple((b, last, pending[same:]) for b, last, pending in items)), out

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.items) > self.bound:
            self._reset()
        state, moves, out = self.start, self.moves, []
        for byte in piece:
            key = state << 8 | byte
            move = moves.get(key)
            if move is None:
                move = moves[key] = self._move(state, byte)
            state = move[0]
            if move[1]:
                out.extend(move[1])
        out.extend(self.rest[state])
        return out


class ByteBpe:
    """Text -> ids by a rank file, and ids -> bytes; ``share`` scales the tables that are kept."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, share: float = 1.0):
        self.transducer = Transducer(ranks, int(share * STATES), int(share * PAIRS))
        self.pieces = Kept(lambda piece: self.transducer.encode(piece.encode("utf-8")), int(share * PIECES))
        self.pattern = regex.compile(pattern)
        self.tokens = dict((rank, token) for token, rank in ranks.items())
        self.units = Kept(lambda unit: self._pack(" " + unit), int(share * UNITS))

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.pattern.findall(text)
                for i in (self.pieces.one(piece) if len(piece) <= KEPT_CHARS else self.transducer.encode(piece.encode("utf-8")))]

    def encode_packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers.

        A lone space between two other characters always begins a piece, so a text can be cut
        there; the units between are kept with their ids.
        """
        first, *rest = CUT.split(text) if RUN.search(text) else text.split(" ")
        return self._pack(first) + b"".join(self.units.many(rest))

    def _pack(self, text: str) -> bytes:
        ids = array("I", self.encode(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


RUN = regex.compile(r"\s\s")
CUT = regex.compile(r"(?<=\S) (?=\S)")


class Utf8Stream:
    """Byte chunks in, text out; an incomplete sequence waits for the next chunk.

    The state is the number of bytes that the sequence begun still needs, at most three. Invalid
    bytes become U+FFFD as in Python's own replacing decoder.
    """

    def __init__(self):
        self.held = b""

    def feed(self, chunk: bytes) -> str:
        data = self.held + chunk
        keep = self._begun(data)
        self.held = data[len(data) - keep:]
        return data[:len(data) - keep].decode("utf-8", "replace")

    def close(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out

    @staticmethod
    def _begun(data: bytes) -> int:
        """How many bytes at the end begin a sequence that a later chunk can complete."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 == 0x80:
                continue
            need = 4 if 0xF0 <= lead <= 0xF4 else 3 if 0xE0 <= lead <= 0xEF else 2 if 0xC2 <= lead <= 0xDF else 1
            if need <= back:
                return 0
            if back > 1:  # the second byte may already make the sequence invalid
                low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF),
                             0xF4: (0x80, 0x8F)}.get(lead, (0x80, 0xBF))
                if not low <= data[-back + 1] <= high:
                    return 0
            return back
        return 0


def byte_bpe(path: str, pattern: str, share: float = 1.0) -> ByteBpe:
    """One encoder a worker."""
    return resident(("byte_bpe", path, pattern, share), lambda: ByteBpe(read_ranks(path), pattern, share))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """Id and ``ids`` (array<int>) of every whole text."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = byte_bpe(ranks_path, pattern)
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "ids": [np.frombuffer(bpe.encode_packed(t), "<u4").astype("i4")
                                                           for t in batch["text"]]})
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    return narrow.mapInPandas(run, "id bigint, ids array<int>").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
                     ids_col: str = "ids") -> DataFrame:
    """Id and ``text`` of every id sequence, through the streaming decoder."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = byte_bpe(ranks_path, pattern)
        for batch in batches:
            texts = []
            for ids in batch["ids"]:
                stream, ids = Utf8Stream(), [] if ids is None else ids
                texts.append("".join(stream.feed(bpe.tokens[int(i)]) for i in ids) + stream.close())
            yield pd.DataFrame({"id": batch["id"], "text": texts})
    narrow = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids"))
    return narrow.mapInPandas(run, "id bigint, text string").withColumnRenamed("id", id_col)


def decoded_digest(bpe: ByteBpe, ids: list[int]) -> str:
    """SHA-256 of the UTF-8 of the text that the ids' bytes decode to, through the streaming decoder."""
    stream, digest = Utf8Stream(), hashlib.sha256()
    for k in range(0, len(ids), FED):
        digest.update(stream.feed(bpe.decode(ids[k:k + FED])).encode("utf-8"))
    digest.update(stream.close().encode("utf-8"))
    return digest.hexdigest()


def round_trip_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
                       text_col: str = "text", share: float = 1.0) -> DataFrame:
    """Per document: its id, number of tokens, and digests of the ids and of the text they decode to."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = byte_bpe(ranks_path, pattern, share)
        for batch in batches:
            counts, ids_digests, text_digests = [], [], []
            for text in batch["text"]:
                packed = bpe.encode_packed(text)
                ids = np.frombuffer(packed, "<u4").tolist()
                counts.append(len(ids))
                ids_digests.append(hashlib.sha256(packed).hexdigest())
                text_digests.append(decoded_digest(bpe, ids))
            yield pd.DataFrame({"doc_id": batch["id"], "n_tokens": counts, "ids_sha256": ids_digests,
                                "decoded_sha256": text_digests})
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    return narrow.mapInPandas(run, RESULT)

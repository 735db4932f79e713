"""Token-id files: documents encoded with the tokenizers library, packed with Simple-8b.

The documents are range-partitioned by id and sorted, so that the files, in order of partition and
sequence, hold them in ascending id order (null ids last, equal ids in input order). Each document
ends with ``end_id``.

A file: ``MAGIC``; the packed words; a footer; the footer's place (8 bytes); ``MAGIC``. The footer
holds the numbers of values, blocks and documents, the blocks' word offsets, and the documents'
ids, validity and starts. Readers take the footer and then any range of blocks. A file is written
under a temporary name and moved into place, so a repeated task leaves a whole file, and all files
lie in the shared folder of the checkpoints.

Cases: a null or empty text gives the end id alone; repeated rows are encoded as often as they
occur; an empty table gives no file and no row; only the id and text columns are read, so other
columns do not matter; texts of any length are encoded whole (ids are packed in runs of ``RUN``
values, and a file that has ``FILE_VALUES`` values is followed by another).
"""

from __future__ import annotations

import json
import os
import re
import string
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carescope.llm import simple8b
from carescope.llm.common import Kept, checkpoint_dir, open_fs, resident, shared_folder, whole_text, write_file
from carescope.llm.token_counts import LOWER_WORDS, byte_letters

MAGIC = b"TOKS8B01"
RUN = 1 << 20                 # values packed or unpacked at once
FILE_VALUES = 1 << 25         # values after which a file ends
UNITS = 300_000               # ids of text units kept in a worker, in each of two generations
JOINED = 50                   # units that one library call encodes
JOINED_CHARS = 200            # characters of such a unit at most
SOME_CHARS = 3_000_000        # of texts that are cut and encoded at once, about
WORDS = 500_000               # ids of lower-case pieces kept likewise
FILES = "part int, seq int, path string, n_values bigint, n_docs bigint"
ROWS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
#: ASCII marks that begin no special string and no contraction.
MARKS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
#: Kinds of bytes; the greatest in a unit says whether it is plain.
BLANK, LETTER, MARK, DIGIT, OTHER = range(5)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


class LibraryEncoder:
    """Text -> ids by the tokenizers library, each distinct part of some texts once.

    For pre-tokenizers that drop white space (checked on construction) no piece spans a blank, so a
    text's ids are its units' ids in order. Where pieces are known to be runs of letters, single
    digits and runs of marks, units of plain characters are cut into them, each encoded by the
    library's model; the other units are encoded whole. Texts are cut by whole columns of bytes.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.visible = self.tokenizer.model, byte_letters()
        self.by_unit = self._ids("a b") == self._ids("a") + self._ids("b") and self._ids(" a  b ") == self._ids("a b")
        self.by_word = self.by_unit and _lower_words(path) and self._ids("Àb.") == self._ids("àb") + self._ids(".")
        self.units, self.words = Kept(self._pack, UNITS), Kept(self._piece, WORDS)
        self.kinds = np.full(256, OTHER, dtype=np.uint8)      # of bytes
        self.kinds[ord(" ")] = BLANK
        if self.by_word:
            self.kinds[[ord(c) for c in string.ascii_letters]] = LETTER
            self.kinds[[ord(c) for c in string.digits]] = DIGIT
            self.kinds[[ord(c) for c in MARKS]] = MARK
            self.kinds[[ord(c) for c in "\t\n\v\f\r" if self._ids(f"a{c}b{c}") == self._ids("a b")]] = BLANK

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _pack(self, text: str) -> bytes:
        return np.array(self._ids(text), dtype="<u4").tobytes()

    def _piece(self, piece: bytes) -> bytes:
        """Ids of one lower-case piece, each byte of which is a symbol to the model."""
        symbols = piece.decode("ascii") if piece.isascii() else piece.decode("latin-1").translate(self.visible)
        ids = [t.id for t in self.model.tokenize(symbols)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _joined(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of units joined by blanks, cut by where their characters lie."""
        found = self.tokenizer.encode(" ".join(parts), add_special_tokens=False)
        starts = np.cumsum([0, *(len(p) + 1 for p in parts)])
        at = (4 * np.searchsorted([a for a, _ in found.offsets], starts)).tolist()
        ids = np.array(found.ids, dtype="<u4").tobytes()
        return {p: ids[a:b] for p, a, b in zip(parts, at, at[1:])}

    def _encoded(self, parts: set[str]) -> dict[str, bytes]:
        """Ids of distinct units, many a library call; a long one is encoded by itself."""
        short = [p for p in parts if len(p) <= JOINED_CHARS]
        out = {p: self._pack(p) for p in parts if len(p) > JOINED_CHARS}
        for k in range(0, len(short), JOINED):
            out.update(self._joined(short[k:k + JOINED]))
        return out

    def _units(self, units: set[str]) -> dict[str, bytes]:
        """Ids of all these units: those known, and the others."""
        out, missing = self.units.known(units)
        new = self._encoded(missing)
        self.units.add(new)
        out.update(new)
        return out

    def encode_some(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of each text, some texts at a time."""
        some, size = [], 0
        for text in texts:
            some.append(text)
            size += len(text)
            if size > SOME_CHARS:
                yield from self._encode(some)
                some, size = [], 0
        if some:
            yield from self._encode(some)

    def _encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        if not self.by_unit:
            for text in texts:
                yield np.frombuffer(self._pack(text), "<u4")
            return
        parts, codes, other, at = self._cut(texts)
        ids = [b""] * len(parts)
        plain = np.flatnonzero(~other).tolist()
        for k, v in zip(plain, self.words.many([parts[k] for k in plain])):
            ids[k] = v
        whole = {k: parts[k].decode() for k in np.flatnonzero(other).tolist()}
        units = self._units(set(whole.values()))
        for k, unit in whole.items():
            ids[k] = units[unit]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first = np.cumsum(size) - size
        ids = np.frombuffer(b"".join(ids), "<u4")
        size, first = size[codes], first[codes]                # of every occurrence
        stop = np.concatenate(([0], np.cumsum(size)))
        ids = ids[np.repeat(first - stop[:-1], size) + np.arange(stop[-1])]
        at = stop[at].tolist()
        for a, b in zip(at, at[1:]):
            yield ids[a:b]

    def _cut(self, texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """(distinct parts, the part at each place, which parts are whole units, places where texts begin and the last ends).

        A part is a piece of a plain unit, in lower case, or a unit with other characters as it stands.
        """
        column = pa.array(texts, pa.large_string())
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64, len(texts) + 1)
        n = int(offsets[-1])
        if not n:
            return [], np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(len(texts) + 1, np.int64)
        data = np.frombuffer(data, np.uint8, n)
        kind = self.kinds[data]
        if self.by_word:
            led = np.flatnonzero(data == 0xC3)                 # À to ÿ, which have two bytes, without × and ÷
            led = led[(data[led + 1] != 0x97) & (data[led + 1] != 0xB7)]
            kind[led] = kind[led + 1] = LETTER
        begins = np.zeros(n, dtype=bool)
        begins[offsets[:-1][offsets[:-1] < n]] = True

        # runs between blanks; those with a character of kind OTHER become one part
        blank = kind == BLANK
        edge = begins.copy()
        edge[1:] |= blank[1:] != blank[:-1]
        run = np.flatnonzero(edge)
        size = np.diff(run, append=n)
        whole = np.maximum.reduceat(kind, run) == OTHER
        a, size = run[whole], size[whole]
        kind[np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())] = OTHER

        edge = begins
        edge[1:] |= kind[1:] != kind[:-1]
        edge |= kind == DIGIT
        run = np.flatnonzero(edge)
        size = np.diff(run, append=n)
        shown = kind[run] != BLANK
        run, size = run[shown], size[shown]
        if self.by_word:
            data = np.where(kind == LETTER, LOWER[data], data)
            led = led[(kind[led] == LETTER) & (data[led + 1] < 0x9F)]
            data[led + 1] += 0x20
        stops = np.concatenate(([0], np.cumsum(size)))
        coded = pa.Array.from_buffers(pa.large_binary(), len(run), [
            None, pa.py_buffer(stops), pa.py_buffer(data[~blank])]).dictionary_encode()
        codes = coded.indices.to_numpy()
        other = np.zeros(len(coded.dictionary), dtype=bool)
        other[codes] = kind[run] == OTHER
        return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), codes, other, np.searchsorted(run, offsets)


def _lower_words(path: str) -> bool:
    """Whether the file's pieces are, in lower case, runs of letters, single digits and runs of marks that a BPE model
    takes byte by byte, and no added token is made of letters, digits and ``MARKS`` alone."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    forms = [(k["type"], k.get("pattern"), k.get("content")) for k in (spec.get("normalizer") or {}).get("normalizers") or []]
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    plain = re.compile(rf"[A-Za-z0-9\sÀ-ÖØ-öø-ÿ{re.escape(MARKS)}]*")
    return (forms == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
            and [k["type"] for k in cuts] == ["Split", "ByteLevel"]
            and (cuts[0]["pattern"], cuts[0]["behavior"], cuts[0]["invert"]) == ({"Regex": json.loads(LOWER_WORDS)}, "Removed", True)
            and (cuts[1]["add_prefix_space"], cuts[1]["use_regex"]) == (False, False)
            and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
            and not any(plain.fullmatch(t["content"]) or re.search(r"\s", t["content"]) for t in spec.get("added_tokens") or []))


def library_encoder(path: str) -> LibraryEncoder:
    """One encoder a worker."""
    return resident(("library_encoder", path), lambda: LibraryEncoder(path))


class TokenFile:
    """Collects documents; ``data`` is the file."""

    def __init__(self):
        self.pending, self.held, self.words, self.offsets = [], 0, [], [np.zeros(1, "<i8")]
        self.n_values, self.n_words, self.ids, self.valid, self.starts = 0, 0, [], [], [0]

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.pending.append(ids)
        self.held += len(ids)
        self.ids.append(0 if doc_id is None else doc_id)
        self.valid.append(doc_id is not None)
        self.starts.append(self.starts[-1] + len(ids))
        if self.held >= RUN:
            self._pack(self.held // simple8b.BLOCK * simple8b.BLOCK)

    def _pack(self, n: int) -> None:
        values = np.concatenate(self.pending) if self.pending else np.zeros(0, np.uint32)
        for k in range(0, n, RUN):
            words, offsets = simple8b.encode(values[k:min(n, k + RUN)])
            self.words.append(words.tobytes())
            self.offsets.append(offsets[1:] + self.n_words)
            self.n_words += len(words)
        self.pending, self.held, self.n_values = [values[n:]], len(values) - n, self.n_values + n

    def data(self) -> bytes:
        self._pack(self.held)
        offsets = np.concatenate(self.offsets).astype("<i8")
        footer = b"".join((struct.pack("<qqq", self.n_values, len(offsets) - 1, len(self.ids)), offsets.tobytes(),
                           np.array(self.ids, "<i8").tobytes(), np.array(self.starts, "<i8").tobytes(),
                           np.array(self.valid, "u1").tobytes()))
        return b"".join((MAGIC, *self.words, footer, struct.pack("<q", len(MAGIC) + 8 * self.n_words), MAGIC))


class TokenFileReader:
    """Reads the footer and ranges of blocks of an open random-access file."""

    def __init__(self, f):
        self.f, size = f, f.size()
        f.seek(size - 16)
        place, magic = struct.unpack("<q8s", f.read(16))
        if magic != MAGIC:
            raise ValueError("not a token file, or cut short")
        f.seek(place)
        footer = f.read(size - 16 - place)
        self.n_values, blocks, docs = struct.unpack_from("<qqq", footer)
        at = 24
        self.offsets = np.frombuffer(footer, "<i8", blocks + 1, at)
        at += 8 * (blocks + 1)
        self.ids = np.frombuffer(footer, "<i8", docs, at)
        self.starts = np.frombuffer(footer, "<i8", docs + 1, at + 8 * docs)
        self.valid = np.frombuffer(footer, "u1", docs, at + 8 * (2 * docs + 1))

    def blocks(self, first: int, stop: int) -> np.ndarray:
        """The values of blocks first..stop-1."""
        offsets = self.offsets[first:stop + 1]
        self.f.seek(len(MAGIC) + 8 * int(offsets[0]))
        words = np.frombuffer(self.f.read(8 * int(offsets[-1] - offsets[0])), "<u8")
        n = min(self.n_values, stop * simple8b.BLOCK) - first * simple8b.BLOCK
        return simple8b.decode(words, offsets - offsets[0], n)

    def values(self, start: int, stop: int) -> np.ndarray:
        """Values start..stop-1 of the file, reading only their blocks."""
        if stop <= start:
            return np.zeros(0, np.uint64)
        first = start // simple8b.BLOCK
        got = self.blocks(first, -(-stop // simple8b.BLOCK))
        return got[start - first * simple8b.BLOCK:stop - first * simple8b.BLOCK]

    def documents(self) -> Iterator[tuple[int | None, int, list[np.ndarray]]]:
        """(id, start in the file, the ids in one or more arrays) of each document, block range by block range."""
        per_read = RUN // simple8b.BLOCK
        n_blocks = len(self.offsets) - 1
        doc, parts = 0, []
        for first in range(0, n_blocks, per_read):
            base = first * simple8b.BLOCK
            got = self.blocks(first, min(n_blocks, first + per_read))
            while doc < len(self.ids):
                stop = int(self.starts[doc + 1])
                parts.append(got[max(0, int(self.starts[doc]) - base):stop - base])
                if stop > base + len(got):
                    break
                yield int(self.ids[doc]) if self.valid[doc] else None, int(self.starts[doc]), parts
                doc, parts = doc + 1, []


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 1, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """Write the files; one row a file (part, seq, path, n_values, n_docs), kept in a checkpoint."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end = library_encoder(tokenizer_path), np.array([end_id], dtype="<u4")
        part, seq, out = TaskContext.get().partitionId(), 0, TokenFile()

        def close() -> pd.DataFrame:
            path = f"{folder}/tokens-{part:06d}-{seq:05d}.s8b"
            write_file(path, out.data())
            return pd.DataFrame({"part": [part], "seq": [seq], "path": [path], "n_values": [out.n_values],
                                 "n_docs": [len(out.ids)]})
        for batch in batches:
            for doc_id, ids in zip(batch["id"], encoder.encode_some(batch["text"])):
                out.add(None if pd.isna(doc_id) else int(doc_id), np.concatenate((ids, end)))
                if out.starts[-1] >= FILE_VALUES:
                    yield close()
                    seq, out = seq + 1, TokenFile()
        if out.ids:
            yield close()

    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"),
                         F.monotonically_increasing_id().alias("row"))
    keys = [F.col("id").asc_nulls_last(), F.col("row")]      # the row parts equal ids, many as they may be
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = narrow.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("id", "text")
    checkpoint_dir(spark)
    return ordered.mapInPandas(run, FILES).checkpoint(eager=True)


def read_token_files(files: DataFrame) -> DataFrame:
    """Per document, from the files: id, ids of all documents before it, its ids' number and crc32."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, base in zip(batch["path"], batch["base"]):
                fs, at = open_fs(path)
                with fs.open_input_file(at) as f:
                    rows = []
                    for doc_id, start, parts in TokenFileReader(f).documents():
                        crc = 0
                        for part in parts:
                            crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                        rows.append((doc_id, base + start, sum(map(len, parts)), crc))
                yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"]).astype({"doc_id": "Int64"})

    # one row a file: the running sum is over as many rows as there are files
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    based = files.withColumn("base", F.coalesce(F.sum("n_values").over(before), F.lit(0)))
    return based.select("path", "base").repartition(max(1, files.count())).mapInPandas(run, ROWS)


def token_files_round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id",
                           text_col: str = "text") -> DataFrame:
    folder = shared_folder(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, tokenizer_path, folder, end_id, id_col, text_col))

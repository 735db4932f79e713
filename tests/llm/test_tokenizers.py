"""Token counts, byte-level BPE and token files against the tokenizer libraries."""

import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from data import SF, awkward, empty
from tokenizers import Tokenizer

from carescope.llm import byte_bpe, simple8b, token_counts, token_files
from carescope.llm.queries import QUERIES

WORDS, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = ["a", "b", " ", "  ", "\n", "é", "é", "th", "ing", "'s", "'ll", "1", "23", "　", "漢", "字", "😀", "\x85", "aaaa",
            "!!", "$", "ß", "\x1c", "​", "zq", "\t", "<|endoftext|>", "<|startoftext|>", "Σ", "İ", "the", "tion", "<|", "É", "µ"]


def texts(n, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def test_counts_are_the_librarys(library):
    counter = token_counts.PrefixCounter(WORDS)
    for t in texts(3000):
        assert counter.count(t) == len(library.encode(t, add_special_tokens=False).ids), repr(t)


def test_every_prefix_and_budget(library):
    counter = token_counts.PrefixCounter(WORDS)
    for word in ("internationalization", "thththeaou", "a"):
        assert counter.prefix_table(word) == [len(library.encode(word[:k], add_special_tokens=False).ids) for k in range(len(word) + 1)]
    text = "some internationalization of thththeaou words"
    for budget in range(12):
        whole, symbols = counter.truncation(text, budget)
        pieces = counter.pieces(text)
        fits = pieces[:whole] + ([pieces[whole][:symbols]] if symbols else [])
        assert sum(counter.prefix_table(p)[-1] for p in fits) <= budget
        if whole < len(pieces):
            longer = pieces[:whole] + [pieces[whole][:symbols + 1]]
            assert sum(counter.prefix_table(p)[-1] for p in longer) > budget


def test_transducer_is_tiktoken(tik):
    bpe = byte_bpe.ByteBpe(byte_bpe.read_ranks(RANKS), P.PATTERN)
    for t in texts(3000, 2):
        ids = tik.encode_ordinary(t)
        assert np.frombuffer(bpe.encode_packed(t), "<u4").tolist() == ids, repr(t)
        assert bpe.decode(ids) == t.encode()


def test_transducer_begun_anew_gives_the_same(tik):
    small = byte_bpe.Transducer(byte_bpe.read_ranks(RANKS), states=50)
    for word in ("internationalization", "donaudampfschifffahrt", "aaaaaaaaaaaaaaaaaaaaaaa", "xyzzyxyzzy" * 20):
        assert small.encode(word.encode()) == tik.encode_ordinary(word)


def test_streaming_decoder():
    rnd = random.Random(3)
    for _ in range(500):
        data = bytes(rnd.choice([*range(256), 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80]) for _ in range(12)) + "é😀€".encode()
        stream, out, at = byte_bpe.Utf8Stream(), "", 0
        while at < len(data):
            step = rnd.randint(1, 3)
            out, at = out + stream.feed(data[at:at + step]), at + step
        assert out + stream.close() == data.decode("utf-8", "replace")


@pytest.mark.parametrize("n", [0, 1, 5, 1023, 1024, 1025, 20_000])
@pytest.mark.parametrize("high", [1, 2, 50_000, 2 ** 31, 2 ** 60, 2 ** 63])
def test_simple8b(n, high):
    values = np.random.default_rng(n).integers(0, high, n, dtype=np.uint64)
    if n > 10 and high > 2 ** 40:
        values[3:5] = 2 ** 64 - 1
    words, offsets = simple8b.encode(values)
    assert (simple8b.decode(words, offsets, n) == values).all()
    if n > 2048:
        assert (simple8b.decode(words[offsets[1]:offsets[2]], offsets[1:3] - offsets[1], 1024) == values[1024:2048]).all()


def test_queries_over_whole_table(spark, library, tik):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    counts = {r["doc_id"]: r for r in QUERIES["op2_token_counts"](spark, SF).collect()}
    bpe = {r["doc_id"]: r for r in QUERIES["op3_byte_bpe"](spark, SF).collect()}
    files = {r["doc_id"]: r for r in QUERIES["op5_token_files"](spark, SF).collect()}
    assert docs.keys() == counts.keys() == bpe.keys() == files.keys()
    start = 0
    for doc_id in sorted(docs):
        text = docs[doc_id]
        ids = library.encode(text, add_special_tokens=False).ids
        c, b, f = counts[doc_id], bpe[doc_id], files[doc_id]
        assert (c["n_bytes"], c["n_tokens"], c["over_limit"]) == (len(text.encode()), len(ids), len(ids) > 2048)
        own = np.array(tik.encode_ordinary(text), dtype="<u4")
        assert (b["n_tokens"], b["ids_sha256"], b["decoded_sha256"]) == (
            len(own), hashlib.sha256(own.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        packed = np.array([*ids, 1], dtype="<u4")
        assert (f["start"], f["n_tokens"], f["ids_crc32"]) == (start, len(packed), zlib.crc32(packed.tobytes()))
        start += len(packed)


def test_awkward_rows(spark, library, tik):
    docs = awkward(spark)
    rows = docs.select("doc_id", "text").collect()
    n = sorted(len(library.encode(r["text"] or "", add_special_tokens=False).ids) for r in rows)
    assert sorted(r["n_tokens"] for r in token_counts.token_counts(docs, WORDS).collect()) == n
    digests = sorted(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in rows)
    assert sorted(r["decoded_sha256"] for r in byte_bpe.round_trip_digests(docs, RANKS, P.PATTERN).collect()) == digests
    encoded = byte_bpe.encode_documents(docs, RANKS, P.PATTERN)
    decoded = byte_bpe.decode_documents(encoded, RANKS, P.PATTERN)
    assert sorted(r["text"] for r in decoded.collect()) == sorted(r["text"] or "" for r in rows)
    files = token_files.token_files_round_trip(docs, WORDS).orderBy("start").collect()
    assert sorted(r["n_tokens"] for r in files) == sorted(x + 1 for x in n)
    assert [r["start"] for r in files] == [sum(r["n_tokens"] for r in files[:k]) for k in range(len(files))]
    ids = [r["doc_id"] for r in files]
    assert ids[-1] is None and ids[:-1] == sorted(ids[:-1])


def test_empty_tables(spark):
    docs = empty(spark)
    assert token_counts.token_counts(docs, WORDS).count() == 0
    assert byte_bpe.round_trip_digests(docs, RANKS, P.PATTERN).count() == 0
    assert token_files.token_files_round_trip(docs, WORDS).count() == 0


def test_digests_are_of_the_streamed_text(monkeypatch):
    bpe = byte_bpe.byte_bpe(RANKS, P.PATTERN)
    one = {t: i for i, t in bpe.tokens.items() if len(t) == 1}
    for data in ("naïve 漢字 😀".encode(), b"a\xe6\xbc", b"\xf0\x9f\x98 b", b"\xff", b""):
        want = hashlib.sha256(data.decode("utf-8", "replace").encode()).hexdigest()
        for fed in (1, 2, 256):
            monkeypatch.setattr(byte_bpe, "FED", fed)
            assert byte_bpe.decoded_digest(bpe, [one[bytes([x])] for x in data]) == want


def test_units_learned_together_are_as_encoded_alone(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(150).collect() if r.text]
    texts += ["", "  a  b ", "Élan vital, naïve café — 漢字 😀 <|endoftext|> it's [CLS] [UNK] é́ ﬁ ² İ ß", "x" * 500 + " y", "a​b ﻿ c\x00d"]
    encoder = token_files.LibraryEncoder(P.path("word_bpe_49k.json"))
    encoder.units.bound = encoder.words.bound = 500            # generations change
    assert encoder.by_unit and encoder.by_word
    for t, ids in zip(texts, encoder.encode_some(texts), strict=True):
        assert ids.tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


def test_small_tables_give_the_same_ids():
    ranks = byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    big, small = (byte_bpe.ByteBpe(ranks, P.PATTERN, share) for share in (1.0, 0.0002))
    text = " ".join(f"word{k % 97} Ünï{k % 31}, {k * k}!" for k in range(3000))
    assert big.encode_packed(text) == small.encode_packed(text) and big.decode(big.encode(text)) == text.encode()


ODD = [*ALPHABET, "À", "Þ", "ß", "ÿ", "Ÿ", "×", "÷", "ñ", "n̄", "́", "ª", "Ab", "Zz", "9", "0", "'S", "<", ">", "|", "\r\n", "\v", "\f", "\x85", " ",
       "\x1f", "\x00", "\x7f", "﻿", "ſ", "K", "_", "-.", "@", "\\"]


def test_texts_cut_by_columns_are_as_encoded_alone(library):
    rnd = random.Random(5)
    some = ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 25))) for _ in range(4000)] + ["", "", "a", "", "É" * 300, "ab1" * 400, ""]
    encoder = token_files.LibraryEncoder(WORDS)
    assert [i.tolist() for i in encoder.encode_some(some)] == [library.encode(t, add_special_tokens=False).ids for t in some]
    assert [i.tolist() for i in encoder.encode_some([""])] == [[]] and not list(encoder.encode_some([]))


def test_plain_texts_are_encoded_by_distinct_pieces(library, monkeypatch):
    encoder, whole, made = token_files.LibraryEncoder(WORDS), [], []
    encoded, make = encoder._encoded, encoder.words.make
    monkeypatch.setattr(encoder, "_encoded", lambda parts: whole.extend(parts) or encoded(parts))
    monkeypatch.setattr(encoder.words, "make", lambda p: made.append(p) or make(p))
    some = [f"Word.\nWörd, x{k} y,ZÉ{k};\tWORD\r\n" for k in range(50)] * 2
    for text, ids in zip(some, encoder.encode_some(some), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert not whole
    assert sorted(made) == sorted({b"word", "wörd".encode(), "zé".encode(), b"x", b"y", b".", b",", b";", *(b"%d" % d for d in range(10))})


@pytest.mark.parametrize("change", ["added", "spaced", "pattern", "cased", "kept"])
def test_other_tokenizer_files(tmp_path, change):
    with open(WORDS, encoding="utf-8") as f:
        spec = json.load(f)
    cut = spec["pre_tokenizer"]["pretokenizers"][0]
    if change in ("added", "spaced"):
        spec["added_tokens"].append(spec["added_tokens"][0] | {"id": 49408, "content": "hing" if change == "added" else "< x", "special": False})
    elif change == "pattern":
        cut["pattern"] = {"Regex": r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"}
    elif change == "cased":
        spec["normalizer"]["normalizers"].pop()
    else:
        cut |= {"behavior": "Isolated", "invert": False, "pattern": {"Regex": r"\s?\p{L}+"}}
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    encoder, own = token_files.LibraryEncoder(path), Tokenizer.from_file(path)
    some = ["Something thing, a1b2 THING 12345...!? Élan xthingx", "  a  b\n\nc.D e", "", "don't 's <|endoftext|> ÀÉ×"]
    assert not encoder.by_word
    assert [i.tolist() for i in encoder.encode_some(some)] == [own.encode(t, add_special_tokens=False).ids for t in some]

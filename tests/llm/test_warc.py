"""ZIP ranges and WARC records: against zipfile, round trips, awkward rows."""

import base64
import hashlib
import io
import zipfile

import pytest
from data import SF

from carescope.llm import warc
from carescope.llm.queries import QUERIES
from carescope.llm.zip_ranges import ZipRanges, pack


class Bytes(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_archives_are_zip_files():
    members = [("archive/data", b"x" * 1000), ("empty", b""), ("naïve", b"\x00\xff")]
    data = pack(members)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None and [(i.filename, z.read(i)) for i in z.infolist()] == members
    own = ZipRanges(Bytes(data))
    assert [(n, own.read(n)) for n in own.members] == members
    assert own.read("archive/data", 990, 100) == b"x" * 10


@pytest.mark.parametrize("zip64", [False, True])
def test_other_writers_archives(zip64):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        with z.open("a", "w", force_zip64=zip64) as f:
            f.write(b"hello world")
        z.writestr("packed", b"aaaa" * 100, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 a comment that holds the mark"
    own = ZipRanges(Bytes(raw.getvalue()))
    assert own.read("a", 6, 5) == b"world"
    with pytest.raises(ValueError, match="compressed"):
        own.read("packed")
    with pytest.raises(ValueError):
        ZipRanges(Bytes(raw.getvalue()[:-5]))


def expected(pages, least=0):
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), by brute force."""
    out, first = [], {}
    order = sorted(range(len(pages)), key=lambda k: (pages[k][0] is None, pages[k][0] or 0, k))
    for k in order:
        page, data = pages[k][0], (pages[k][2] or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        known = digest in first and len(data) >= least
        out.append((page, len(data), digest, "revisit" if known else "response", first.get(digest) if known else None))
        first.setdefault(digest, page)
    return out


def tuples(df):
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    return sorted((tuple(r) for r in df.collect()), key=key)


def test_query(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    got = QUERIES["op9_warc"](spark, SF)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert tuples(got) == sorted(expected(pages), key=key)


ROWS = [(1, "http://a/ b\r\nX: y", "<p>same</p>", "x"), (2, None, "<p>same</p>", None), (3, "u", None, "x"), (4, "u", "", "x"),
        (5, "u", "<p>é\r\n\r\nWARC/1.1</p>", "x"), (None, "u", "<p>same</p>", "x"), (6, "u", "L" * 300_000, "x"),
        (7, "u", "twice", "x"), (7, "u", "twice", "x")]
PAGES = "page_id bigint, url string, html string, digest string"


@pytest.mark.parametrize("least", [0, 6])
def test_awkward_rows(spark, least, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 200)       # several archives a task
    pages = spark.createDataFrame(ROWS, PAGES)
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert tuples(warc.archives_round_trip(pages, least)) == sorted(expected(ROWS, least), key=key)


def test_empty_table(spark):
    assert warc.archives_round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_damage_is_told():
    record = warc.record(1, "u", b"payload", base64.b32encode(hashlib.sha1(b"payload").digest()).decode(), None, "2024-01-01T00:00:00Z")
    import gzip
    assert warc.read_record(gzip.compress(record))[:2] == (1, 7)
    with pytest.raises(ValueError, match="damaged"):
        warc.read_record(gzip.compress(record.replace(b"payload\r", b"pavload\r")))

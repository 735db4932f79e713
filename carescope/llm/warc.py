"""WARC records in ZIP-packaged archives, read by range.

Each archive is a ZIP file of stored members: the WARC file (one gzip member a record), an index
with one line a record (offset, length, page id), and a short description. The reader takes the
central directory (ZIP64 too), finds the members, reads the index, and then each record by its
range; nothing is extracted.

Of pages with equal payloads of at least ``revisit_bytes`` bytes, that with the least page id is a
response; the others are revisits that refer to it and carry only headers. Payloads are equal if
their SHA-1 and length are.

Cases: a null html is an empty payload; a null url has no target URI; a null page id comes after
all others, and its record has none. Repeated rows (same id and payload) are one response, the
first, and revisits that refer to that same id. An empty table gives no archive and no row. Only
the id, url and html columns are read, so other columns do not matter. Archives are written to the
shared folder of the checkpoints under the name of the task attempt, and only the names that a
finished attempt returns are read, so lost executors and repeated tasks do no harm.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carescope.llm.common import checkpoint_dir, open_fs, shared_folder, write_file
from carescope.llm.zip_ranges import ZipRanges, pack

ARCHIVE_BYTES = 16 << 20      # compressed bytes after which an archive ends
WARC, INDEX, ABOUT = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILES = "path string, n_records bigint"
ROWS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:sha1:{digest}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One WARC record; with ``refers_to`` a revisit, whose block is the HTTP header alone."""
    block = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
             + (payload if refers_to is None else b""))
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)),
              ("WARC-Date", date), ("Content-Type", "application/http; msgtype=response"),
              ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Length", str(len(block)))]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", refers_to)]
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(fields by lower-case name, block) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    return fields, rest[:int(fields["content-length"])]


def page_of(identifier: str) -> int | None:
    page = identifier.split(":")[2]
    return int(page) if page else None


def read_record(data: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of a gzip member."""
    fields, block = parse(gzip.decompress(data))
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].partition(":")[2]
    size = int(re.search(rb"(?im)^Content-Length:\s*(\d+)", http)[1])
    if kind == "response":
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if (len(payload), found) != (size, digest):
            raise ValueError(f"payload of {fields['warc-record-id']} is damaged")
    refers = fields.get("warc-refers-to")
    return page_of(fields["warc-record-id"]), size, digest, kind, None if refers is None else page_of(refers)


class Archive:
    """Collects records; ``data`` is the ZIP file."""

    def __init__(self):
        self.warc, self.index = io.BytesIO(), []

    def add(self, page_id: int | None, data: bytes) -> None:
        packed, at = gzip.compress(data, 6, mtime=0), self.warc.tell()
        self.warc.write(packed)
        self.index.append(json.dumps({"page_id": page_id, "offset": at, "length": len(packed)}))

    def data(self) -> bytes:
        about = json.dumps({"profile": "data-package", "records": len(self.index), "resources": [WARC, INDEX]})
        return pack([(WARC, self.warc.getvalue()), (INDEX, "\n".join(self.index).encode()), (ABOUT, about.encode())])


def archive_records(f) -> Iterator[tuple]:
    """The records of an open archive, each read by its range."""
    archive = ZipRanges(f)
    start = archive.start(WARC)
    for line in archive.read(INDEX).decode().splitlines():
        entry = json.loads(line)
        f.seek(start + entry["offset"])
        yield read_record(f.read(entry["length"]))


def with_roles(pages: DataFrame, revisit_bytes: int = 0, id_col: str = "page_id", url_col: str = "url",
               html_col: str = "html") -> DataFrame:
    """page_id, url, payload, digest (hex) and, for revisits, ``first_page``: the response's id."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = (pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                         payload.alias("payload"), F.monotonically_increasing_id().alias("row"))
            .withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload")))
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "row")
    # one small row a payload leaves each task, however many pages share it
    first = (rows.select("digest", "bytes", order.alias("o")).groupBy("digest", "bytes").agg(F.min("o").alias("o"))
             .select("digest", "bytes", F.col("o.page_id").alias("first_page"), F.col("o.row").alias("first_row")))
    revisit = (F.col("row") != F.col("first_row")) & (F.col("bytes") >= F.lit(revisit_bytes))
    return rows.join(first, ["digest", "bytes"]).select(
        "page_id", "url", "payload", "digest", revisit.alias("revisit"),
        F.when(revisit, F.col("first_page")).alias("first_page"))


def write_archives(pages: DataFrame, folder: str, revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z",
                   **columns: str) -> DataFrame:
    """Write the archives; one row each (path, n_records), kept in a checkpoint."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        attempt, seq, out = TaskContext.get().taskAttemptId(), 0, Archive()

        def close() -> pd.DataFrame:
            path = f"{folder}/pages-{attempt:09d}-{seq:05d}.wacz"
            write_file(path, out.data())
            return pd.DataFrame({"path": [path], "n_records": [len(out.index)]})
        for batch in batches:
            for page, url, payload, digest, revisit, first in batch.itertuples(index=False):
                page = None if pd.isna(page) else int(page)
                digest = base64.b32encode(bytes.fromhex(digest)).decode()
                refers = record_id(None if pd.isna(first) else int(first), digest) if revisit else None
                out.add(page, record(page, url, bytes(payload), digest, refers, date))
                if out.warc.tell() >= ARCHIVE_BYTES:
                    yield close()
                    seq, out = seq + 1, Archive()
        if out.index:
            yield close()

    checkpoint_dir(pages.sparkSession)
    return with_roles(pages, revisit_bytes, **columns).mapInPandas(run, FILES).checkpoint(eager=True)


def read_archives(files: DataFrame) -> DataFrame:
    """Per record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                fs, at = open_fs(path)
                with fs.open_input_file(at) as f:
                    rows = pd.DataFrame(archive_records(f), columns=["page_id", "payload_bytes", "payload_digest",
                                                                     "record_type", "refers_to"])
                yield rows.astype({"page_id": "Int64", "refers_to": "Int64"})

    return files.select("path").repartition(max(1, files.count())).mapInPandas(run, ROWS)


def archives_round_trip(pages: DataFrame, revisit_bytes: int = 0) -> DataFrame:
    folder = shared_folder(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, revisit_bytes))

"""Secret scans over every version of every text, through an incremental ledger of blobs.

A text is addressed by its content (SHA-256): a blob. The ledger, a Parquet table in a shared
folder, holds one row per (blob, rule, rule version) ever scanned, with the spans found, none
included. An update brings each distinct blob once to one place, looks up what the ledger knows of
it, and scans only the pairs of blob and rule version that it lacks; a changed rule gets a higher
version and is scanned again, alone. Findings are joined back to all rows (paths, versions) that
hold the blob. Copies of a blob are reduced in every task before the shuffle, so a blob that a
third of all rows share is no hot key; the join back to the rows has the small side keyed once.

Spans count code points, end exclusive, and cover the whole match.

Cases: a null text counts as empty and has no spans; repeated rows give repeated results; an
update by an empty table leaves the ledger as it is, and an empty table has no findings; a span
starting where another starts is ordered by the rules' order; only the text and id columns are
read from the rows, so other columns, whatever their names, do not matter. Two updates at once may
both scan a blob: equal ledger rows count once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carescope.llm.common import cut_lineage, shared_folder, whole_text
from carescope.session import remove_folder

SALTS = 16        # keys that the rows of one blob are dealt over when findings are joined back
LEDGER = "blob binary, rule string, version int, spans array<struct<start:bigint,end:bigint>>"


@dataclass(frozen=True)
class Rule:
    """``pattern`` matches leftmost and non-overlapping; a match that fails ``keep`` is dropped,
    though its characters are used up. ``hint`` (lower case) is in every text that can match."""

    name: str
    version: int
    pattern: str
    flags: int = re.ASCII
    keep: Callable | None = None
    hint: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


def _long_value(match: re.Match) -> bool:
    return len(match[2]) >= 6


def _long_match(match: re.Match) -> bool:
    return len(match[0]) >= 20


#: The three base kinds, in the order in which equal starts are listed.
BASE = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         re.ASCII | re.IGNORECASE, _long_value, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", re.ASCII, _long_match, ("akia",)),
    # the same runs as [0-9a-f]+ of 24 characters or more: a match is always a whole run
    Rule("hex", 1, r"[0-9a-f]{24,}", re.ASCII),
)
#: Further kinds: key blocks, signed tokens, passwords in addresses.
MORE = (
    Rule("private_key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", re.ASCII, None, ("private key-----",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", re.ASCII, None, ("eyj",)),
    Rule("url_password", 1, r"[A-Za-z][A-Za-z0-9+.-]{0,30}://[^\s/:@]{1,256}:[^\s/@]{1,256}@[A-Za-z0-9.-]+", re.ASCII,
         None, ("://",)),
)
RULES = BASE + MORE


def spans_of(text: str, rule: Rule) -> list[dict]:
    return [{"start": m.start(), "end": m.end()} for m in re.finditer(rule.pattern, text, rule.flags)
            if rule.keep is None or rule.keep(m)]


def blob_of(text_col: str = "text") -> Column:
    return F.unhex(F.sha2(whole_text(text_col), 256))


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger's rows; none where nothing has been scanned yet."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(folder)


def unseen(versions: DataFrame, ledger: DataFrame, rules: Sequence[Rule], text_col: str = "text") -> DataFrame:
    """(blob, text, todo): each distinct text with the rule versions that the ledger lacks for it."""
    blobs = versions.select(blob_of(text_col).alias("blob"), whole_text(text_col).alias("text")).groupBy("blob").agg(
        F.first("text").alias("text"))
    seen = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "rule", F.col("version").cast("string"))).alias("seen"))
    every = F.array(*[F.lit(r.key) for r in rules])
    todo = F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))
    return blobs.join(seen, "blob", "left").select("blob", "text", todo.alias("todo")).where(F.size("todo") > 0)


def update_ledger(versions: DataFrame, folder: str, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """Scan what the ledger in ``folder`` lacks, append it there, and return the whole ledger.

    ``versions`` has a row for every version of every path; only its texts matter here.
    """
    rules, spark = tuple(rules), versions.sparkSession
    by_key = {r.key: r for r in rules}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for blob, text, todo in zip(batch["blob"], batch["text"], batch["todo"]):
                low = text.lower()
                for rule in map(by_key.__getitem__, todo):
                    may = not rule.hint or any(h in low for h in rule.hint)
                    out.append((blob, rule.name, rule.version, spans_of(text, rule) if may else []))
            yield pd.DataFrame(out, columns=["blob", "rule", "version", "spans"])

    found = unseen(versions, read_ledger(spark, folder), rules, text_col).mapInPandas(run, LEDGER)
    found.write.mode("append").parquet(folder)
    return read_ledger(spark, folder)


def blob_findings(ledger: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(blob, found): the spans of the given rule versions, in order of start and rule, for blobs that have any."""
    now = F.concat_ws("@", "rule", F.col("version").cast("string")).isin([r.key for r in rules])
    order = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.name), F.lit(k))])
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order[F.col("rule")].alias("rank"),
                                                    s["end"].alias("end"), F.col("rule").alias("kind")))
    return (ledger.where(now & (F.size("spans") > 0)).select("blob", spans.alias("spans"))
            .groupBy("blob").agg(F.array_sort(F.flatten(F.collect_set("spans"))).alias("found")))


def findings(versions: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES, id_cols: Sequence[str] = ("doc_id",),
             text_col: str = "text") -> DataFrame:
    """The id columns and ``found`` (array of start, rank, end, kind) of every row of ``versions``."""
    names = [f"id_{k}" for k in range(len(id_cols))]
    # rows of one blob may be a third of all: they are dealt over SALTS keys, and findings repeated for each
    rows = versions.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(id_cols, names)], blob_of(text_col).alias("blob"),
                           F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt"))
    found = blob_findings(ledger, rules).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
    return (rows.join(found, ["blob", "salt"], "left")
            .select(*[F.col(n).alias(c) for c, n in zip(id_cols, names)], F.coalesce("found", none).alias("found")))


def _of_kinds(kinds: list[str]) -> Column:
    return F.filter("found", lambda s: s["kind"].isin(kinds))


def _listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_documents(docs: DataFrame, folder: str | None = None, rules: Sequence[Rule] = RULES, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Per row: its id, the numbers of base findings by kind, the digest of the base spans, and all spans.

    Without ``folder`` the ledger is a new one, removed when the findings have been joined.
    """
    spark = docs.sparkSession
    place = folder or shared_folder(spark, "ledger")
    found = findings(docs, update_ledger(docs, place, rules, text_col), rules, (id_col,), text_col)
    base = _of_kinds([r.name for r in BASE])
    counts = [F.size(_of_kinds([r.name])).cast("long").alias(f"n_{r.name}") for r in BASE]
    out = found.select(F.col(id_col).cast("long").alias("doc_id"), *counts, F.sha2(_listed(base), 256).alias("base_sha256"),
                       _listed(F.col("found")).alias("spans"))
    if folder is None:
        out = cut_lineage(out)
        remove_folder(spark, place)
    return out

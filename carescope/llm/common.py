"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carescope.session import checkpoint_dir, cut_lineage

__all__ = ["Kept", "checkpoint_dir", "cut_lineage", "documents", "id_fold", "open_fs", "resident", "row_numbers",
           "shared_folder", "table", "whole_text", "write_file"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def whole_text(text_col: str = "text") -> Column:
    """The whole text; a null text counts as the empty one."""
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def id_fold(id_col: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds`` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def row_numbers(df: DataFrame, order: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """Global row numbers 0..n-1 in the order of ``order``, without a one-task window.

    The narrow rows are range-partitioned with a salt as last sort key (so that equal rows spread
    over several partitions), sorted, and written once to the shared checkpoint folder. Row counts
    of the partitions (one row each) give the offsets. Returns the numbered rows and n.
    """
    spark = df.sparkSession
    salted = df.withColumn("__salt", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_last() for c in order] + [F.col("__salt")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    checkpoint_dir(spark)
    ranged = (salted.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("__salt")
              .checkpoint(eager=True))
    placed = ranged.withColumn("__at", F.monotonically_increasing_id())
    part = F.shiftright("__at", 33).cast("int")
    sizes = {r[0]: r[1] for r in placed.groupBy(part.alias("p")).count().collect()}  # one row a partition
    offsets, total = {}, 0
    for p in sorted(sizes):
        offsets[p] = total
        total += sizes[p]
    if not offsets:
        return placed.drop("__at").withColumn(name, F.lit(0).cast("long")), 0
    # one entry a shuffle partition: a literal array, indexed by the partition
    starts = F.array(*[F.lit(offsets.get(p, 0)).cast("long") for p in range(max(offsets) + 1)])
    at = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn(name, F.element_at(starts, part + 1) + at).drop("__at"), total


class Kept:
    """Values of a function by key, kept in two generations of bounded size.

    When the younger one is full it becomes the older one, whose former keys are forgotten; a key
    found in the older one moves up. Frequent keys so stay, and memory stays bounded.
    """

    def __init__(self, make: Callable, bound: int):
        self.make, self.bound = make, bound
        self.young: dict = {}
        self.old: dict = {}

    def one(self, key):
        value = self.young.get(key)
        if value is None:
            value = self.old.pop(key, None)
            if value is None:
                value = self.make(key)
            if len(self.young) >= self.bound:
                self.young, self.old = {}, self.young
            self.young[key] = value
        return value

    def known(self, keys: set) -> tuple[dict, set]:
        """(values of the keys that are kept, the other keys)."""
        young, old = self.young, self.old
        found = {k: young[k] for k in keys & young.keys()}
        rest = keys - found.keys()
        again = {k: old[k] for k in rest & old.keys()}
        self.add(again)
        found.update(again)
        return found, rest - again.keys()

    def add(self, values: dict) -> None:
        """Keep values by key; a batch may go over the bound once before the generations change."""
        if len(self.young) >= self.bound:
            self.young, self.old = {}, self.young
        self.young.update(values)

    def many(self, keys: list) -> list:
        values = list(map(self.young.get, keys))
        if None in values:
            one = self.one
            values = [one(k) if v is None else v for k, v in zip(keys, values)]
        return values


_RESIDENT: list = []


def resident(key, make: Callable):
    """The value of ``make`` for this worker, kept while no other operator asks for its own.

    Workers outlive tasks and stages; keeping one operator's tables at a time bounds their memory.
    """
    if not _RESIDENT or _RESIDENT[0][0] != key:
        _RESIDENT.clear()
        _RESIDENT.append((key, make()))
    return _RESIDENT[0][1]


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder URI for files that executors write and others read, beside the checkpoints."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def open_fs(uri: str):
    """(file system, path) of a URI; works in tasks on any scheme that pyarrow knows."""
    from pyarrow import fs

    if "://" not in uri:
        uri = "file://" + (uri[5:] if uri.startswith("file:") else uri)
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, data: bytes) -> None:
    """Write a file in one step: under a name of this attempt, then moved into place, so that a
    repeated or speculative task leaves the whole file of one attempt."""
    fs, path = open_fs(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(temporary) as out:
        out.write(data)
    fs.move(temporary, path)

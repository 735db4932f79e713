"""Published model bundles (S8 + S9 + S11): manifest, model, calibration and card under one version.

A version is written whole into a folder of its own and becomes current by one pointer: an empty
file whose name holds a rising number and the version. Creating an empty file is atomic on every
file system that Spark writes, and a reader takes the pointer of highest number, so a version that
is half written is never read, two publishers at once leave two whole versions, and going back is
one more pointer to an earlier version. The list of a version's files and their lengths is written
last; loading checks it.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from ..operators.boosting import BoostedTrees
from ..operators.features import FeatureSpec
from ..operators.treeshap import TreeScorer
from . import io

POINTERS, VERSIONS = "pointers", "versions"


@dataclass
class Bundle:
    """What scoring needs, read from one published version; ``card`` says how it was made."""

    version: str
    spec: FeatureSpec
    model: BoostedTrees
    platt: tuple[float, float] | None
    card: dict = field(default_factory=dict)

    def scorer(self) -> TreeScorer:
        """The calibrated scorer of batches and streams; nothing is fitted."""
        return self.model.scorer(self.platt)


class NotPublished(LookupError):
    """No version, or not the one asked for, has been published under a root."""


def _fs(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, place = _fs(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def _lengths(spark: SparkSession, folder: str) -> dict[str, int]:
    """Path below the folder -> bytes, of all data files."""
    fs, place = _fs(spark, folder)
    found, out = fs.listFiles(place, True), {}
    top = fs.getFileStatus(place).getPath().toString().rstrip("/") + "/"
    while found.hasNext():
        status = found.next()
        name = status.getPath().toString()[len(top):]
        if not name.rsplit("/", 1)[-1].startswith((".", "_")) and not name.startswith("files/"):
            out[name] = status.getLen()
    return out


def versions(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(number, version) of every pointer, oldest first."""
    out = []
    for name in _names(spark, f"{root}/{POINTERS}"):
        number, _, version = name.partition("-")
        if number.isdigit() and version:
            out.append((int(number), version))
    return sorted(out)


def make_current(spark: SparkSession, root: str, version: str) -> int:
    """Point to a whole version; returns the pointer's number."""
    fs, listing = _fs(spark, f"{root}/{VERSIONS}/{version}/files")
    if not fs.exists(listing):
        raise NotPublished(f"{version} is not a whole version under {root}")
    number = max((n for n, _ in versions(spark, root)), default=0) + 1
    fs, pointer = _fs(spark, f"{root}/{POINTERS}/{number:012d}-{version}")
    fs.mkdirs(pointer.getParent())
    fs.create(pointer, False).close()
    return number


def publish(spark: SparkSession, root: str, spec: FeatureSpec, model: BoostedTrees, platt: tuple[float, float] | None = None,
            card: dict | None = None) -> str:
    """Write a new version whole, then make it current."""
    if spec.feature_names() != model.features:
        raise ValueError("the model's features are not those of the manifest, in its order")
    version = f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S}-{uuid.uuid4().hex}"
    folder = f"{root}/{VERSIONS}/{version}"
    io.write_manifest(spec, f"{folder}/manifest", spark)
    model.save(f"{folder}/model")
    text = json.dumps({"platt": platt, "card": card or {}})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{folder}/card")
    spark.createDataFrame([(json.dumps(_lengths(spark, folder)),)], "value string").coalesce(1).write.text(f"{folder}/files")
    make_current(spark, root, version)
    return version


def load(spark: SparkSession, root: str, version: str | None = None) -> Bundle:
    """The current version, or a named one."""
    known = versions(spark, root)
    if not known or (version is not None and version not in {v for _, v in known}):
        raise NotPublished(f"{version or 'nothing'} is published under {root}")
    version = version or known[-1][1]
    folder = f"{root}/{VERSIONS}/{version}"
    listed = json.loads(spark.read.text(f"{folder}/files", wholetext=True).first()[0])
    there = _lengths(spark, folder)
    if listed != there:
        raise ValueError(f"{folder} is not as it was published: {sorted(set(listed.items()) ^ set(there.items()))[:4]}")
    spec, model = io.read_manifest(f"{folder}/manifest", spark), BoostedTrees.load(f"{folder}/model")
    if spec.feature_names() != model.features:
        raise ValueError(f"{folder}: manifest and model do not belong together")
    doc = json.loads(spark.read.text(f"{folder}/card", wholetext=True).first()[0])
    return Bundle(version, spec, model, tuple(doc["platt"]) if doc["platt"] else None, doc["card"])

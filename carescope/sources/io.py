"""Sources and sinks (S1-S9): padded CSV, record batches, landing, exports, manifest, model artifacts."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import prep

CORRUPT = "_corrupt_record"
# Code columns read as strings so "250.00" keeps its sub-code.
CODE_COLUMNS = ("diag_1", "diag_2", "diag_3")


def read_padded_csv(spark: SparkSession, path: str, schema: StructType | str | None = None,
                    null_tokens: Sequence[str] = prep.NULL_TOKENS) -> DataFrame:
    """CSV whose headers and cells are space padded; stripped, blank/null tokens -> null.

    Without an explicit schema every column is read as a string (code columns must never be
    inferred); callers cast numerics, or pass a schema whose names are the *trimmed* headers.
    """
    reader = (spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True)
              .option("ignoreTrailingWhiteSpace", True).option("mode", "PERMISSIVE"))
    if schema is None:
        return prep.trim_string_cells(prep.trim_column_names(reader.csv(path)), null_tokens)
    raw = prep.trim_column_names(reader.option("enforceSchema", False).csv(path))
    st = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    cleaned = prep.trim_string_cells(raw, null_tokens)
    return cleaned.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in st.fields])


def land_raw(df: DataFrame, path: str) -> str:
    """Idempotent landing - written once, skipped when the target already exists."""
    df.write.mode("ignore").parquet(path)
    return path


def read_record_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """S3: a batch of records from CSV with a fixed schema; malformed lines kept in ``_corrupt_record``."""
    from pyspark.sql.types import StringType, StructField
    st = StructType(list(schema.fields) + [StructField(CORRUPT, StringType(), True)])
    raw = (spark.read.schema(st).option("header", True).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", CORRUPT).option("nanValue", "NaN").csv(path))
    # NaN in a floating field is a missing value, as in the record sources of the reference
    return raw.select(*[F.when(~F.isnan(F.col(f.name)), F.col(f.name)).alias(f.name)
                        if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in st.fields])


def read_record_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A JSON array of records (multi-line); malformed input becomes a ``_corrupt_record`` row, not a crash."""
    from pyspark.sql.types import StringType, StructField
    st = StructType(list(schema.fields) + [StructField(CORRUPT, StringType(), True)])
    return (spark.read.schema(st).option("multiLine", True).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT).json(path))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header CSV sink (tables, importance, scored results)."""
    df.write.mode(mode).option("header", True).csv(path)


def read_csv_required(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    """CSV scan that fails with the list of missing required columns."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def export_nested_json(df: DataFrame, path: str, fields: Sequence[str], extra: Sequence[str] = ()) -> None:
    """Nested JSON records ``{<extra>..., fields{...}}`` with NaN -> null and nulls kept."""
    def safe(c: str):
        t = df.schema[c].dataType.typeName()
        return F.when(~F.isnan(F.col(c)), F.col(c)).alias(c) if t in ("double", "float") else F.col(c)
    out = df.select(*[safe(c) for c in extra], F.struct(*[safe(c) for c in fields]).alias("fields"))
    out.write.mode("overwrite").option("ignoreNullFields", False).json(path)


MANIFEST_VERSION = "1.0"


def write_manifest(spec, path: str, spark: SparkSession | None = None) -> str:
    """The frozen feature contract with version, export time and column-set hash, as one JSON text on any
    file system that Spark writes (a folder with one part)."""
    import hashlib
    from datetime import datetime, timezone
    spark = spark or SparkSession.getActiveSession()
    doc = {"manifest_version": MANIFEST_VERSION, "exported_at": datetime.now(timezone.utc).isoformat(), **json.loads(spec.to_json())}
    doc["columns_sha256"] = hashlib.sha256(json.dumps(sorted(doc["feature_names"])).encode()).hexdigest()
    spark.createDataFrame([(json.dumps(doc),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path


def manifest_document(path: str, spark: SparkSession | None = None) -> dict:
    return json.loads((spark or SparkSession.getActiveSession()).read.text(path, wholetext=True).first()[0])


def read_manifest(path: str, spark: SparkSession | None = None):
    """The feature specification of a written manifest: scoring reads it instead of fitting again."""
    from ..operators.features import FeatureSpec
    doc = manifest_document(path, spark)
    return FeatureSpec.from_json(json.dumps({k: v for k, v in doc.items() if k not in ("manifest_version", "exported_at", "columns_sha256")}))


def save_model(model: PipelineModel, path: str) -> None:
    """Model artifact save (Spark ML format)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)

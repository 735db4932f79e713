"""Batch scoring (B1, B3-B5, A26, P20-P22, P29-P30): validate -> align -> score -> top-k -> band.

One DataFrame -> DataFrame function serves a single record, a batch of any size and a stream
(X1). Invalid rows are never dropped or failed: they come out with ``valid = false``, their
reasons, and null scores (quarantine).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from . import explain, features, prep, treeshap, validate

AUDIT_COLUMNS = ("request_id", "row_key", "probability", "risk_band", "n_errors", "valid")


def score_batch(df: DataFrame, spec: features.FeatureSpec, scorer: explain.LinearScorer | treeshap.TreeScorer,
                key: str = "encounter_id", top_k: int = 5, run_id: str = "batch",
                allowed_fields: Sequence[str] | None = None) -> DataFrame:
    """B1: one output row per input row, key carried through (no reliance on row order).

    Validation, cleaning, encoding and scoring are one chain of projections over the input:
    no join, no shuffle, so the same function runs unchanged on a stream (X1). The scorer is a frozen
    linear model or a trained tree ensemble, calibrated or not.
    """
    checked = validate.validate(df, allowed_fields)
    prepared = features.prepare(prep.trim_string_cells(checked, prep.NULL_TOKENS))
    enc = scorer.prepare(prepared.select(key, "valid", "errors", "warnings", *spec.feature_columns()))
    ok = F.col("valid")
    p = scorer.probability()
    return enc.select(
        C.request_id(run_id, F.col(key)).alias("request_id"),
        F.col(key).alias("row_key"), "valid", "errors", "warnings",
        F.when(ok, p).alias("probability"),
        F.when(ok, C.risk_band(p)).alias("risk_band"),
        F.when(ok, C.lift(p)).alias("lift"),
        F.when(ok, explain.top_k(scorer.contributions(), top_k)).alias("top_features"))


def audit_log(scored: DataFrame) -> DataFrame:
    """The privacy-safe audit projection - an allow-list of non-input columns only."""
    return scored.select(*[c if c != "n_errors" else F.size("errors").alias("n_errors") for c in AUDIT_COLUMNS])


def band_counts(scored: DataFrame) -> DataFrame:
    """Rows per risk band (null band = quarantined rows)."""
    return scored.groupBy("risk_band").agg(F.count("*").cast("bigint").alias("n"))


def skipped_report(scored: DataFrame) -> DataFrame:
    """The quarantined rows with their reasons."""
    return scored.where(~F.col("valid")).select("row_key", F.concat_ws("; ", "errors").alias("reasons"))


def with_presentation(scored: DataFrame) -> DataFrame:
    """P29 + P30: display labels for the top features and the action line of the band."""
    labelled = F.transform("top_features", lambda t: F.concat(
        C.display_name(t["feature"]), F.lit(" ("), C.format_value(t["feature_value"]), F.lit(")")))
    return scored.select("*", labelled.alias("top_feature_labels"),
                         C.action_line(F.coalesce(F.col("risk_band"), F.lit(""))).alias("action"))

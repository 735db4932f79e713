"""Cleaning and cohort operators.

Each is one projection or one filter; no per-column job loops, no UDFs.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import columns as C

# Fixed values that must equal the reference.
INELIGIBLE_DISPOSITIONS = (11, 13, 14, 19, 20, 21)  # P3: expired / hospice discharge codes
POSITIVE_READMIT = "<30"                            # P4: label is 1 iff readmitted == "<30"
DROP_COLUMNS = ("encounter_id", "weight", "payer_code")  # P5
NOT_MEASURED_COLUMNS = ("A1Cresult", "max_glu_serum")   # P6 -> "not_measured"
UNKNOWN_FILL_COLUMNS = ("race", "medical_specialty")    # P7 -> "unknown"
MISSING_FILL_COLUMNS = ("diag_2", "diag_3")             # P7 -> "missing"
GENDER_SENTINEL = "Unknown/Invalid"                      # P19
NULL_TOKENS = ("", "?", "None")                          # ingest null tokens (documented default)


def trim_column_names(df: DataFrame) -> DataFrame:
    """Strip every column name (one projection)."""
    return df.toDF(*[c.strip() for c in df.columns])


def trim_string_cells(df: DataFrame, null_tokens: Sequence[str] = ("",)) -> DataFrame:
    """Strip all string cells (Unicode white space); blank or a null token -> null."""
    cells = [(F.col(f"`{f.name}`"), f.name, isinstance(f.dataType, StringType)) for f in df.schema.fields]
    trimmed = df.select(*[(F.btrim(c, F.lit(C.WHITESPACE)) if text else c).alias(name) for c, name, text in cells])
    if not null_tokens:
        return trimmed
    # a projection of its own: a cell is trimmed once, not once for the test and once for the value
    return trimmed.select(*[(F.when(~c.isin(*null_tokens), c) if text else c).alias(name) for c, name, text in cells])


def exclude_codes(df: DataFrame, col: str = "discharge_disposition_id",
                  codes: Iterable[int] = INELIGIBLE_DISPOSITIONS) -> DataFrame:
    """Drop rows whose code is in the set; rows with a null code are kept."""
    return df.filter(~F.coalesce(F.col(col).isin(*codes), F.lit(False)))


def binary_label(df: DataFrame, source: str = "readmitted", label: str = "label",
                 positive: str = POSITIVE_READMIT, drop_source: bool = True) -> DataFrame:
    """label = 1 iff source == positive, null -> 0."""
    out = df.withColumn(label, F.coalesce((F.col(source) == positive).cast("int"), F.lit(0)))
    return out.drop(source) if drop_source else out


def cohort_label(df: DataFrame, label: str = "label") -> DataFrame:
    """P3 + P4: the labelled cohort."""
    return binary_label(exclude_codes(df), label=label)


def drop_if_present(df: DataFrame, cols: Iterable[str] = DROP_COLUMNS) -> DataFrame:
    """P5."""
    return df.drop(*[c for c in cols if c in df.columns])


def fill_sentinels(df: DataFrame, not_measured: Iterable[str] = NOT_MEASURED_COLUMNS,
                   unknown: Iterable[str] = UNKNOWN_FILL_COLUMNS,
                   missing: Iterable[str] = MISSING_FILL_COLUMNS) -> DataFrame:
    """P6 + P7: informative-missingness and sentinel fills, one projection."""
    fills: dict[str, str] = {}
    fills.update({c: "not_measured" for c in not_measured if c in df.columns})
    fills.update({c: "unknown" for c in unknown if c in df.columns})
    fills.update({c: "missing" for c in missing if c in df.columns})
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items()})


def derive_audit_dimensions(df: DataFrame) -> DataFrame:
    """P16 + P17 + P18 as columns: age_group, age_category, admission_type."""
    return df.withColumns({
        "age_group": C.age_bracket(F.col("age")),
        "age_category": C.age_category(F.col("age")),
        "admission_type": C.admission_type(F.col("admission_type_id")),
    })


def exclude_sentinel(df: DataFrame, col: str = "gender", sentinel: str = GENDER_SENTINEL) -> DataFrame:
    """Drop the sentinel category (null values are kept, as the reference's mask keeps them)."""
    return df.filter(F.coalesce(F.col(col) != sentinel, F.lit(True)))


def clean_vocabulary(df: DataFrame, vocab: Mapping[str, Sequence[str]],
                     null_literal: str = "None") -> DataFrame:
    """P25: values outside a column's vocabulary (and the literal 'None') -> null, one projection."""
    return df.withColumns({c: F.when(F.col(c).isin(*[v for v in allowed if v != null_literal]), F.col(c))
                           for c, allowed in vocab.items() if c in df.columns})


def coerce_codes_to_string(df: DataFrame, cols: Iterable[str] = ("diag_1", "diag_2", "diag_3")) -> DataFrame:
    """integer/string codes -> string (25000 -> '25000'); other types are rejected."""
    out = {}
    for c in cols:
        if c not in df.columns:
            continue
        t = df.schema[c].dataType.typeName()
        if t not in ("string", "integer", "long", "short", "byte"):
            raise TypeError(f"code column {c} must be string or integer, got {t}")
        out[c] = F.col(c).cast("string")
    return df.withColumns(out)


def alias_headers(df: DataFrame) -> DataFrame:
    """Hyphenated and underscored names both accepted -> canonical underscored names."""
    return df.toDF(*[C.sanitize_name(c.strip()) for c in df.columns])


def nonblank(c: Column) -> Column:
    """Value present: not null, not NaN (numerics), not blank (strings)."""
    return c.isNotNull() & (F.btrim(c.cast("string"), F.lit(C.WHITESPACE)) != "") & \
        ~F.lower(c.cast("string")).isin("nan")

"""Diagnosis-code functions (F1-F4): ICD-9 code -> clinical group as one native CASE expression."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import WHITESPACE

# Fixed values that must equal the reference: group labels and chapter ranges, in priority order.
ICD9_GROUPS = ("missing", "circulatory", "respiratory", "digestive", "diabetes", "injury",
               "musculoskeletal", "genitourinary", "neoplasms", "other")
# (group, inclusive ranges, single extra codes) checked in this order after the string rules.
ICD9_RANGES = (
    ("circulatory", ((390, 459),), (785,)),
    ("respiratory", ((460, 519),), (786,)),
    ("digestive", ((520, 579),), (787,)),
    ("injury", ((800, 999),), ()),
    ("musculoskeletal", ((710, 739),), ()),
    ("genitourinary", ((580, 629),), (788,)),
    ("neoplasms", ((140, 239),), ()),
)
# A code string counts as numeric when it looks like a decimal number (optionally signed,
# optionally with fraction or exponent); anything else maps to "other".
NUMERIC_CODE = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def strip_upper(c: Column) -> Column:
    """trim whitespace on both ends, then upper-case."""
    return F.upper(F.btrim(c, F.lit(WHITESPACE)))


def code_number(c: Column) -> Column:
    """safe numeric parse truncated toward zero; null when not a plain number."""
    return _number(strip_upper(c))


def _number(s: Column) -> Column:
    return F.when(s.rlike(NUMERIC_CODE), s.try_cast("double").try_cast("int"))


def icd9_group(c: Column) -> Column:
    """first matching rule wins; null/blank -> missing, V/E -> other, 250* -> diabetes."""
    return _group(c, strip_upper(c.cast("string")), code_number(c.cast("string")))


def _group(c: Column, s: Column, n: Column) -> Column:
    """F1 of a code, its stripped text and its number."""
    expr = (F.when(c.isNull() | (s == ""), F.lit("missing"))
            .when(s.startswith("V") | s.startswith("E"), F.lit("other"))
            .when(s.startswith("250"), F.lit("diabetes"))
            .when(n.isNull(), F.lit("other")))
    for group, ranges, extra in ICD9_RANGES:
        cond = None
        for lo, hi in ranges:
            part = n.between(lo, hi)
            cond = part if cond is None else cond | part
        for code in extra:
            cond = cond | (n == code)
        expr = expr.when(cond, F.lit(group))
    return expr.otherwise(F.lit("other"))


def bucket_diagnoses(df: DataFrame, cols: Iterable[str] = ("diag_1", "diag_2", "diag_3")) -> DataFrame:
    """replace each present diagnosis column by its group; the text and the number are worked out once a code."""
    present = [c for c in cols if c in df.columns]
    if not present:
        return df
    texts = df.withColumns({f"__text_{c}": strip_upper(F.col(c).cast("string")) for c in present})
    numbers = texts.withColumns({f"__number_{c}": _number(F.col(f"__text_{c}")) for c in present})
    grouped = numbers.withColumns({c: _group(F.col(c), F.col(f"__text_{c}"), F.col(f"__number_{c}")) for c in present})
    return grouped.select(*[F.col(f"`{c}`") for c in df.columns])

"""Scalar column functions: name sanitising, bands, code maps, hashing."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference (stated once, in natural order).
# ---------------------------------------------------------------------------
AGE_DECILES = ("[0-10)", "[10-20)", "[20-30)", "[30-40)", "[40-50)",
               "[50-60)", "[60-70)", "[70-80)", "[80-90)", "[90-100)")
# Age decile -> audit bracket ([60-70) belongs to 40-65 here).
AGE_BRACKET = {"[0-10)": "<40", "[10-20)": "<40", "[20-30)": "<40", "[30-40)": "<40",
               "[40-50)": "40-65", "[50-60)": "40-65", "[60-70)": "40-65",
               "[70-80)": ">65", "[80-90)": ">65", "[90-100)": ">65"}
# Age decile -> sample-export category ([60-70) is senior here); null -> unknown.
AGE_CATEGORY = {"[0-10)": "young", "[10-20)": "young", "[20-30)": "young", "[30-40)": "young",
                "[40-50)": "midage", "[50-60)": "midage", "[60-70)": "senior",
                "[70-80)": "elderly", "[80-90)": "elderly", "[90-100)": "elderly"}
# Admission type code -> label, anything else (or null) -> Other.
ADMISSION_TYPE = {1: "Emergency", 2: "Urgent", 3: "Elective"}
# P20: risk band cut points on the unrounded probability.
RISK_BAND_LOW, RISK_BAND_HIGH = 0.10, 0.30
# Sample-selection bands [0,.1) [.1,.2) [.2,.3) [.3,1.001).
SELECTION_BANDS = ((0.0, 0.1, "low"), (0.1, 0.2, "low_moderate"), (0.2, 0.3, "high_moderate"), (0.3, 1.001, "high"))
# Selection band -> the risk band a record of it is expected to have.
EXPECTED_BAND = {"low": "low", "low_moderate": "moderate", "high_moderate": "moderate", "high": "high"}
# Positive-class base rate used for lift.
BASE_RATE = 0.1139
# Band -> recommended action text; unknown band -> ''.
ACTION_LINE = {"low": "Standard discharge follow-up appropriate.",
               "moderate": "Consider scheduling a follow-up call within 7 days.",
               "high": "Recommend transitional care consult within 48h of discharge."}
# Display names of features; other names fall back to spaces + capitalised words.
FEATURE_DISPLAY_NAMES = {
    "number_inpatient": "Prior inpatient admissions",
    "discharge_disposition_id": "Discharge disposition code",
    "number_diagnoses": "Number of diagnoses",
    "time_in_hospital": "Days in hospital",
    "number_emergency": "Prior ER visits",
    "num_medications": "Medications at discharge",
    "num_lab_procedures": "Lab procedures during stay",
    "num_procedures": "Procedures during stay",
    "number_outpatient": "Prior outpatient visits",
    "admission_type_id": "Admission type",
    "admission_source_id": "Admission source",
    "diag_1_circulatory": "Primary diagnosis: circulatory",
    "diag_1_diabetes": "Primary diagnosis: diabetes",
    "diag_1_respiratory": "Primary diagnosis: respiratory",
    "diag_1_digestive": "Primary diagnosis: digestive",
    "diag_1_injury": "Primary diagnosis: injury",
    "diag_1_musculoskeletal": "Primary diagnosis: musculoskeletal",
    "diag_1_genitourinary": "Primary diagnosis: genitourinary",
    "diag_1_neoplasms": "Primary diagnosis: neoplasms",
    "metformin_No": "Not on metformin",
    "diabetesMed_No": "No diabetic medications",
    "insulin_No": "Not on insulin",
    "insulin_Steady": "Insulin steady",
    "insulin_Up": "Insulin increased",
    "insulin_Down": "Insulin decreased",
}

# Characters that trimming removes at both ends: the Unicode white space.
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
              "\u2009\u200a\u2028\u2029\u202f\u205f\u3000")

_NAME_BAD = re.compile(r"[^A-Za-z0-9_]+")


def sanitize_name(name: str) -> str:
    """P10 on a Python string: runs of non-word characters -> '_', then strip '_' at both ends."""
    return _NAME_BAD.sub("_", str(name)).strip("_")


def sanitize_col(c: Column) -> Column:
    """P10 as a column expression (for name tables held as data)."""
    return F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9_]+", "_"), r"^_+|_+$", "")


def literal_map(mapping: Mapping) -> Column:
    """A constant map column; lookups against it are folded into the projection."""
    items = []
    for k, v in mapping.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def age_bracket(age: Column) -> Column:
    """Unmapped -> null."""
    return literal_map(AGE_BRACKET)[age]


def age_category(age: Column) -> Column:
    """Null -> unknown, other unmapped -> null."""
    return F.when(age.isNull(), F.lit("unknown")).otherwise(literal_map(AGE_CATEGORY)[age])


def admission_type(code: Column) -> Column:
    """1/2/3 -> label, everything else (null included) -> Other."""
    return F.coalesce(literal_map(ADMISSION_TYPE)[code], F.lit("Other"))


def risk_band(p: Column) -> Column:
    """P20: < 0.10 low, < 0.30 moderate, else high (null stays null)."""
    return (F.when(p < RISK_BAND_LOW, F.lit("low"))
            .when(p < RISK_BAND_HIGH, F.lit("moderate"))
            .when(p.isNotNull(), F.lit("high")))


def selection_band(p: Column) -> Column:
    """Left-closed bands, out of range -> null."""
    expr = None
    for lo, hi, name in SELECTION_BANDS:
        cond = (p >= lo) & (p < hi)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr


def lift(p: Column, base_rate: float = BASE_RATE) -> Column:
    """P / base rate; 0 when the base rate is not positive."""
    return p / F.lit(float(base_rate)) if base_rate > 0 else F.lit(0.0)


def action_line(band: Column) -> Column:
    """Lower-cased band -> action text; unknown -> ''."""
    return F.coalesce(literal_map(ACTION_LINE)[F.lower(band)], F.lit(""))


def title_case(c: Column) -> Column:
    """Letters upper-case at the start and after any non-letter, lower-case elsewhere."""
    chars = F.split(c, "")

    def cased(ch: Column, i: Column) -> Column:
        first = (i == 0) | ~F.get(chars, i - 1).rlike(r"^\p{L}$")
        return F.when(first, F.upper(ch)).otherwise(F.lower(ch))
    return F.array_join(F.transform(chars, cased), "")


def display_name(feature: Column) -> Column:
    """P29 name part: dictionary lookup, else '_' -> ' ' and title case."""
    return F.coalesce(literal_map(FEATURE_DISPLAY_NAMES)[feature],
                      title_case(F.replace(feature, F.lit("_"), F.lit(" "))))


def format_value(v: Column) -> Column:
    """P29 value part: integral values without decimals, else 3 significant digits ('%.3g' style).

    The exponent is read after rounding to 3 digits (999.7 -> 1e+03); zeros are stripped only
    after a decimal point (120.4 -> 120). Infinities are 'inf' and '-inf', NaN is 'nan'.
    """
    d = v.cast("double")
    finite = F.abs(d) < F.lit(float("inf"))
    rounded = F.format_string("%.2e", F.when(finite, d))
    e = F.substring_index(rounded, "e", -1).cast("int")
    fixed = None
    for k in range(-4, 3):  # exponents printed in positional notation by %.3g
        txt = F.format_string(f"%.{2 - k}f", F.when(finite, d))
        fixed = F.when(e == k, txt) if fixed is None else fixed.when(e == k, txt)
    trailing = r"(\.[0-9]*?)0+$"
    positional = F.regexp_replace(F.regexp_replace(fixed, trailing, "$1"), r"\.$", "")
    mantissa = F.regexp_replace(F.regexp_replace(F.substring_index(rounded, "e", 1), trailing, "$1"), r"\.$", "")
    scientific = F.concat(mantissa, F.lit("e"), F.substring_index(rounded, "e", -1))
    return (F.when(d.isNull(), F.lit(None).cast("string"))
            .when(F.isnan(d), F.lit("nan"))
            .when(~finite, F.when(d > 0, F.lit("inf")).otherwise(F.lit("-inf")))
            .when((d == F.floor(d)) & (F.abs(d) < F.lit(1e18)), F.when(F.abs(d) < F.lit(1e18), d).cast("long").cast("string"))
            .when((e >= -4) & (e <= 2), positional)
            .otherwise(scientific))


def md5_unit(*parts: Column) -> Column:
    """Uniform [0,1) from the first 8 hex digits of md5 of the ':'-joined parts (SQL-reproducible)."""
    h = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint").cast("double") / F.lit(4294967296.0)


def md5_bucket(key: Column, seed: int | str, buckets: int = 10000) -> Column:
    """Bucket of a key: int(md5('seed:key')[0:8], 16) % buckets."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
    b = F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % F.lit(buckets)
    return b.cast("int") if buckets <= 2 ** 31 else b


def poisson1_cutoffs(kmax: int = 12) -> list[float]:
    """Cumulative Poisson(1) probabilities P(X <= k), k = 0..kmax-1 (rule-built, rounded to 12 dp)."""
    out, acc = [], 0.0
    for k in range(kmax):
        acc += math.exp(-1.0) / math.factorial(k)
        out.append(round(acc, 12))
    return out


def poisson1_weight(u: Column, kmax: int = 12) -> Column:
    """Inverse-CDF draw of Poisson(1) from a uniform u. Uniforms of 32 bits are at most 1 - 2^-32, which is
    below P(X <= 12), so with kmax = 12 the last value is P(X >= 12) as a whole: no draw is clipped."""
    expr = None
    for k, cut in enumerate(poisson1_cutoffs(kmax)):
        cond = u < F.lit(cut)
        expr = F.when(cond, F.lit(k)) if expr is None else expr.when(cond, F.lit(k))
    return expr.otherwise(F.lit(kmax))


def request_id(run_id: str, key: Column) -> Column:
    """32-hex id, deterministic under task retry (unlike uuid())."""
    return F.md5(F.concat_ws("|", F.lit(run_id), key.cast("string")))


def composite_key(*cols: Column) -> Column:
    """'_'-joined composite key."""
    return F.concat_ws("_", *cols)


def json_safe(c: Column) -> Column:
    """NaN -> null for floating columns."""
    return F.when(~F.isnan(c), c)


def columns_hash(names: Iterable[str] | Column) -> Column:
    """SHA-256 of the JSON text of the sorted column-name list, items parted by ', '."""
    arr = names if isinstance(names, Column) else F.array(*[F.lit(n) for n in names])
    quoted = F.transform(F.array_sort(arr), lambda n: F.regexp_replace(F.to_json(F.array(n)), r"^\[|\]$", ""))
    return F.sha2(F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]")), 256)


def blank_to_null(c: Column) -> Column:
    """P2 on one column: trim whitespace, empty -> null."""
    return F.nullif(F.btrim(c, F.lit(WHITESPACE)), F.lit(""))

"""Record validation as a rule table evaluated per row.

Every rule is a Column predicate with a message; a row's ``errors`` (and ``warnings``) array
lists every violated rule, so a bad batch is never failed as a whole: ``size(errors) = 0``
splits accepted rows from the quarantine.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.columns import AGE_DECILES, WHITESPACE

# Fixed values that must equal the reference: required fields, lower/upper bounds, vocabularies.
REQUIRED = ("race", "gender", "age", "admission_type_id", "discharge_disposition_id",
            "admission_source_id", "time_in_hospital", "num_lab_procedures", "num_medications",
            "number_diagnoses")
LOWER_BOUNDS = {"admission_type_id": 1, "discharge_disposition_id": 1, "admission_source_id": 1,
                "time_in_hospital": 1, "num_lab_procedures": 0, "num_medications": 0,
                "number_diagnoses": 1, "num_procedures": 0, "number_outpatient": 0,
                "number_emergency": 0, "number_inpatient": 0}
UPPER_BOUNDS = {"time_in_hospital": 14}
# Input-form bounds: warnings, not errors.
WARN_BOUNDS = {"admission_type_id": (1, 8), "discharge_disposition_id": (1, 28),
               "admission_source_id": (1, 25), "num_lab_procedures": (0, 132), "num_procedures": (0, 6),
               "num_medications": (1, 81), "number_diagnoses": (1, 16)}
MED_CHANGE = ("No", "Down", "Steady", "Up")
MED_COLUMNS = ("metformin", "repaglinide", "nateglinide", "chlorpropamide", "glimepiride",
               "acetohexamide", "glipizide", "glyburide", "tolbutamide", "pioglitazone",
               "rosiglitazone", "acarbose", "miglitol", "troglitazone", "tolazamide", "examide",
               "citoglipton", "insulin", "glyburide_metformin", "glipizide_metformin",
               "glimepiride_pioglitazone", "metformin_rosiglitazone", "metformin_pioglitazone")
VOCABULARIES = {"gender": ("Male", "Female", "Unknown/Invalid"), "age": AGE_DECILES,
                "max_glu_serum": (">200", ">300", "Norm"), "A1Cresult": (">7", ">8", "Norm"),
                "change": ("No", "Ch"), "diabetesMed": ("Yes", "No"),
                **{m: MED_CHANGE for m in MED_COLUMNS}}
# Required-field validity predicate of the sample export / batch tools.
VALIDITY_FIELDS = REQUIRED


@dataclass(frozen=True)
class Rule:
    field: str
    violated: Column
    message: str
    level: str = "error"


def present(c: Column) -> Column:
    """Not null, not NaN, not blank."""
    s = c.cast("string")
    return c.isNotNull() & (F.btrim(s, F.lit(WHITESPACE)) != "") & (F.lower(s) != "nan")


def rules_for(df: DataFrame, required: Sequence[str] = REQUIRED, lower=LOWER_BOUNDS, upper=UPPER_BOUNDS,
              vocab=VOCABULARIES, warn_bounds=WARN_BOUNDS) -> list[Rule]:
    cols = set(df.columns)
    out: list[Rule] = []
    numeric_fields = set(lower) | set(upper) | set(warn_bounds)
    types = {f.name: f.dataType for f in df.schema.fields}

    def num(f: str) -> Column:
        """Integer view of a field: text input is parsed (never a failing cast)."""
        return F.col(f).try_cast("int") if isinstance(types[f], StringType) else F.col(f)

    for f in required:
        miss = ~present(F.col(f)) if f in cols else F.lit(True)
        out.append(Rule(f, miss, f"{f}: field required"))
    for f in sorted(numeric_fields & cols):
        if isinstance(types[f], StringType):
            out.append(Rule(f, present(F.col(f)) & num(f).isNull(), f"{f}: must be an integer"))
    for f, lo in lower.items():
        if f in cols:
            out.append(Rule(f, num(f) < lo, f"{f}: must be >= {lo}"))
    for f, hi in upper.items():
        if f in cols:
            out.append(Rule(f, num(f) > hi, f"{f}: must be <= {hi}"))
    for f, allowed in vocab.items():
        if f in cols:
            out.append(Rule(f, F.col(f).isNotNull() & ~F.col(f).isin(*allowed), f"{f}: value not allowed"))
    for f, (lo, hi) in warn_bounds.items():
        if f in cols:
            out.append(Rule(f, (num(f) < lo) | (num(f) > hi), f"{f}: outside {lo}-{hi}", "warning"))
    return out


def validate(df: DataFrame, allowed_fields: Sequence[str] | None = None, rules: list[Rule] | None = None) -> DataFrame:
    """Add ``errors`` and ``warnings`` (arrays of messages) and ``valid`` = no errors.

    Unknown fields (columns outside ``allowed_fields``) are an error on every row.
    """
    rules = rules if rules is not None else rules_for(df)
    extra = [c for c in df.columns if allowed_fields is not None and c not in set(allowed_fields)]

    def collect(level: str) -> Column:
        msgs = [F.when(F.coalesce(r.violated, F.lit(False)), F.lit(r.message)) for r in rules if r.level == level]
        if level == "error":
            msgs += [F.lit(f"{c}: extra field not permitted") for c in extra]
        return F.filter(F.array(*msgs), lambda m: m.isNotNull()) if msgs else F.array().cast("array<string>")

    out = df.select("*", collect("error").alias("errors"), collect("warning").alias("warnings"))
    return out.withColumn("valid", F.size("errors") == 0)


def is_valid_row(fields: Sequence[str] = VALIDITY_FIELDS, gender_vocab=VOCABULARIES["gender"]) -> Column:
    """All required fields present and the gender in its vocabulary."""
    cond = F.lit(True)
    for f in fields:
        cond = cond & present(F.col(f))
    return cond & F.col("gender").isin(*gender_vocab)


def quarantine_split(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, quarantined rows with their reasons)."""
    return validated.where("valid"), validated.where(~F.col("valid"))


def skipped_summary(df: DataFrame, valid: Column, key: str = "encounter_id", first: int = 10) -> DataFrame:
    """P24 report: number of rows failing the validity predicate and the first ``first`` keys.

    One aggregate: the count, and the smallest keys through ``min_by``-style top-n on the failing
    rows (a take-ordered limited to ``first`` rows, never the whole set).
    """
    bad = df.where(~F.coalesce(valid, F.lit(False)))
    keys = bad.select(key).orderBy(key).limit(first).agg(F.sort_array(F.collect_list(key)).alias("first_keys"))
    total = bad.agg(F.count("*").cast("bigint").alias("skipped"))
    from .scalars import with_scalars
    return with_scalars(total, keys)

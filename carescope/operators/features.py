"""Vocabulary fit / one-hot transform / manifest alignment.

The dynamic one-hot of the reference (output columns depend on the values present) is replaced
by an explicit fit/transform pair: ``fit_vocabulary`` learns (column, category, count, kept) in
one grouped pass, and ``FeatureSpec.transform`` emits a schema fully determined by that
vocabulary, as a single projection of literal comparisons (no UDF, no per-column jobs).
The vocabulary is metadata (bounded by the categorical cardinalities, checked against
``max_categories``), so it is collected to the driver to become literals in the plan.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.columns import sanitize_name
from . import prep

RARE_THRESHOLD = 0.01          # fixed: categories with count < 0.01 * N collapse to "other"
RARE_COLUMNS = ("medical_specialty",)
OTHER = "other"
MAX_CATEGORIES = 100_000       # a categorical with more distinct values is refused, not truncated


# P5 without the row key: the key is carried end-to-end (joins replace row positions) and is
# simply never selected as a feature.
PREPARE_DROP = ("weight", "payer_code")


def prepare(df: DataFrame, drop: Iterable[str] = PREPARE_DROP) -> DataFrame:
    """P14 steps before encoding: drop P5 columns, ICD-9 buckets (F2), sentinel fills."""
    return prep.fill_sentinels(codes.bucket_diagnoses(prep.drop_if_present(df, drop)))


@dataclass
class FeatureSpec:
    """Frozen train <-> inference contract: numeric columns, ordered vocabulary, rare maps."""

    numeric: list[str]
    categories: dict[str, list[str]]                # column -> sorted kept categories (after collapse)
    rare: dict[str, list[str]] = field(default_factory=dict)  # column -> seen-but-rare categories
    positive_rate: float | None = None

    # -- names ---------------------------------------------------------------
    def feature_names(self) -> list[str]:
        names = [sanitize_name(c) for c in self.numeric]
        for col, cats in self.categories.items():
            names += [sanitize_name(f"{col}_{v}") for v in cats]
        dupes = [n for n, k in Counter(names).items() if k > 1]
        if dupes:  # P11
            raise ValueError(f"several columns or categories would be named alike: {dupes}")
        return names

    # -- transform -----------------------------------------------------------
    def mapped(self, col: str) -> Column:
        """P8 at inference: kept -> itself, seen-but-rare -> 'other', never seen -> null (all zeros)."""
        c = F.col(col).cast("string")
        rare = self.rare.get(col)
        if rare:
            c = F.when(c.isin(*rare), F.lit(OTHER)).otherwise(c)
        return c

    def feature_columns(self) -> list[Column]:
        """P9 + P10 + P12: numeric as float (null -> 0), one float indicator per category."""
        names = iter(self.feature_names())
        # try_cast: unparsable text in a numeric field becomes 0 instead of failing the batch
        # (validation reports it); for numeric input it is an ordinary cast.
        out = [F.coalesce(F.col(c).try_cast("float"), F.lit(0.0).cast("float")).alias(next(names))
               for c in self.numeric]
        for col, cats in self.categories.items():
            m = self.mapped(col)
            out += [F.coalesce(m == F.lit(v), F.lit(False)).cast("float").alias(next(names)) for v in cats]
        return out

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """One projection: kept pass-through columns, then the features in manifest order."""
        return df.select(*keep, *self.feature_columns())

    # -- manifest (S8) ------------------------------------------------------------
    def to_json(self) -> str:
        names = self.feature_names()
        return json.dumps({"n_features": len(names), "feature_names": names,
                           "dtypes": {n: "float32" for n in names}, "numeric": self.numeric,
                           "categories": self.categories, "rare": self.rare,
                           "positive_rate": self.positive_rate}, indent=1)

    @classmethod
    def from_json(cls, text: str) -> FeatureSpec:
        d = json.loads(text)
        return cls(d["numeric"], d["categories"], d.get("rare", {}), d.get("positive_rate"))


def fit_vocabulary(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str],
                   rare_columns: Iterable[str] = RARE_COLUMNS, threshold: float = RARE_THRESHOLD,
                   label: str | None = "label", max_categories: int = MAX_CATEGORIES) -> FeatureSpec:
    """Fit the vocabulary with one aggregate job over the (already prepared) frame.

    One unpivot + group-by yields (column, category, n) for every categorical column (null
    categories included, which gives the row count N) and for the label (which gives the positive
    rate). The small result becomes the spec on the driver: categories sorted in code-point order
    (upper case before lower), rare ones (n < threshold * N) collapsed to "other".
    """
    label_key = "__label__"   # pseudo-column carrying the label counts
    parts = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("category")) for c in categorical]
    if label:
        parts.append(F.struct(F.lit(label_key).alias("column"), F.col(label).cast("string").alias("category")))
    if not parts:
        return FeatureSpec(list(numeric), {}, {}, None)
    counts = (df.select(F.inline(F.array(*parts))).groupBy("column", "category")
                .agg(F.count("*").cast("bigint").alias("n")))
    # The vocabulary is bounded by the categorical cardinalities; refuse (never truncate) a
    # vocabulary that is not small enough to become literals in the plan.
    limit = max_categories * max(len(categorical), 1) + 16
    rows = counts.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"vocabulary exceeds {limit} entries; raise max_categories to accept it")
    first = categorical[0] if categorical else label_key
    n_total = sum(r["n"] for r in rows if r["column"] == first)
    rate = None
    if label:
        lab = [(float(r["category"]), r["n"]) for r in rows if r["column"] == label_key and r["category"] is not None]
        rate = sum(v * n for v, n in lab) / sum(n for _, n in lab) if lab else None
    rare_cols = set(rare_columns)
    cut = float(threshold) * n_total
    cats: dict[str, set[str]] = {c: set() for c in categorical}
    rare: dict[str, list[str]] = {}
    for r in rows:
        col, cat = r["column"], r["category"]
        if col == label_key or cat is None:
            continue
        if col in rare_cols and r["n"] < cut and cat != OTHER:
            rare.setdefault(col, []).append(cat)
            cats[col].add(OTHER)
        else:
            cats[col].add(cat)
    ordered = {c: sorted(v) for c, v in cats.items()}
    return FeatureSpec(list(numeric), ordered, {k: sorted(v) for k, v in rare.items()}, rate)


def align_to_manifest(df: DataFrame, feature_names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Add missing features as 0, drop extras, exact manifest order, float; nulls -> 0."""
    have = set(df.columns)
    cols = [F.coalesce(F.col(f"`{n}`").cast("float"), F.lit(0.0).cast("float")).alias(n) if n in have
            else F.lit(0.0).cast("float").alias(n) for n in feature_names]
    return df.select(*keep, *cols)


def extra_columns(df: DataFrame, feature_names: Sequence[str], keep: Sequence[str] = ()) -> list[str]:
    """Columns that alignment drops (reported, as the reference logs them)."""
    wanted = set(feature_names) | set(keep)
    return [c for c in df.columns if c not in wanted]


def dynamic_one_hot(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str],
                    keep: Sequence[str] = ()) -> DataFrame:
    """The reference's data-dependent encoding (columns = categories present in *this* frame).

    Kept for drift and alignment checks: its output is what ``align_to_manifest`` repairs.
    """
    spec = fit_vocabulary(df, categorical, numeric, rare_columns=(), label=None)
    return spec.transform(df, keep)


def vocabulary_table(spec: FeatureSpec, spark) -> DataFrame:
    """(position, feature, column, category) of a spec, as a small DataFrame."""
    rows = [(i, sanitize_name(c), c, None) for i, c in enumerate(spec.numeric)]
    pos = len(rows)
    for col, cats in spec.categories.items():
        for v in cats:
            rows.append((pos, sanitize_name(f"{col}_{v}"), col, v))
            pos += 1
    return spark.createDataFrame(rows, "position int, feature string, column string, category string")


def drift(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """J4 + U3: full outer join of two (feature, position) tables with a status per feature.

    status: 'ok', 'only_expected' (missing at inference), 'only_actual' (extra), 'moved'.
    """
    e = expected.select("feature", F.col("position").alias("expected_position"))
    a = actual.select("feature", F.col("position").alias("actual_position"))
    j = e.join(a, "feature", "full_outer")
    status = (F.when(F.col("actual_position").isNull(), F.lit("only_expected"))
              .when(F.col("expected_position").isNull(), F.lit("only_actual"))
              .when(F.col("expected_position") != F.col("actual_position"), F.lit("moved"))
              .otherwise(F.lit("ok")))
    return j.select("feature", "expected_position", "actual_position", status.alias("status"))

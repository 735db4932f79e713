"""Cohort, label, cleaning, bands."""

import pytest
from pyspark.sql import functions as F

from carescope.functions import columns as C
from carescope.operators import prep


def test_cohort_excludes_codes_keeps_null(spark):
    df = spark.createDataFrame([(1,), (6,), (11,), (13,), (19,), (25,), (None,)], "discharge_disposition_id int")
    kept = sorted([r[0] or 0 for r in prep.exclude_codes(df).collect()])
    assert kept == [0, 1, 6, 25]


def test_binary_label(spark):
    df = spark.createDataFrame([("<30",), (">30",), ("NO",), (None,)], "readmitted string")
    assert [r.label for r in prep.binary_label(df).collect()] == [1, 0, 0, 0]
    assert "readmitted" not in prep.binary_label(df).columns


def test_trim_names_and_cells(spark):
    df = spark.createDataFrame([(" a ", "\tb\n", " ")], "` x ` string, `y  ` string, z string")
    out = prep.trim_string_cells(prep.trim_column_names(df), prep.NULL_TOKENS)
    assert out.columns == ["x", "y", "z"]
    assert tuple(out.first()) == ("a", "b", None)


@pytest.mark.parametrize("p,band", [(0.05, "low"), (0.09, "low"), (0.10, "moderate"), (0.15, "moderate"),
                                    (0.29, "moderate"), (0.30, "high"), (0.50, "high"), (0.99, "high")])
def test_risk_band(spark, p, band):
    df = spark.createDataFrame([(p,)], "p double")
    assert df.select(C.risk_band(F.col("p"))).first()[0] == band


def test_age_maps_and_codes(spark):
    df = spark.createDataFrame([("[60-70)", 1), ("[30-40)", 2), ("[90-100)", 7), (None, None)], "age string, t int")
    rows = df.select(C.age_bracket(F.col("age")), C.age_category(F.col("age")),
                     C.admission_type(F.col("t"))).collect()
    assert [tuple(r) for r in rows] == [("40-65", "senior", "Emergency"), ("<40", "young", "Urgent"),
                                        (">65", "elderly", "Other"), (None, "unknown", "Other")]


def test_sanitize():
    assert C.sanitize_name("age_[0-10)") == "age__0_10"
    assert C.sanitize_name("max_glu_serum_>200") == "max_glu_serum__200"


def test_action_line(spark):
    df = spark.createDataFrame([("HIGH",), ("low",), ("x",)], "b string")
    out = [r[0] for r in df.select(C.action_line(F.col("b"))).collect()]
    assert out[0].startswith("Recommend") and out[1].startswith("Standard") and out[2] == ""


def test_code_coercion_and_aliases(spark):
    df = spark.createDataFrame([(25000, "x")], "diag_1 int, `glyburide-metformin` string")
    out = prep.alias_headers(prep.coerce_codes_to_string(df))
    assert out.columns == ["diag_1", "glyburide_metformin"]
    assert out.first().diag_1 == "25000"
    bad = spark.createDataFrame([(1.5,)], "diag_1 double")
    with pytest.raises(TypeError):
        prep.coerce_codes_to_string(bad)


def test_clean_vocabulary_and_json_safe(spark):
    df = spark.createDataFrame([("None", float("nan")), (">7", 1.0), ("bogus", None)], "A1Cresult string, x double")
    out = prep.clean_vocabulary(df, {"A1Cresult": [">7", ">8", "Norm"]}).select(
        "A1Cresult", C.json_safe(F.col("x")).alias("x")).collect()
    assert [tuple(r) for r in out] == [(None, None), (">7", 1.0), (None, None)]


def test_request_id_deterministic(spark):
    df = spark.createDataFrame([(1,), (2,)], "k long")
    a = [r[0] for r in df.select(C.request_id("run", F.col("k"))).collect()]
    b = [r[0] for r in df.select(C.request_id("run", F.col("k"))).collect()]
    assert a == b and len(set(a)) == 2 and all(len(x) == 32 for x in a)


def test_feature_display(spark):
    df = spark.createDataFrame([("number_inpatient", 3.0), ("A1Cresult__8", 1.0), ("age__70_80", 0.123456)],
                               "f string, v double")
    out = [r[0] for r in df.select(F.concat(C.display_name(F.col("f")), F.lit(" ("),
                                            C.format_value(F.col("v")), F.lit(")"))).collect()]
    assert out == ["Prior inpatient admissions (3)", "A1Cresult  8 (1)", "Age  70 80 (0.123)"]
    values = [120.4, 100.3, 999.7, 999.4, 0.00012345, 0.000012345, 12345.6, 1.5, -2.25, 0.1, 99.95, float("inf"), float("-inf"),
              float("nan"), 1e15, 5.0, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(C.format_value(F.col("v"))).collect()]
    whole = lambda v: v == v and abs(v) != float("inf") and v == int(v)
    assert got == [None if v is None else str(int(v)) if whole(v) else f"{v:.3g}" for v in values]
    names = ["A1Cresult__8", "x9y_zz", "ABC", "diag_2_o'neil"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(C.title_case(F.col("n"))).collect()]
    assert got == [n.title() for n in names]


def test_unicode_white_space_is_trimmed(spark):
    from carescope.functions import codes
    df = spark.createDataFrame([("\x0b428\x0c",), ("\xa0428\u2003",), ("\x0b \x1f",)], "c string")
    assert [r[0] for r in df.select(codes.icd9_group(F.col("c"))).collect()] == ["circulatory", "circulatory", "missing"]
    assert [r[0] for r in prep.trim_string_cells(df).collect()] == ["428", "428", None]


def test_skipped_summary_and_strict_first_valid(spark):
    from carescope.operators import sample, validate
    df = spark.createDataFrame([(i, None if i % 3 == 0 else "x") for i in range(30)], "encounter_id long, race string")
    row = validate.skipped_summary(df, F.col("race").isNotNull()).first()
    assert row.skipped == 10 and row.first_keys == [0, 3, 6, 9, 12, 15, 18, 21, 24, 27]
    assert sample.first_valid(df, F.col("race").isNotNull(), 5, strict=True).count() == 5
    with pytest.raises(ValueError):
        sample.first_valid(df, F.col("race").isNotNull(), 25, strict=True)


def test_assert_no_leakage(spark):
    from carescope.operators import split
    ok = spark.createDataFrame([(1, "train"), (1, "train"), (2, "test")], "patient_nbr long, split string")
    split.assert_no_leakage(ok)
    bad = spark.createDataFrame([(1, "train"), (1, "test")], "patient_nbr long, split string")
    with pytest.raises(ValueError, match="test&train"):
        split.assert_no_leakage(bad)

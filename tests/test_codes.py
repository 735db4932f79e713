"""ICD-9 grouping (F1-F4): the unit table of the reference tests plus edge cases."""

import pytest
from pyspark.sql import functions as F

from carescope.functions.codes import icd9_group

CASES = [
    ("390", "circulatory"), ("410.5", "circulatory"), ("459", "circulatory"), ("785", "circulatory"),
    ("459.9", "circulatory"), ("250.83", "diabetes"), ("25000", "diabetes"), ("250", "diabetes"),
    ("V57", "other"), ("V58.1", "other"), ("E906", "other"), ("v57", "other"),
    (None, "missing"), ("", "missing"), ("   ", "missing"), (" 428 ", "circulatory"),
    ("460", "respiratory"), ("786", "respiratory"), ("520", "digestive"), ("787", "digestive"),
    ("800", "injury"), ("999", "injury"), ("710", "musculoskeletal"), ("580", "genitourinary"),
    ("788", "genitourinary"), ("140", "neoplasms"), ("239.9", "neoplasms"), ("abc", "other"),
    ("1d", "other"), ("NaN", "other"), ("Infinity", "other"), ("4.2e2", "circulatory"), ("100", "other"),
]


@pytest.mark.parametrize("code,group", CASES)
def test_icd9(spark, code, group):
    df = spark.createDataFrame([(code,)], "c string")
    assert df.select(icd9_group(F.col("c")).alias("g")).first()["g"] == group

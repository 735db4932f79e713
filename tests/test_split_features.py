"""Group split, leakage, vocabulary fit/transform, alignment."""

import pytest
from pyspark.sql import functions as F

from carescope.operators import features, split
from carescope.plans import queries as Q

SF = "/root/testdata/sf0.001"


def test_split_disjoint_and_complete(spark):
    c = Q.split_cohort(spark, SF)
    n = c.count()
    sizes = {r.split: r.rows for r in split.split_summary(c).collect()}
    assert sum(sizes.values()) == n and set(sizes) == {"train", "val", "test"}
    assert split.leakage_check(c).count() == 0


def test_naive_split_leaks(spark):
    naive = split.assign_split(Q.clean_cohort(spark, SF), group="encounter_id")
    assert split.leakage_check(naive).count() > 0


def test_vocabulary_and_transform(spark):
    p = Q.prepared_cohort(spark, SF)
    spec = features.fit_vocabulary(p, Q.CATEGORICAL, Q.NUMERIC)
    names = spec.feature_names()
    assert len(names) == len(set(names))
    assert all(n == n.strip("_") for n in names)
    # rare specialties collapse to "other"; never-seen values encode as all zeros
    assert "other" in spec.categories["medical_specialty"]
    one = spark.createDataFrame([("Podiatry",), ("NeverSeen",)], "medical_specialty string")
    ms = features.FeatureSpec([], {"medical_specialty": spec.categories["medical_specialty"]},
                              spec.rare, None)
    rows = ms.transform(one).collect()
    assert rows[0]["medical_specialty_other"] == 1.0
    assert sum(rows[1]) == 0.0
    enc = spec.transform(p, keep=["encounter_id"])
    assert enc.columns[1:] == names
    assert all(t == "float" for _, t in enc.dtypes[1:])


def test_duplicate_names_rejected():
    spec = features.FeatureSpec([], {"A1Cresult": [">7", "<7"]})
    with pytest.raises(ValueError):
        spec.feature_names()


def test_align_fills_missing_and_drops_extra(spark):
    df = spark.createDataFrame([(1, 2.0, 5.0)], "k int, a double, extra double")
    out = features.align_to_manifest(df, ["a", "b"], keep=["k"])
    assert out.columns == ["k", "a", "b"] and tuple(out.first()) == (1, 2.0, 0.0)
    assert features.extra_columns(df, ["a", "b"], keep=["k"]) == ["extra"]


def test_manifest_round_trip(tmp_path, spark):
    from carescope.sources import io
    p = Q.prepared_cohort(spark, SF)
    spec = features.fit_vocabulary(p, Q.CATEGORICAL, Q.NUMERIC)
    path = io.write_manifest(spec, str(tmp_path / "m.json"))
    back = io.read_manifest(path)
    assert back.feature_names() == spec.feature_names()


def test_manifest_hash_matches_spark(tmp_path, spark):
    from carescope.sources import io
    p = Q.prepared_cohort(spark, SF)
    spec = features.fit_vocabulary(p, Q.CATEGORICAL, Q.NUMERIC)
    doc = io.manifest_document(io.write_manifest(spec, str(tmp_path / "m.json")))
    assert doc["manifest_version"] == "1.0" and doc["exported_at"].endswith("+00:00")
    row = Q.REGISTRY["manifest_hash"](spark, SF).first()
    assert row.columns_sha256 == doc["columns_sha256"] and row.n_features == doc["n_features"]


def test_exact_split_fractions(spark):
    c = split.assign_split(Q.clean_cohort(spark, "/root/testdata/sf0.01"), exact=True)
    per = {r.split: r.groups for r in split.split_summary(c).collect()}
    total = sum(per.values())
    assert abs(per["test"] - 0.15 * total) <= 1.5 and abs(per["val"] - 0.15 * total) <= 1.5
    assert split.leakage_check(c).count() == 0


def test_no_leakage_columns_in_features(spark):
    p = Q.prepared_cohort(spark, SF)
    names = features.fit_vocabulary(p, Q.CATEGORICAL, Q.NUMERIC).feature_names()
    for banned in ("label", "readmitted", "patient_nbr", "encounter_id", "score", "weight", "payer_code"):
        assert not any(n == banned or n.startswith(banned + "_") for n in names)
    enc = features.fit_vocabulary(p, Q.CATEGORICAL, Q.NUMERIC).transform(p, keep=["encounter_id", "label"])
    assert enc.count() == p.count()

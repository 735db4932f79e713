"""What several passes of a query read is worked out once."""

from types import SimpleNamespace

from conftest import SF001

from carescope.functions import codes
from carescope.operators import models, prep
from carescope.plans import queries as Q
from carescope.session import kept_table, small_methods


def plan(df, capsys):
    capsys.readouterr()
    df.explain("extended")
    text = capsys.readouterr().out
    return text[text.index("== Optimized Logical Plan =="):text.index("== Physical Plan ==")]


def test_a_code_is_parsed_once(spark, capsys):
    df = spark.createDataFrame([("410.5", 1), ("v57", 2), (" ", 3), (None, 4), ("250.83", 5)], "diag_1 string, n int")
    out = codes.bucket_diagnoses(df)
    assert out.columns == ["diag_1", "n"] and plan(out, capsys).count("RLIKE") == 1
    assert [r[0] for r in out.orderBy("n").collect()] == ["circulatory", "other", "missing", "missing", "diabetes"]


def test_a_cell_is_trimmed_once(spark, capsys):
    df = spark.createDataFrame([(" a ", 1), ("?", 2), (None, 3), ("　", 4)], "`x.y` string, n int")
    out = prep.trim_string_cells(df, prep.NULL_TOKENS)
    assert plan(out, capsys).count("trim(") == 1
    assert [r[0] for r in out.orderBy("n").collect()] == ["a", None, None, None]


def test_kept_table_and_the_setting(spark):
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    with small_methods(spark):
        assert int(spark.conf.get(name)) <= 8000
    df = spark.createDataFrame([(1, "a", 0.5), (1, "a", 0.5), (None, None, None)], "k long, s string, x double")
    kept = kept_table(df, "test")
    assert kept.schema == df.schema and sorted(map(str, kept.collect())) == sorted(map(str, df.collect()))
    assert spark.conf.get(name) == before


def test_encoding_reads_prepared_rows(spark, capsys):
    enc, _ = Q.encoded_cohort(spark, SF001)
    text = plan(enc, capsys)
    assert "RLIKE" not in text and "trim(" not in text and "parquet" in text


def test_bundle_and_inputs_share_the_prepared_rows(spark, monkeypatch):
    scans, given, whole = [], [], Q.encounters
    monkeypatch.setattr(Q, "encounters", lambda *a, **k: scans.append(1) or whole(*a, **k))
    stub = SimpleNamespace(spec=SimpleNamespace(transform=lambda df, keep: df))
    monkeypatch.setattr(Q, "trained_bundle", lambda spark, d, p=None: given.append(p) or stub)
    _, enc = Q.bundle_and_inputs(spark, SF001)
    assert len(scans) == 1 and given[0] is enc


def test_class_weights_in_one_pass(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (None,)], "label int")
    assert sorted(models.class_weights(df), key=str) == [(0, 2, 1.0), (1, 1, 2.0), (None, 1, 2.0)]
    assert {r["label"]: r["weight"] for r in models.with_class_weights(df).collect()} == {0: 1.0, 1: 2.0, None: 2.0}


def test_the_cohort_is_not_shuffled_for_the_picks(spark, capsys):
    assert "strategy=broadcast" in plan(Q.REGISTRY["sample_export"](spark, SF001), capsys)

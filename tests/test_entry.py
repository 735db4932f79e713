"""Driver contract: entry() runs, every query has a callable, oracle keys are a subset."""

from __spark_entry__ import entry, oracle_sql, queries


def test_entry(spark):
    df = entry(spark)
    rows = df.collect()
    assert len(rows) >= 1 and set(df.columns) >= {"subgroup", "n", "auroc", "auprc"}


def test_registry():
    q, o = queries(), oracle_sql()
    assert set(o) <= set(q) and len(q) >= 60

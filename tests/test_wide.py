"""Wide one-hot encoding: equal to the literal form on small vocabularies, a million categories, crowded ones."""

import pytest
from pyspark.sql import functions as F

from carescope.operators import wide
from carescope.plans import queries as Q

SF = "/root/testdata/sf0.001"


def test_equals_the_literal_encoding(spark):
    p = Q.prepared_cohort(spark, SF)
    spec = Q.fitted_spec(p)
    index = wide.fit_index(p, Q.CATEGORICAL, Q.NUMERIC)
    names = spec.feature_names()
    assert wide.size_of(index, Q.NUMERIC) == len(names)
    assert all(names[r.position] == r.feature for r in index.collect())
    dense = {r.encounter_id: [float(x) for x in r[1:]] for r in spec.transform(p, keep=["encounter_id"]).collect()}
    got = wide.encode(p, index, "encounter_id", Q.CATEGORICAL, Q.NUMERIC)
    v = got.withColumn("v", wide.as_vector(F.col("indices"), F.col("values"), len(names)))
    rows = v.collect()
    assert len(rows) == len(dense)
    for r in rows:
        assert list(r.indices) == sorted(set(r.indices)) and r.v.toArray().tolist() == dense[r.encounter_id]


def test_a_million_categories(spark):
    df = spark.range(1_000_000).selectExpr("id", "case when id % 3 = 0 then 'often' else concat('c', id) end as c", "cast(id % 7 as double) as x")
    index = wide.fit_index(df, ["c"], ["x"], rare_columns=())
    assert index.count() == 666_667 and wide.size_of(index, ["x"]) == 666_668
    assert [r.category for r in index.where("crowded").collect()] == ["often"]
    out = wide.encode(df, index, "id", ["c"], ["x"])
    one = out.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.col("indices")[1]).alias("k"), F.min(F.size("indices")).alias("a"), F.max(F.size("indices")).alias("b")).first()
    assert tuple(one) == (1_000_000, 666_667, 2, 2)


def test_awkward_rows(spark):
    df = spark.createDataFrame([(1, "a", None, 1.5), (2, None, "z", None), (3, "b", "z", 2.0), (4, "", "z", 0.0)], "id int, c string, d string, x double")
    index = wide.fit_index(df, ["c", "d"], ["x"], rare_columns=("d",), threshold=0.9)
    assert {(r.ord, r.category): (r.mapped, r.position) for r in index.collect()} == {
        (0, ""): ("", 1), (0, "a"): ("a", 2), (0, "b"): ("b", 3), (1, "z"): ("other", 4)}
    new = df.union(spark.createDataFrame([(5, "never", "w", 3.0)], df.schema))
    got = {r.id: (list(r.indices), list(r["values"])) for r in wide.encode(new, index, "id", ["c", "d"], ["x"]).collect()}
    assert got == {1: ([0, 2], [1.5, 1.0]), 2: ([0, 4], [0.0, 1.0]), 3: ([0, 3, 4], [2.0, 1.0, 1.0]), 4: ([0, 1, 4], [0.0, 1.0, 1.0]), 5: ([0], [3.0])}
    with pytest.raises(ValueError, match="named alike"):
        wide.fit_index(spark.createDataFrame([(1, "a b"), (2, "a-b")], "id int, c string"), ["c"], [])
    none = df.where("id < 0")
    empty = wide.fit_index(none, ["c"], ["x"])
    assert empty.count() == 0 and wide.size_of(empty, ["x"]) == 1 and wide.encode(none, empty, "id", ["c"], ["x"]).count() == 0

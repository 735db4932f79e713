"""Streams with state: percentiles by band from sketches, records scored once, complete tables."""

import datetime as dt
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from carescope.streaming import scoring, sketch

SCHEMA = "ts timestamp, value double, risk_band string"


def log(spark, n=3000, seed=1):
    rng, start = np.random.default_rng(seed), dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(minutes=float(m)), float(v), b) for m, v, b in
            zip(np.sort(rng.uniform(0, 300, n)), rng.lognormal(3, 2, n), rng.choice(["low", "high"], n))]
    return spark.createDataFrame([*rows, (start, None, "low"), (start, 0.0, "low")], SCHEMA)


def exact(pdf, p):
    return np.percentile(pdf["value"].dropna(), 100 * p)


def test_batch_percentiles_within_the_bound(spark):
    df = log(spark)
    pdf = df.toPandas()
    got = sketch.percentile_rollup(df, "1 hour").collect()
    hours = pdf["ts"].dt.floor("h")
    assert len(got) == len(pdf.groupby([hours, "risk_band"]))
    for r in got:
        part = pdf[(hours == r.window_start) & (pdf["risk_band"] == r.risk_band)]
        assert r.n == part["value"].count() and r.mean_value == pytest.approx(part["value"].mean()) and r.max_value == part["value"].max()
        for p in (0.5, 0.95, 0.99):
            want = exact(part, p)
            assert abs(r[f"p{round(100 * p)}"] - want) <= sketch.ALPHA * want + 1e-9


@pytest.mark.parametrize("value", [1e-9, 0.37, 1.0, 12345.6, 9e11, -4.2])
def test_representative_is_near(spark, value):
    (r,) = spark.createDataFrame([(value,)], "v double").select(sketch.representative(F.col("v"))).first()
    assert abs(r - value) <= sketch.ALPHA * abs(value) * (1 + 1e-9)


def test_stream_equals_batch_and_closes_all_windows(spark, tmp_path):
    df, base = log(spark), str(tmp_path)
    df.orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 700).parquet(f"{base}/in")

    def run():
        stream = scoring.record_stream(spark, f"{base}/in", df.schema, max_files_per_trigger=1).withWatermark("ts", "10 minutes")
        scoring.write_scores(sketch.percentile_rollup(stream, "1 hour"), f"{base}/out", f"{base}/ck").awaitTermination()
        return sorted(map(tuple, spark.read.schema(want.schema).parquet(f"{base}/out").collect()))
    want = sketch.percentile_rollup(df, "1 hour")
    rows = sorted(map(tuple, want.collect()))
    some = run()
    assert some != rows and set(r[:3] for r in some) <= set(r[:3] for r in rows)       # open windows have not come out
    sketch.end_of_stream(spark, f"{base}/in", df.schema, dt.datetime(2024, 1, 2))
    done = run()
    assert [r[:3] for r in done] == [r[:3] for r in rows] and np.allclose([r[3:] for r in done], [r[3:] for r in rows])
    assert run() == done                                                               # a restart adds nothing


def test_replayed_records_give_no_second_row(spark, tmp_path):
    base = str(tmp_path)
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (None, "d")], "encounter_id bigint, x string")
    rows.coalesce(1).write.parquet(f"{base}/in")

    def run():
        stream = scoring.once_per_record(scoring.record_stream(spark, f"{base}/in", rows.schema))
        scoring.write_scores(stream, f"{base}/out", f"{base}/ck").awaitTermination()
        return sorted(map(tuple, spark.read.parquet(f"{base}/out").collect()), key=str)
    want = sorted(map(tuple, rows.collect()), key=str)
    assert run() == want
    part = next((tmp_path / "in").glob("part-*"))
    shutil.copy(part, tmp_path / "in" / f"part-again-{part.name}")                     # the same file once more, after a restart
    assert run() == want
    rows.union(spark.createDataFrame([(3, "e")], rows.schema)).coalesce(1).write.mode("append").parquet(f"{base}/in")
    assert run() == sorted([*want, (3, "e")], key=str)


def test_complete_table_is_whole_at_any_time(spark, tmp_path, monkeypatch):
    base = str(tmp_path)
    df = log(spark, 60)
    df.write.parquet(f"{base}/in")

    def run():
        stream = scoring.record_stream(spark, f"{base}/in", df.schema)
        scoring.write_complete(stream.groupBy("risk_band").count(), f"{base}/out", f"{base}/ck").awaitTermination()
    run()
    first = {r.risk_band: r["count"] for r in scoring.read_complete(spark, f"{base}/out").collect()}
    assert sum(first.values()) == 62
    (tmp_path / "out/batch=7").mkdir()                                                 # a write that did not end
    assert {r.risk_band: r["count"] for r in scoring.read_complete(spark, f"{base}/out").collect()} == first
    df.write.mode("append").parquet(f"{base}/in")
    run()
    assert {r.risk_band: r["count"] for r in scoring.read_complete(spark, f"{base}/out").collect()} == {k: 2 * v for k, v in first.items()}
    assert len([p for p in (tmp_path / "out").iterdir() if (p / "_SUCCESS").exists()]) == 1

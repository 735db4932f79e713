"""Run log (S10) and latest-run lookup (S11) as an append-only parquet table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_SCHEMA = "run_id string, name string, start_time timestamp, params map<string,string>, metrics map<string,double>"


def append_run(spark: SparkSession, path: str, run_id: str, name: str, params: dict, metrics: dict,
               start_time: dt.datetime | None = None) -> None:
    """Append one run record (a one-row write; concurrent writers add separate files)."""
    row = [(run_id, name, start_time or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None),
            {k: str(v) for k, v in params.items()}, {k: float(v) for k, v in metrics.items()})]
    spark.createDataFrame(row, RUN_SCHEMA).write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).parquet(path)


def latest_runs(log: DataFrame, name: str | None = None) -> DataFrame:
    """Newest run per name (ties: highest run_id); empty when none matches."""
    data = log if name is None else log.where(F.col("name") == name)
    best = F.max_by(F.struct(*[F.col(c) for c in data.columns]), F.struct(F.col("start_time"), F.col("run_id")))
    return data.groupBy("name").agg(best.alias("_r")).select("_r.*")

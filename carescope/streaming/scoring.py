"""Structured Streaming: continuous scoring (X1) and the scoring-log rollup.

X1 reuses the batch scorer unchanged: it is a chain of projections (no join, no state), so a
file stream of records is scored micro-batch by micro-batch with exactly the batch semantics,
invalid rows included (they carry their reasons to the sink, which acts as the quarantine).
X2 is an event-time tumbling-window aggregate with a watermark; ``append`` emits only windows
closed by the watermark (production sink), ``complete`` re-emits all windows (parity tests).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import score
from ..session import remove_folder
from .rollup import window_rollup


def record_stream(spark: SparkSession, source_dir: str, schema: StructType, fmt: str = "parquet",
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """Arriving record files with a fixed schema (no inference on streams)."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(source_dir)


def score_stream(records: DataFrame, spec, scorer, key: str = "encounter_id", top_k: int = 5,
                 run_id: str = "stream") -> DataFrame:
    """The B1 transform on a streaming DataFrame."""
    return score.score_batch(records, spec, scorer, key=key, top_k=top_k, run_id=run_id)


def once_per_record(records: DataFrame, key: str = "encounter_id", watermark: str = "1 day", ts: str | None = None) -> DataFrame:
    """The first arrival of every record; a file landed twice, or a sender's repeat, gives no second row.

    What has been seen is keyed state in the checkpoint, so it outlives a restart; a key is forgotten
    once the watermark has passed its arrival by ``watermark``. The time is ``ts`` or else that of the
    record's file. Records without a key are told apart by their whole content, never all taken for one.
    """
    at = ts or "_arrived"
    named = records.columns
    timed = records if ts else records.withColumn(at, F.col("_metadata.file_modification_time"))
    content = F.concat(F.lit("without key "), F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in named])), 256))
    keyed = timed.withColumn("_once", F.coalesce(F.concat(F.lit("key "), F.col(f"`{key}`").cast("string")), content))
    return keyed.withWatermark(at, watermark).dropDuplicatesWithinWatermark(["_once"]).select(*[F.col(f"`{c}`") for c in named])


def write_scores(scored: DataFrame, sink_dir: str, checkpoint_dir: str, available_now: bool = True):
    """Start the X1 sink: parquet files + checkpoint (exactly-once file sink). Returns the query."""
    w = (scored.writeStream.format("parquet").option("path", sink_dir)
         .option("checkpointLocation", checkpoint_dir).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def write_scores_with_quarantine(scored: DataFrame, accepted_dir: str, quarantine_dir: str,
                                 checkpoint_dir: str, available_now: bool = True):
    """X1 + B3: accepted rows and quarantined rows (with their reasons) to two parquet tables.

    Each micro-batch is written under ``batch=<id>`` with overwrite, so a replayed batch after a
    failure rewrites the same directories instead of duplicating rows.
    """
    def sink(batch_df: DataFrame, epoch_id: int) -> None:
        held = batch_df.persist()
        try:
            held.where(F.col("valid")).write.mode("overwrite").parquet(f"{accepted_dir}/batch={epoch_id}")
            held.where(~F.col("valid")).select("request_id", "row_key", "errors", "warnings") \
                .write.mode("overwrite").parquet(f"{quarantine_dir}/batch={epoch_id}")
        finally:
            held.unpersist()

    w = scored.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Zone-less timestamps cannot carry a watermark: cast to TIMESTAMP (session zone UTC)."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def rollup_stream(events: DataFrame, size: str = "1 hour", watermark: str = "2 hours",
                  group_cols: Sequence[str] = ("event_type",), ts: str = "ts") -> DataFrame:
    """Counts / mean / max of the value per event-time window and group, with a watermark."""
    return window_rollup(event_time(events, ts).withWatermark(ts, watermark), size, group_cols, ts)


def run_to_table(df: DataFrame, name: str, mode: str = "complete"):
    """Drive a streaming aggregate to completion into an in-memory table (small interactive checks only:
    the memory sink keeps the result on the driver)."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def write_complete(df: DataFrame, path: str, checkpoint_dir: str, available_now: bool = True):
    """Complete-mode aggregate to parquet: every micro-batch rewrites the full result table.

    File sinks accept append mode only. Each micro-batch writes a folder of its own, ``batch=<id>``, whole
    before older ones go, and a repeated batch writes the same one again; :func:`read_complete` takes the
    highest that is whole, so a crash leaves a table at any time. Nothing passes through the driver.
    """
    def sink(batch_df: DataFrame, epoch_id: int) -> None:
        batch_df.write.mode("overwrite").parquet(f"{path}/batch={epoch_id}")
        for older in _whole_batches(batch_df.sparkSession, path):
            if older < epoch_id:
                remove_folder(batch_df.sparkSession, f"{path}/batch={older}")

    w = df.writeStream.outputMode("complete").foreachBatch(sink).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def _whole_batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches whose write has been committed."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
    return sorted(int(n[6:]) for n in names if n.startswith("batch=") and fs.exists(hadoop.Path(f"{path}/{n}/_SUCCESS")))


def read_complete(spark: SparkSession, path: str) -> DataFrame:
    """The table of the last whole batch of :func:`write_complete`."""
    return spark.read.parquet(f"{path}/batch={_whole_batches(spark, path)[-1]}")

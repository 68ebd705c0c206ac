"""Structured Streaming forms of the windowed and first-seen operators. Event time is a timestamp with a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """Events from a folder of Parquet files, with event time t."""
    rows = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn("t", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str, late: str) -> DataFrame:
    """Count and sum by window and type; rows later than `late` behind the newest are dropped."""
    w = events.withWatermark("t", late).groupBy(F.window("t", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Sessions of each user that a silence of `gap` ends, with their number of events."""
    w = events.withWatermark("t", late).groupBy("user_id", F.session_window("t", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return w.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark("t", late).dropDuplicatesWithinWatermark(keys)


def ledger_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that appends monthly spend, one folder a batch: a batch that is run again replaces its own rows."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spend = batch.groupBy(F.date_format("t", "yyyy-MM").alias("month"), "user_id").agg(F.sum("value").alias("spend"))
        spend.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all batches of a ledger, with the batch they came in."""
    return spark.read.schema("month string, user_id bigint, spend double, batch_id bigint").parquet(path)


def drain(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there now into a Parquet folder and returns its rows: append mode, so a window is out once
    the watermark has passed it."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)

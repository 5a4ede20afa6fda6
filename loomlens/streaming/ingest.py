"""Incremental ingest and event windows with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_rows(batch: DataFrame, target: DataFrame, key: list[str]) -> DataFrame:
    """Rows of a batch whose key the target hasn't yet; of equal keys one."""
    return batch.dropDuplicates(key).join(target.select(*key), key, "left_anti")


def first_of_each(events: DataFrame, keys: list[str], late: str, at: str = "ts") -> DataFrame:
    """Of a stream's rows with equal keys one, so long as they come within ``late`` of each other; rows older than the watermark are dropped.

    A key is forgotten once the watermark has passed it by, so that the state doesn't grow with the stream.
    """
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, schema, key: list[str]) -> dict[str, int]:
    """Take in what has come to a folder since the last call; keys that are there already are skipped. Gives counts."""
    seen = {"total": 0, "done": 0}

    spark.createDataFrame([], schema).write.mode("ignore").parquet(target)  # so that there is a target to compare with

    def put(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        old = spark.read.schema(schema).parquet(target)
        fresh = new_rows(batch, old, key).persist()
        seen["total"] += batch.count()
        seen["done"] += fresh.count()
        fresh.write.mode("append").parquet(target)
        fresh.unpersist()
        batch.unpersist()

    query = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return seen | {"skipped": seen["total"] - seen["done"]}


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Events by window and type; with ``late`` on a stream, windows close that much after their end."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


def sliding_rate(events: DataFrame, most: int, width: str = "1 hour", step: str = "30 minutes") -> DataFrame:
    """Users with more than ``most`` events in a sliding window."""
    rows = events.groupBy(F.window("ts", width, step).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return rows.where(F.col("n") > most).select(F.col("w.start").alias("window_start"), "user_id", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    rows = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("session_start"), "n")

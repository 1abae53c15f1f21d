"""Incremental counterparts over the events table: windows with watermarks, and ids seen before."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.tables import _checkpoint_dir


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a file stream; the pattern lets the table be one file or a folder of them."""
    path = f"{sf_dir}/events.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame) -> DataFrame:
    """Run `stream` in append mode until nothing new is there and give what it has written; the state is in the checkpoint folder.

    Every batch writes a folder of its own, named by its number, so a batch that is run again after a failure replaces what it had written.
    """
    spark = stream.sparkSession
    _checkpoint_dir(spark)
    at = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    stream.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).option("basePath", f"{at}/out").parquet(f"{at}/out").select(*stream.columns)


#: A window goes out when the watermark has passed its end; this is how late an event may come.
LATE = "1 day"


def tumbling_counts(spark: SparkSession, sf_dir: str, width: str = "1 hour") -> DataFrame:
    """(start, event_type, events) for each window of `width` that is closed; the state of closed windows is dropped."""
    e = event_stream(spark, sf_dir).withWatermark("ts", LATE).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("events"))
    return drain(e.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "events"))


def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(start, events) for windows of two hours, one every hour, that are closed."""
    e = event_stream(spark, sf_dir).withWatermark("ts", LATE).groupBy(F.window("ts", "2 hours", "1 hour")).agg(F.count("*").alias("events"))
    return drain(e.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "events"))


def user_sessions(spark: SparkSession, sf_dir: str, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, events): the closed runs of a user's events less than `gap` apart, from the stream."""
    e = event_stream(spark, sf_dir).withWatermark("ts", LATE).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("events"))
    return drain(e.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "events"))


def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id): each id once, however often it is delivered within a day of the first time; an older one is dropped as late."""
    return drain(event_stream(spark, sf_dir).withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["event_id"]).select("event_id"))

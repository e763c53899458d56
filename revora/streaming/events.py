"""Streams of events: exact duplicates within a watermark dropped, counted by day and kind.

This goes beyond the batch operators: it shows the same counts kept up
incrementally.  State lives in the checkpoint folder, results in a Parquet
table below the shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..runtime import shared_dir

SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])
LATENESS = "2 days"


def daily_counts(spark: SparkSession, folder: str, lateness: str = LATENESS) -> DataFrame:
    """(day, event_type, n, total) of all event files of a folder, read as a stream until none is left.

    Every batch writes its finished increments; a batch that is run again
    overwrites its own part, so nothing is counted twice.
    """
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = spark.readStream.schema(SCHEMA).option("pathGlobFilter", "events.parquet").parquet(folder)
    clean = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])

    def write(batch: DataFrame, number: int) -> None:
        days = batch.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        days.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    query = clean.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    parts = spark.read.schema("day string, event_type string, n bigint, total double, batch bigint").parquet(f"{base}/out")
    return parts.groupBy("day", "event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total"))

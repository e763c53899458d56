"""Incremental intake: new reviews of a stream joined to what is held, with a ledger, safe to run again.

Each micro-batch charges the ledger first and loads after; both write under
the batch's number, so a batch that is run again replaces its own part.  Rows
held already, and repeats within the stream's batches, are not loaded twice.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.ingest import new_rows
from ..runtime import shared_dir

LEDGER = "month string, n bigint, batch bigint"


def as_reviews(records: DataFrame) -> DataFrame:
    """Vendor records as reviews: title and body as one text, the date to the second."""
    text = F.concat_ws("\n", F.nullif("title", F.lit("")), F.nullif("body", F.lit("")))
    return records.select(F.col("place").alias("facility_key"), "review_id", "rating", text.alias("text"), F.substring("published_at", 1, 19).alias("review_date"), F.col("reviewer").alias("reviewer_name"))


def sync(records: DataFrame, held: DataFrame, folder: str | None = None) -> tuple[DataFrame, DataFrame, str]:
    """(loaded reviews, ledger by month, folder) after all pages that are there; a second call with the folder takes only what came since."""
    spark = held.sparkSession
    base = folder or f"{shared_dir(spark)}/sync-{uuid.uuid4().hex}"
    reviews = as_reviews(records)

    def load(batch: DataFrame, number: int) -> None:
        batch.persist()
        charge = batch.groupBy(F.substring("review_date", 1, 7).alias("month")).agg(F.count(F.lit(1)).alias("n"))
        charge.write.mode("overwrite").parquet(f"{base}/ledger/batch={number}")
        before = held.select("facility_key", "review_id")
        if number:
            parts = spark.read.schema(T.StructType([*batch.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{base}/reviews").filter(F.col("batch") < number)
            before = before.unionByName(parts.select("facility_key", "review_id"))
        new_rows(batch, before, ["facility_key", "review_id"], "review_date").write.mode("overwrite").parquet(f"{base}/reviews/batch={number}")
        batch.unpersist()

    query = reviews.writeStream.foreachBatch(load).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    loaded = spark.read.schema(reviews.schema).parquet(f"{base}/reviews")
    ledger = spark.read.schema(LEDGER).parquet(f"{base}/ledger").groupBy("month").agg(F.sum("n").alias("n"))
    return loaded, ledger, base

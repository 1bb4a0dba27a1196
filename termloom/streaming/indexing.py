"""Incremental indexing: batches of documents become runs of postings, merged when they are read.

A micro-batch appends one folder of postings, named by its number, so a batch that
is replayed after a failure overwrites itself and counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.operators import index


def document_stream(spark: SparkSession, folder: str, files: int = 8) -> DataFrame:
    """doc_id, text of Parquet files as they arrive."""
    return spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", files).parquet(folder)


def start_indexing(documents: DataFrame, target: str, checkpoint: str, *, once: bool = False):
    """Runs until stopped, or with once over what is there."""

    def store(batch: DataFrame, number: int) -> None:
        rows = index.postings(batch).withColumn("batch", F.lit(number))
        rows.drop("batch").write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = documents.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def merged(spark: SparkSession, target: str) -> DataFrame:
    """The index as one: counts of a document in several batches add up."""
    runs = spark.read.parquet(target)
    return runs.groupBy("field", "doc_id", "term").agg(F.sum("tf").alias("tf"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Event counts by window and type of an event stream (ts, event_type), late rows up to a bound."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))

"""Payload files as a stream: pages that arrive in a folder become blocks, and block counts per minute of arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenlake.sources.html import html_blocks


def page_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """HTML files as source_id, html, arrived."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", "*.html").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return raw.select(F.col("path").alias("source_id"), F.decode("content", "UTF-8").alias("html"), F.col("modificationTime").alias("arrived"))


def arrivals(pages: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Pages per window of arrival, late ones up to the watermark."""
    return pages.withWatermark("arrived", late).groupBy(F.window("arrived", width)).agg(F.count("*").alias("pages"), F.sum(F.length("html")).alias("chars"))


def write_blocks(pages: DataFrame, out: str, checkpoint: str):
    """Start a query that appends the blocks of arriving pages to a Parquet table, each batch once."""

    def append(batch: DataFrame, number: int) -> None:
        html_blocks(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pages.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).start()

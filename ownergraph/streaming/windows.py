"""Streams: the rate limiter's windows, and new extracts as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ownergraph.sources.registry import TABLES, text_schema


def request_counts(requests: DataFrame, per_window: int = 60, seconds: int = 60, lateness: str = "2 minutes") -> DataFrame:
    """``client, window_start, n, refused`` per fixed window; late rows count up to ``lateness``.  Works on streams and tables."""
    counted = requests.withWatermark("ts", lateness) if requests.isStreaming else requests
    return (
        counted.groupBy("client", F.window("ts", f"{seconds} seconds").alias("w"))
        .agg(F.count("*").alias("n"))
        .select("client", F.col("w.start").alias("window_start"), "n", F.greatest(F.col("n") - per_window, F.lit(0)).alias("refused"))
    )


def arriving_extracts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stream over the extracts of one table, each read once."""
    return spark.readStream.schema(text_schema(TABLES[name])).csv(folder, sep=";", quote='"', escape='"', header=False, multiLine=True, mode="FAILFAST")


def append_bronze(stream: DataFrame, target: str, checkpoint: str):
    """Everything that has arrived, appended as Parquet; then the query ends."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)

"""Incremental runs with Structured Streaming: only what is new, with a margin for late rows, and running state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

MARGIN = "1 hour"


def changes(spark: SparkSession, path: str, schema: str | StructType, *, format: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Rows of files that appear below path; files already read are known from the checkpoint."""
    reader = spark.readStream.schema(schema).format(format)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)


def _timed(stream: DataFrame, at: str, margin: str) -> DataFrame:
    """Watermarks want instants; times without a zone are the session's."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, margin)


def once_each(stream: DataFrame, *keys: str, at: str, margin: str = MARGIN) -> DataFrame:
    """Each key once; state is kept for as long as a row may be late."""
    return _timed(stream, at, margin).dropDuplicatesWithinWatermark(list(keys))


def monthly(stream: DataFrame, *groups: str, at: str, margin: str = MARGIN) -> DataFrame:
    """Running counts per month and group."""
    return _timed(stream, at, margin).groupBy(*groups, F.date_format(at, "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def windowed(stream: DataFrame, width: str, *groups: str, at: str, margin: str = MARGIN, slide: str | None = None) -> DataFrame:
    """Counts per tumbling (or sliding) window; a window is final once the margin has passed."""
    span = F.window(at, width, slide) if slide else F.window(at, width)
    return _timed(stream, at, margin).groupBy(span.alias("w"), *groups).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *groups, "n")


def run_available(frame: DataFrame, sink: str, checkpoint: str, *, mode: str = "append", format: str = "parquet") -> None:
    """Reads all that is there, writes it and ends: an incremental run. A second call reads only what is new."""
    query = frame.writeStream.outputMode(mode).format(format).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)
    query.awaitTermination()


def merge_available(frame: DataFrame, checkpoint: str, upsert, *, mode: str = "update") -> StreamingQuery:
    """Hands each batch of a running aggregate to upsert(batch, id), which has to be idempotent."""
    query = frame.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(upsert).trigger(availableNow=True).start()
    query.awaitTermination()
    return query

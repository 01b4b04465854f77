"""Windowed streams with watermarks, and ingest by micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.operators.windows import utc


def read_stream(spark: SparkSession, path: str, schema: T.StructType, ts: str = "ts", files: int = 100) -> DataFrame:
    """A stream of Parquet files, ``files`` at most in a batch, with a zoned timestamp."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path).withColumn(ts, utc(ts))


def tumbling_stream(stream: DataFrame, ts: str, width: str, late: str, *by: str) -> DataFrame:
    out = stream.withWatermark(ts, late).groupBy(F.window(ts, width), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), *by, "n")


def sliding_stream(stream: DataFrame, ts: str, width: str, slide: str, late: str, *by: str) -> DataFrame:
    out = stream.withWatermark(ts, late).groupBy(F.window(ts, width, slide), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), *by, "n")


def session_stream(stream: DataFrame, ts: str, gap: str, late: str, key: str) -> DataFrame:
    out = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there, write Parquet, stop; a later call with the same checkpoint resumes."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ingest(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Incremental ingest: ``each(batch, number)`` writes one micro-batch. It must be idempotent by
    number, because a batch that failed after its writes is given again."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

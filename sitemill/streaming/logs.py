"""Log segments as a stream: error scan, alert once per new error."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sitemill.functions.text import is_log_error, log_bundle, short, strip
from sitemill.plans.health import log_error_rows


def read_segments(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Lines of a folder of log segments as a stream.

    The checkpoint remembers files, not offsets: writers must add segments and never
    append to one. ``max_files`` bounds a batch. Ordering inside a batch is by segment.
    """
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(path).select(
        "value",
        F.col("_metadata.file_modification_time").alias("seen_at"),
    )


def peek(spark: SparkSession, path: str) -> DataFrame:
    """The same errors as a batch; reads without moving the stream's checkpoint."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("ord"))
    return log_error_rows(lines).select("bundle_name", "message").distinct()


def new_errors(lines: DataFrame, repeat_after: str = "24 hours") -> DataFrame:
    """Error lines, each ``(bundle, message)`` once within ``repeat_after``.

    State is one entry per distinct error, dropped as the watermark passes it.
    """
    errors = lines.filter(is_log_error(F.col("value"))).select(
        log_bundle(F.col("value")).alias("bundle_name"),
        short(strip(F.col("value"))).alias("message"),
        "seen_at",
    )
    return errors.withWatermark("seen_at", repeat_after).dropDuplicatesWithinWatermark(
        ["bundle_name", "message"]
    )


def write_errors(errors: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    writer = errors.writeStream.format("parquet").outputMode("append").option("path", path).option(
        "checkpointLocation", checkpoint
    )
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="300 seconds")
    return writer.start()

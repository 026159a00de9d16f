"""Feed readers and table sinks: CSV/JSON/Parquet, JSON payloads, run log, items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sitemill.sources import commits, splits

# Fixed value: the run log columns.
RUN_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("bundle_name", T.StringType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("items_scraped", T.IntegerType()),
        T.StructField("duration_seconds", T.DecimalType(8, 2)),
        T.StructField("http_200_count", T.IntegerType()),
        T.StructField("http_403_count", T.IntegerType()),
        T.StructField("http_429_count", T.IntegerType()),
        T.StructField("http_500_count", T.IntegerType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)
TELEMETRY = (
    "bundle_name",
    "status",
    "items_scraped",
    "duration_seconds",
    "http_200_count",
    "http_403_count",
    "http_429_count",
    "error_message",
    "created_at",
)


#: Standard CSV: a quote within quotes is doubled, blanks belong to the value.
CSV = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_feed(
    spark: SparkSession, path: str, schema: T.StructType | None = None, line_breaks: bool = True, array: bool = False
) -> DataFrame:
    """A supplier feed by suffix. Without a schema, CSV columns are read as text.

    Text keeps leading zeros of identifiers; normalisation parses the numbers. A CSV value may hold
    line breaks in quotes; ``line_breaks=False`` says that none does and saves a pass over the
    files. JSON feeds hold an object per line, or with ``array`` one array per file. All of them
    are read by as many tasks as the files have ranges.
    """
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    reader = spark.read.schema(schema) if schema else spark.read
    if suffix == "csv":
        return splits.read_csv(spark, path, CSV, schema) if line_breaks else reader.options(**CSV).csv(path)
    if suffix == "json":
        return splits.read_json_array(spark, path, schema) if array else reader.json(path)
    if suffix in ("parquet", "pq"):
        return reader.parquet(path)
    raise ValueError(f"unsupported feed format: {suffix or path}")


def write_payloads(df: DataFrame, path: str) -> None:
    """One JSON object per row."""
    df.write.mode("overwrite").json(path)


def read_payloads(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON payload objects; a line that is not an object fails the job."""
    raw = spark.read.schema(f"{schema}, _bad string").option(
        "columnNameOfCorruptRecord", "_bad"
    ).json(path)
    names = [c for c in raw.columns if c != "_bad"]
    bad = F.concat(F.lit("not a JSON object: "), F.col("_bad"))
    guarded = raw.withColumn("_ok", F.when(F.col("_bad").isNotNull(), F.raise_error(bad)))
    return guarded.filter("_ok IS NULL").select(*names)


#: Columns of the telemetry table, in its order.
TELEMETRY_SCHEMA = T.StructType([RUN_SCHEMA[c] for c in TELEMETRY] + [T.StructField("dt", T.DateType())])
LOG_SCHEMA = T.StructType([*RUN_SCHEMA.fields, T.StructField("dt", T.DateType())])


def record_runs(runs: DataFrame, root: str, batch: str) -> bool:
    """Finished runs added to the log and to telemetry below ``root``, in one commit.

    False, and nothing done, for an empty batch and for one that is there already: a failure
    between the two tables shows in neither, and a retry counts once in both. Missing counters are
    zero. Both tables are partitioned by day; telemetry is sorted by bundle, status and time for
    its range filters.
    """
    if runs.isEmpty():
        return False
    have = set(runs.columns)
    filled = []
    for f in RUN_SCHEMA:
        c = F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
        if f.name in ("items_scraped", "duration_seconds") or f.name.startswith("http_"):
            c = F.coalesce(c, F.lit(0).cast(f.dataType))
        elif f.name == "created_at":
            c = F.coalesce(c, F.current_timestamp())
        filled.append(c.alias(f.name))
    rows = runs.select(*filled).withColumn("dt", F.to_date("created_at"))
    order = ["dt", "bundle_name", "status", "created_at"]
    # Range partitioning by the sort key splits a busy day over several files.
    telemetry = rows.select(*TELEMETRY, "dt").repartitionByRange(*order).sortWithinPartitions(*order)
    return commits.write_batch(runs.sparkSession, root, batch, {"log": rows, "telemetry": telemetry}, by="dt")


def record_stream(runs: DataFrame, root: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """A stream of finished runs, each of its batches a commit of its own; a batch that Spark repeats changes nothing."""
    writer = runs.writeStream.foreachBatch(lambda rows, number: record_runs(rows, root, f"{number:010d}") and None)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="300 seconds")).start()


def read_log(spark: SparkSession, root: str) -> DataFrame:
    return commits.read_batches(spark, root, "log", LOG_SCHEMA)


def read_telemetry(spark: SparkSession, root: str) -> DataFrame:
    return commits.read_batches(spark, root, "telemetry", TELEMETRY_SCHEMA)


def read_items(items: DataFrame, tie: str = "company_name") -> DataFrame:
    """Stored items, newest first."""
    return items.select("company_name", "summary", "source_url", "created_at").orderBy(
        F.col("created_at").desc(), F.col(tie)
    )


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, lower, upper, parts: int, **options) -> DataFrame:
    """A database table read in ``parts`` ranges of ``column``."""
    return spark.read.jdbc(
        url, table, column=column, lowerBound=lower, upperBound=upper, numPartitions=parts, properties=options
    )


def export_csv(df: DataFrame, path: str) -> str:
    """Standard CSV files with a header; what was there before is replaced, also by no rows."""
    df.write.mode("overwrite").options(**CSV).csv(path)
    return path

"""Crawl URL index: locations, shard lists, index scans and capture lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitemill import constants as K
from sitemill.functions.text import blank_to_null, strip

# Fixed value: the index columns used, the partition columns come from the paths.
INDEX_SCHEMA = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("url_host_name", T.StringType()),
        T.StructField("fetch_status", T.ShortType()),
        T.StructField("content_mime_type", T.StringType()),
        T.StructField("warc_filename", T.StringType()),
        T.StructField("warc_record_offset", T.LongType()),
        T.StructField("warc_record_length", T.LongType()),
        T.StructField("crawl", T.StringType()),
        T.StructField("subset", T.StringType()),
    ]
)

# Fixed value: the fields of a capture line; every source value is text.
CAPTURE_FIELDS = "url string, filename string, offset string, length string, status string, mime string, `mime-detected` string, timestamp string"


def manifest_url(crawl: str, base: str = K.CRAWL_HTTPS_BASE) -> str:
    return f"{base}/crawl-data/{crawl}/{K.CRAWL_MANIFEST_NAME}"


def partition_glob(crawl: str, subset: str = K.DEFAULT_SUBSET, root: str = K.CRAWL_INDEX_PREFIX) -> str:
    return f"{root}/crawl={crawl}/subset={subset}/*.parquet"


def record_url(filename: Column, base: str = K.CRAWL_HTTPS_BASE) -> Column:
    return F.concat(F.lit(f"{base}/"), F.ltrim(filename, F.lit("/")))


def shards(
    spark: SparkSession,
    manifest: str,
    crawl: str,
    subset: str = K.DEFAULT_SUBSET,
    max_shards: int | None = None,
    base: str | None = None,
) -> DataFrame:
    """Index shards of one crawl partition listed by a path manifest, in file order.

    All of them, or the first ``max_shards`` when the caller names a number above zero.
    """
    lines = spark.read.text(manifest).select(
        strip(F.col("value")).alias("path"),
        F.col("_metadata.file_path").alias("_file"),
        F.monotonically_increasing_id().alias("_line"),
    )
    found = lines.filter(
        F.contains("path", F.lit(f"/crawl={crawl}/subset={subset}/"))
        & F.endswith("path", F.lit(".parquet"))
    )
    ordered = found.orderBy("_file", "_line")
    if max_shards is not None and max_shards > 0:
        ordered = ordered.limit(max_shards)
    path = F.ltrim(F.col("path"), F.lit("/"))
    if base is not None:
        path = F.concat(F.lit(f"{base}/"), path)
    return ordered.select(path.alias("path"))


def shard_paths(listed: DataFrame) -> list[str]:
    """The paths of a shard list for a reader; a crawl has a few hundred. Empty is an error."""
    paths = [r[0] for r in listed.collect()]
    if not paths:
        raise RuntimeError("no Parquet shards for this crawl and subset")
    return paths


def index(spark: SparkSession, root: str, paths: list[str] | None = None, view: str | None = "cc") -> DataFrame:
    """The URL index below ``root`` (or only ``paths``) with its partition columns.

    Adds ``source_file``; registered as a view for SQL when ``view`` is given.
    """
    df = (
        spark.read.schema(INDEX_SCHEMA)
        .option("basePath", root)
        .parquet(*(paths or [root]))
        .withColumn("source_file", F.col("_metadata.file_path"))
    )
    if view:
        df.createOrReplaceTempView(view)
    return df


def query_index(spark: SparkSession, sql: str) -> DataFrame:
    """Any SELECT over the registered index view; the rows stay distributed."""
    return spark.sql(sql)


def dropped_captures(lines: DataFrame, value: str = "value") -> DataFrame:
    """One row: ``lines`` read, ``blank`` and ``malformed`` ones among them, which yield no capture."""
    text, schema = strip(F.col(value)), f"{CAPTURE_FIELDS}, _bad string"
    capture = F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    marked = lines.select((F.coalesce(text, F.lit("")) == "").alias("blank"), capture.alias("capture"))
    wrong = ~F.col("blank") & (F.col("capture").isNull() | F.col("capture._bad").isNotNull())
    return marked.agg(F.count(F.lit(1)).alias("lines"), F.count_if("blank").alias("blank"), F.count_if(wrong).alias("malformed"))


def parse_captures(lines: DataFrame, value: str = "value") -> DataFrame:
    """Add ``capture`` to JSON lines; blank and malformed lines are dropped."""
    text = strip(F.col(value))
    schema = f"{CAPTURE_FIELDS}, _bad string"
    parsed = lines.filter(text != "").withColumn(
        "capture",
        F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}),
    )
    return parsed.filter(F.col("capture").isNotNull() & F.col("capture._bad").isNull())


def cdx_captures(
    lines: DataFrame,
    status: int | None = 200,
    mime: str | None = "text/html",
    limit: int | None = None,
    order: str | None = None,
    value: str = "value",
    service_limits: bool = False,
) -> DataFrame:
    """Record pointers from capture lines.

    ``limit`` keeps the first so many of those that pass the filters, in ``order``. With
    ``service_limits`` the answer is that of the capture service: ``limit`` counts as 1 to 10,000,
    and only the first ``limit`` lines, five times as many when a filter is set, are looked at.
    """
    filtered = status is not None or bool(mime)
    if limit is not None and order is None:
        raise ValueError("a limit needs an order column")
    if limit is not None and service_limits:
        limit = max(1, min(int(limit), K.CDX_MAX_ROWS))
        fetched = min(limit * K.CDX_OVERFETCH, K.CDX_MAX_ROWS) if filtered else limit
        lines = lines.orderBy(order).limit(fetched)

    c = F.col("capture")
    status_text = F.coalesce(c["status"], F.lit(""))
    mime_text = F.coalesce(blank_to_null(c["mime-detected"]), c["mime"], F.lit(""))
    kept = parse_captures(lines, value)
    if status is not None:
        kept = kept.filter(status_text == str(status))
    if mime:
        kept = kept.filter(F.contains(mime_text, F.lit(mime)))
    kept = kept.filter(
        blank_to_null(c["filename"]).isNotNull() & c["offset"].isNotNull() & c["length"].isNotNull()
    )
    if limit is not None:
        kept = kept.orderBy(order).limit(limit)
    url = F.coalesce(c["url"], F.lit(""))
    carried = [order] if order else []
    return kept.select(
        *carried,
        url.alias("url"),
        F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit("")).alias("url_host_name"),
        c["filename"].alias("warc_filename"),
        c["offset"].try_cast("long").alias("warc_record_offset"),
        c["length"].try_cast("long").alias("warc_record_length"),
        c["timestamp"].alias("timestamp"),
        F.when(status_text.rlike("^[0-9]+$"), status_text.try_cast("int")).alias("status"),
        mime_text.alias("mime"),
        F.lit("cdx").alias("source"),
    )
